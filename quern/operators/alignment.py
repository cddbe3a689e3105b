"""Page to template: page votes, point pairs, homographies by seeded consensus, reprojection errors, confidences.

Each page's point pairs are gathered in one row, and samples of four are drawn as numbers of points, the same for pages with the
same markers. A task solves the first samples of many pages together; a page with a sample that all its points agree with is
settled, and for the others alone all TRIES are drawn, solved and scored. The winner is fitted again to its inliers: no row is
written per sample. A page has four points a marker, so groups stay small.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions import scoring
from quern.operators.ranking import vote

#: Inlier distance in pixels, least share of inliers and their least number, least markers and confidence.
INLIER, SHARE, LEAST, MARKERS, CONFIDENCE = 5.0, 0.5, 4, 3, 0.6
#: Samples of four points drawn a page.
TRIES = 200
#: Samples that are tried first: one that all points agree with needs no others.
FIRST = 8
#: Pages whose first samples are solved together.
BLOCK = 1000


def pages_of(detected: DataFrame) -> DataFrame:
    """image, page: the page that most detected markers (image, marker_id, seq) belong to, the first seen among equals."""
    return vote(detected, ["image"], F.floor(F.col("marker_id") / 4) + 1, "seq").select("image", F.col("value").alias("page"))


def point_pairs(detected: DataFrame, expected: DataFrame, pages: DataFrame) -> DataFrame:
    """image, marker_id, corner, x, y, u, v: detected corners joined to where the template has them (marker_id, corner, u, v).

    pages: image, page (pages_of). Markers of any other page than the image's own are misread and don't count.
    """
    own = detected.join(pages, "image").filter(F.floor(F.col("marker_id") / 4) + 1 == F.col("page"))
    return own.join(expected, ["marker_id", "corner"]).select("image", "marker_id", "corner", "x", "y", "u", "v")


def _solved(points: np.ndarray) -> np.ndarray:
    """[group, 9]: the homography from (x, y) to (u, v) of each group of points [group, point, 4], or nan if they don't determine one.

    Least squares on normalised points.
    """

    def centred(p):
        m = p.mean(axis=1, keepdims=True)
        s = np.sqrt(2) / np.maximum(np.sqrt(((p - m) ** 2).sum(axis=2)).mean(axis=1), 1e-12)
        t = np.zeros((len(p), 3, 3))
        t[:, 0, 0] = t[:, 1, 1] = s
        t[:, :2, 2], t[:, 2, 2] = -s[:, None] * m[:, 0], 1
        return (p - m) * s[:, None, None], t

    n, k = points.shape[:2]
    if k < 4 or not n:
        return np.full((n, 9), np.nan)
    (a, ta), (b, tb) = centred(points[..., :2]), centred(points[..., 2:])
    p, nil = np.concatenate([a, np.ones((n, k, 1))], axis=2), np.zeros((n, k, 3))
    m = np.concatenate([np.concatenate([p, nil, -p * b[..., :1]], axis=2), np.concatenate([nil, p, -p * b[..., 1:]], axis=2)], axis=1)
    _, s, vt = np.linalg.svd(m, full_matrices=2 * k < 9)
    h = (np.linalg.inv(tb) @ vt[:, 8].reshape(-1, 3, 3) @ ta).reshape(-1, 9)
    h[(s[:, 7] < 1e-9 * s[:, 0]) | (np.abs(h[:, 8]) < 1e-12)] = np.nan
    return h / h[:, 8:]


def _solve(points: np.ndarray) -> list[float] | None:
    h = _solved(points[None])[0]
    return None if np.isnan(h[0]) else h.tolist()


def _inliers(h: np.ndarray, points: np.ndarray) -> np.ndarray:
    """[homography, point]: whether it takes the point within INLIER of where it should be.

    points: [point, 4], or [homography, point, 4] where each has its own.
    """
    x, y, u, v = np.moveaxis(points, -1, 0)
    g = h[:, :, None]
    with np.errstate(invalid="ignore", divide="ignore"):
        d = g[:, 6] * x + g[:, 7] * y + g[:, 8]
        d[d == 0] = np.nan
        return np.sqrt(((g[:, 0] * x + g[:, 1] * y + g[:, 2]) / d - u) ** 2 + ((g[:, 3] * x + g[:, 4] * y + g[:, 5]) / d - v) ** 2) <= INLIER


def _consensus(points: np.ndarray, samples: np.ndarray) -> list[float] | None:
    """The homography of the sample [sample, 4] with the most inliers among points, the first among equals, fitted to them."""
    known = ~np.isnan(points).any(axis=1)
    best = np.zeros(len(points), dtype=bool)
    for some in np.split(samples, [FIRST << i for i in range(8) if FIRST << i < len(samples)]):  # few first, then twice as many
        names, which = np.unique(some, axis=0, return_inverse=True)
        names = np.where(known[names].all(axis=1)[:, None, None], points[names], np.nan)
        whole = ~np.isnan(names[:, 0, 0])
        h = np.full((len(names), 9), np.nan)
        h[whole] = _solved(_sorted(names[whole]))
        good = _inliers(h, points)
        n = good.sum(axis=1)[which.ravel()]
        if n.max(initial=0) > best.sum():
            best = good[which.ravel()[n.argmax()]]
        if best.sum() == known.sum():
            break
    return _solve(_sorted(points[best][None])[0])


def _settled(points: np.ndarray, counts: np.ndarray, samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each page, whether all its points agree with one of samples [page, sample, 4], and [page, 9]: the fit to them, or nan.

    points: [point, 4] of all pages, counts of them a page. A page gets what _consensus gives if it is settled.
    """
    pages, starts = np.arange(len(counts)), np.cumsum(counts) - counts
    of, known = np.repeat(pages, counts), ~np.isnan(points).any(axis=1)
    wanted = np.bincount(of[known], minlength=len(pages))
    done, fits = wanted == 0, np.full((len(pages), 9), np.nan)
    for some in samples.transpose(1, 0, 2):
        left = pages[~done]
        fours = points[starts[left, None] + some[left]]
        whole = ~np.isnan(fours).any(axis=(1, 2))
        h = np.full((len(pages), 9), np.nan)
        h[left[whole]] = _solved(_sorted(fours[whole]))
        at = ~done[of]
        good = _inliers(h[of[at]], points[at, None])[:, 0]
        done |= np.bincount(of[at][good], minlength=len(pages)) == wanted
        if done.all():
            break
    for k in np.unique(wanted[done & (wanted > 0)]):
        same = done & (wanted == k)
        fits[same] = _solved(_sorted(points[known & same[of]].reshape(-1, k, 4)))
    return done, fits


def _sorted(points: np.ndarray) -> np.ndarray:
    """Each group's points by x, y, u, v."""
    return np.take_along_axis(points, np.lexsort(points.transpose(2, 0, 1)[::-1], axis=-1)[..., None], axis=1)


def _fits(points: DataFrame, key: list[str]) -> DataFrame:
    """key, h of each group's points; h is null where they don't determine one. A group is a sample or a page's points."""

    @F.pandas_udf("array<double>")
    def solved(groups: pd.Series) -> pd.Series:
        return pd.Series([_solve(np.array([[p["x"], p["y"], p["u"], p["v"]] for p in g])) for g in groups], dtype=object)

    at = [F.col(c).cast("double").alias(c) for c in ("x", "y", "u", "v")]
    groups = points.dropna(subset=["x", "y", "u", "v"]).groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(*at))).alias("p"))
    return groups.select(*key, solved("p").alias("h"))


def projected(h: Column, x: Column, y: Column) -> tuple[Column, Column]:
    """(u, v) of a point; null for one that goes to infinity."""
    d = F.nullif(h[6] * x + h[7] * y + h[8], F.lit(0.0))
    return (h[0] * x + h[1] * y + h[2]) / d, (h[3] * x + h[4] * y + h[5]) / d


def homographies(points: DataFrame) -> DataFrame:
    """image, h, n_points, n_markers, n_inliers, error of pages with four points or more (image, marker_id, corner, x, y, u, v).

    error: mean over the inliers, or over all points if they are fewer than half or than four. Ties go to the first sample.
    """
    at = [F.col(c).cast("double").alias(c) for c in ("x", "y", "u", "v")]
    pages = points.filter("image is not null").groupBy("image").agg(F.sort_array(F.collect_list(F.struct("marker_id", "corner", *at))).alias("_p")).filter(F.size("_p") >= 4)
    # Many tasks however small the rows are: what a page costs are its samples. By a hash, as a join by image may have dealt them already.
    pages = pages.repartition(int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64("image"))
    # The four points of least hash; of equal ones the first by marker and corner, as they are sorted.
    hashed = lambda s: F.transform("_p", lambda p, i: F.struct(F.xxhash64(s, p["marker_id"], p["corner"]).alias("h"), i.alias("i")))
    drawn = lambda n: F.flatten(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda s: F.slice(F.sort_array(hashed(s)), 1, 4)["i"]))

    def read(batch: pa.RecordBatch, tries: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """[point, 4] of all pages, how many a page has, and the samples of pages that have any."""
        p = batch.column("_p")
        each = np.stack([p.flatten().field(c).to_numpy(zero_copy_only=False) for c in ("x", "y", "u", "v")], axis=1)
        return each, p.value_lengths().to_numpy(), batch.column("_s").flatten().to_numpy().reshape(-1, tries, 4)

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, BLOCK):
                batch = whole.slice(i, BLOCK)
                done, fits = _settled(*read(batch, FIRST))
                h = pa.array([None if np.isnan(f[0]) else f for f in fits], pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([batch.column("image"), batch.column("_p"), pa.array(done), h], names=["image", "_p", "_done", "h"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (each, counts, samples), h = read(batch, TRIES), batch.column("h").to_pylist()
            ends = np.cumsum(counts)
            for i, s in zip(np.flatnonzero(~batch.column("_done").to_numpy(zero_copy_only=False)), samples, strict=True):
                h[i] = _consensus(each[ends[i] - counts[i] : ends[i]], s)
            yield pa.RecordBatch.from_arrays([batch.column("image"), batch.column("_p"), pa.array(h, pa.list_(pa.float64()))], names=["image", "_p", "h"])

    kinds = ", ".join(f"{c} {pages.schema[c].dataType.simpleString()}" for c in ("image", "_p"))
    first = pages.withColumn("_s", drawn(FIRST)).mapInArrow(settle, f"{kinds}, _done boolean, h array<double>")
    rest = first.withColumn("_s", F.when(~F.col("_done"), drawn(TRIES)))
    found = rest.mapInArrow(search, f"{kinds}, h array<double>").filter("h is not null")
    p, q = projected(F.col("h"), F.col("x"), F.col("y"))
    each = found.select("image", "h", F.inline("_p")).withColumn("error", F.sqrt((p - F.col("u")) ** 2 + (q - F.col("v")) ** 2))
    inlier = F.col("error") <= INLIER
    error = scoring.inlier_mean(F.col("error"), inlier, LEAST, SHARE)
    return each.groupBy("image").agg(F.first("h").alias("h"), F.count("*").alias("n_points"), F.countDistinct("marker_id").alias("n_markers"), F.count_if(inlier).alias("n_inliers"), error.alias("error"))


def aligned(images: DataFrame, pages: DataFrame, known: DataFrame, fits: DataFrame, expected_markers: int) -> DataFrame:
    """image, page, h, markers, confidence, failure of every image. A page fails, in this order, without markers, with a page

    number that the template (known: page) lacks, with too few markers of its page or no homography, or with a low
    confidence. pages: as pages_of; fits: as homographies. A marker that was seen twice counts once.
    """
    rows = images.select("image").distinct().join(pages, "image", "left")
    rows = rows.join(F.broadcast(known.select("page", F.lit(True).alias("_known")).distinct()), "page", "left")  # a template's pages
    rows = rows.join(fits, "image", "left").withColumn("markers", F.coalesce("n_markers", F.lit(0)))
    confidence = scoring.alignment_confidence(F.col("markers"), F.lit(float(expected_markers)), F.col("error"))
    rows = rows.withColumn("confidence", F.coalesce(confidence, F.lit(0.0)))
    failure = F.when(F.col("page").isNull(), "no markers").when(F.col("_known").isNull(), F.format_string("page %d is not part of the template", "page"))
    failure = failure.when(F.col("h").isNull() | (F.col("markers") < MARKERS), "too few markers").when(F.col("confidence") < CONFIDENCE, "low confidence")
    return rows.select("image", "page", "h", "markers", "confidence", failure.alias("failure"))
