"""Polygons as arrays of points: area, perimeter, convexity, simplification; and the corners of a page on a photo.

A page is the largest part of a photo that is brighter than the rest and whose outline has four corners. Measures are array
expressions; only simplification, which follows one outline, is a helper in the tasks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.operators import outlines

#: Fixed: share of the photo that a page covers at least, and of the perimeter that its outline may be simplified by.
LEAST_SHARE, TOLERANCE = 0.2, 0.02
#: Share of the photo from which an outline is the photo's own frame.
FRAME_SHARE = 0.98


def _next(p: Column, i: Column, step: int = 1) -> Column:
    return F.get(p, (i + step) % F.size(p))


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, v: a + v)


def signed_area(points: Column) -> Column:
    """The area of a closed polygon (array of x, y), positive where x turns towards y; 0 for fewer than three points."""
    return F.coalesce(_total(F.transform(points, lambda p, i: (p["x"] * _next(points, i)["y"] - _next(points, i)["x"] * p["y"]).cast("double"))) / 2, F.lit(0.0))


def perimeter(points: Column) -> Column:
    def side(p, i):
        q = _next(points, i)
        return F.sqrt(((q["x"] - p["x"]) * (q["x"] - p["x"]) + (q["y"] - p["y"]) * (q["y"] - p["y"])).cast("double"))

    return F.coalesce(_total(F.transform(points, side)), F.lit(0.0))


def convex(points: Column) -> Column:
    """Whether a polygon of three points or more turns one way at all its corners; a straight corner does no harm."""

    def turn(p, i):
        q, r = _next(points, i), _next(points, i, 2)
        return F.signum(((q["x"] - p["x"]) * (r["y"] - q["y"]) - (q["y"] - p["y"]) * (r["x"] - q["x"])).cast("double"))

    turns = F.transform(points, turn)
    return F.coalesce((F.size(points) >= 3) & ~(F.array_contains(turns, 1.0) & F.array_contains(turns, -1.0)), F.lit(False))


def _kept(p: np.ndarray, far: float) -> list[int]:
    """Places of the points that stay when none of the others is further than far from the line between its kept neighbours."""
    keep, todo = {0, len(p) - 1}, [(0, len(p) - 1)]
    while todo:
        a, b = todo.pop()
        if b - a < 2:
            continue
        d, m = p[b] - p[a], p[a + 1 : b] - p[a]
        length = np.hypot(*d)
        off = np.abs(d[0] * m[:, 1] - d[1] * m[:, 0]) / length if length else np.hypot(m[:, 0], m[:, 1])
        k = int(off.argmax())
        if off[k] > far:
            keep.add(a + 1 + k)
            todo += [(a, a + 1 + k), (a + 1 + k, b)]
    return sorted(keep)


def simplify(points: np.ndarray, far: float) -> np.ndarray:
    """A closed polygon without points that lie within far of its simpler outline. It starts at two points far apart."""
    if len(points) < 4:
        return points
    first = int(np.hypot(*(points - points.mean(axis=0)).T).argmax())
    p = np.roll(points, -first, axis=0)
    second = int(np.hypot(*(p - p[0]).T).argmax())
    out = np.concatenate([p[: second + 1][_kept(p[: second + 1], far)][:-1], np.vstack([p[second:], p[:1]])[_kept(np.vstack([p[second:], p[:1]]), far)][:-1]])
    return out


def simplified(points: Column, far: Column) -> Column:
    """simplify() of an array of points, by its own distance each."""

    @F.pandas_udf("array<struct<x:double,y:double>>")
    def shorter(points: pd.Series, far: pd.Series) -> pd.Series:
        arrays = [simplify(np.array([[q["x"], q["y"]] for q in p], float).reshape(-1, 2), f) for p, f in zip(points, far)]
        return pd.Series([[{"x": float(x), "y": float(y)} for x, y in a] for a in arrays], dtype=object)

    return shorter(points, far)


def page_corners(images: DataFrame, bright: DataFrame, least: float = LEAST_SHARE, tolerance: float = TOLERANCE) -> DataFrame:
    """image, tl, tr, br, bl (points x, y) of photos on which a page is found, for raster.page_frames.

    images: image, width, height. bright: runs (image, y, x0, x1) of what is brighter than the photo's threshold. Outlines smaller
    than least of the photo, and its own frame, aren't looked at; of those that simplify to a convex polygon of four corners, the largest is the page.
    """
    loops = outlines.outlines(bright.withColumnRenamed("image", "glyph")).select(F.col("glyph").alias("image"), F.explode(outlines.subpath_points(F.col("d"))).alias("p"))
    sized = loops.join(images.select("image", "width", "height"), "image").withColumn("area", F.abs(signed_area(F.col("p"))))
    large = sized.filter((F.col("area") >= least * F.col("width") * F.col("height")) & (F.col("area") < FRAME_SHARE * F.col("width") * F.col("height")))
    four = large.withColumn("q", simplified(F.col("p"), tolerance * perimeter(F.col("p")))).filter((F.size("q") == 4) & convex(F.col("q")))
    best = four.groupBy("image").agg(F.max_by("q", F.struct("area", "q")).alias("q"))

    def end(pick, key) -> Column:
        """The corner of least or greatest key, by x and y among equals."""
        return pick(F.transform("q", lambda p: F.struct(F.round(key(p), 2).alias("key"), p.alias("p"))))["p"]

    plus, minus = (lambda p: p["x"] + p["y"]), (lambda p: p["y"] - p["x"])
    return best.select("image", end(F.array_min, plus).alias("tl"), end(F.array_min, minus).alias("tr"), end(F.array_max, plus).alias("br"), end(F.array_max, minus).alias("bl"))
