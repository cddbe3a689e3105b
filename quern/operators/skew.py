"""The skew of pages: the convex hull of their ink, and the smallest rectangle around it.

Of a row of ink only its first and last pixel can lie on the hull, so a page gives two points a row; these are an aggregate over
runs, and the hull is walked in the image's task. The smallest rectangle lies along an edge of the hull: every edge is a row, its
rectangle an expression over the hull's points, and the best edge an aggregate.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions import geometry
from quern.operators import raster

#: Fixed: ink pixels that an angle can be estimated from.
LEAST = 50
NO_INK = "not enough ink to estimate the rotation"


def _walk(x: np.ndarray, y: np.ndarray) -> list[int]:
    """Places of the hull's corners among points sorted by x, then y; counter-clockwise where y grows upwards."""

    def half(order):
        out: list[int] = []
        for k in order:
            while len(out) > 1 and (x[out[-1]] - x[out[-2]]) * (y[k] - y[out[-2]]) - (y[out[-1]] - y[out[-2]]) * (x[k] - x[out[-2]]) <= 0:
                out.pop()
            out.append(k)
        return out

    n = len(x)
    if n < 3:
        return list(range(n))
    lower, upper = half(range(n)), half(range(n - 1, -1, -1))
    return lower[:-1] + upper[:-1]


def hulls(runs: DataFrame) -> DataFrame:
    """image, place, x, y: corners of the convex hull of each image's ink pixels, in order; points on an edge aren't corners."""
    ends = runs.groupBy("image", "y").agg(F.min("x0").alias("a"), (F.max("x1") - 1).alias("b"))
    points = ends.select("image", "y", F.explode(F.array_distinct(F.array("a", "b"))).alias("x")).select("image", F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"))

    def work(owner, x, y):
        cuts = np.flatnonzero(np.diff(owner, prepend=-1)).tolist() + [len(owner)]
        kept, place = [], []
        for a, b in zip(cuts, cuts[1:]):
            corners = _walk(x[a:b].tolist(), y[a:b].tolist())
            kept += [a + k for k in corners]
            place += range(len(corners))
        return np.array(kept, dtype=np.int64), {"place": np.array(place, dtype=np.int64)}

    return raster._per_image(points, ["x", "y"], work, "place long").select("image", "place", "x", "y")


def _extent(points: str, dx: Column, dy: Column) -> Column:
    at = F.transform(points, lambda p: p["x"] * dx + p["y"] * dy)
    return F.array_max(at) - F.array_min(at)


def smallest_rectangles(corners: DataFrame) -> DataFrame:
    """image, area, raw: the smallest rectangle around each hull (image, place, x, y) and the angle of its edge in [0, 90) degrees.

    Angles turn from x towards y. Of rectangles of one area the least skewed counts, then the one with the smaller angle.
    """
    hull = corners.groupBy("image").agg(F.array_sort(F.collect_list(F.struct("place", "x", "y"))).alias("p"))
    pairs = F.transform("p", lambda a, i: F.struct(a.alias("a"), F.get("p", (i + 1) % F.size("p")).alias("b")))
    edges = hull.select("image", "p", F.explode(pairs).alias("e"))
    dx, dy = F.col("e.b.x") - F.col("e.a.x"), F.col("e.b.y") - F.col("e.a.y")
    square = (dx * dx + dy * dy).cast("double")
    # Along and across the edge by products with (dx, dy): whole numbers until the division.
    area = F.when(square > 0, _extent("p", dx, dy) * _extent("p", -dy, dx) / square).otherwise(0.0)
    raw = F.round(F.pmod(F.degrees(F.atan2(dy.cast("double"), dx.cast("double"))), F.lit(90.0)), 6)
    found = edges.select("image", F.round(area, 6).alias("area"), F.when(raw >= 90, 0.0).otherwise(raw).alias("raw"))
    lean = F.abs(F.pmod(F.col("raw") + 45, F.lit(90.0)) - 45)
    return found.groupBy("image").agg(F.min_by(F.struct("area", "raw"), F.struct("area", F.round(lean, 6), "raw")).alias("r")).select("image", "r.area", "r.raw")


def skew(images: DataFrame, runs: DataFrame, least: int = LEAST, limit: float = 15.0) -> DataFrame:
    """image, angle, failure of every image: the rotation to undo, 0 beyond the limit; an image with less ink than least fails."""
    ink = raster.measures(runs).select("image", "ink")
    rows = images.select("image").distinct().join(ink, "image", "left").join(smallest_rectangles(hulls(runs)), "image", "left")
    poor = F.coalesce("ink", F.lit(0)) < least
    return rows.select("image", F.when(~poor, geometry.skew_angle(F.col("raw"), limit)).alias("angle"), F.when(poor, NO_INK).alias("failure"))
