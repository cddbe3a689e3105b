"""Neighbourhoods of pixels and runs: separable stencils, adaptive thresholds, dilation, erosion and opening.

Stencils work on pixels (image, x, y, v) by windows along x and then along y: a bounded frame of neighbours each, so a task holds
one row or column of one image at a time. Morphology works on runs alone and never goes back to pixels: a run is widened or
narrowed, dealt to the rows it reaches, and rows are united or intersected. A null value counts as blank paper (255) for its
neighbours and is no ink itself; an image without rows stays without.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

#: Fixed: side of the neighbourhood and what a pixel must be darker than its mean by.
BLOCK, DARKER = 35, 15


def gaussian(size: int) -> list[float]:
    """Weights of an odd size, adding up to 1, with the deviation that goes with that size by the usual rule."""
    sigma = 0.3 * ((size - 1) * 0.5 - 1) + 0.8
    raw = [math.exp(-((i - size // 2) ** 2) / (2 * sigma * sigma)) for i in range(size)]
    return [w / math.fsum(raw) for w in raw]


def _along(value: Column, weights: list[float], line: list[str], at: str) -> Column:
    """The weighted sum over the neighbours of each pixel on its line; beyond an end, the last pixel there counts again."""
    by = Window.partitionBy(*line).orderBy(at)
    whole = by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends, middle, total = (F.first(value).over(whole), F.last(value).over(whole)), len(weights) // 2, None
    for k, w in enumerate(weights):
        step = k - middle
        near = value if not step else F.coalesce(F.lag(value, -step).over(by), ends[0]) if step < 0 else F.coalesce(F.lead(value, step).over(by), ends[1])
        total = near * w if total is None else total + near * w
    return total


def smoothed(pixels: DataFrame, weights: list[float]) -> DataFrame:
    """pixels (image, x, y, v) with mean: v weighted by weights along x and then along y, rounded to 6 decimals. Every pixel is there."""
    across = pixels.withColumn("_across", _along(F.coalesce(F.col("v").cast("double"), F.lit(255.0)), weights, ["image", "y"], "x"))
    return across.withColumn("mean", F.round(_along(F.col("_across"), weights, ["image", "x"], "y"), 6)).drop("_across")


def adaptive_ink(pixels: DataFrame, block: int = BLOCK, darker: float = DARKER) -> DataFrame:
    """image, x, y of pixels at least darker below the weighted mean of their block x block neighbourhood: ink under uneven light."""
    return smoothed(pixels, gaussian(block)).filter(F.col("v") <= F.col("mean") - darker).select("image", "x", "y")


def united(runs: DataFrame) -> DataFrame:
    """Runs (image, y, x0, x1) of a row that touch or overlap as one."""
    by = Window.partitionBy("image", "y").orderBy("x0", "x1")
    reach = F.max("x1").over(by.rowsBetween(Window.unboundedPreceding, -1))
    r = runs.withColumn("_new", F.coalesce((F.col("x0") > reach).cast("int"), F.lit(0)))
    r = r.withColumn("_g", F.sum("_new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return r.groupBy("image", "y", "_g").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1")).drop("_g")


def _reaching(runs: DataFrame, sizes: DataFrame, ry: int) -> DataFrame:
    """runs with width and height, once for each row within ry of theirs that the image has (y)."""
    rows = runs.join(sizes.select("image", "width", "height"), "image")
    low, high = F.greatest(F.lit(0), F.col("y") - ry), F.least(F.col("height") - 1, F.col("y") + ry)
    return rows.filter("y >= 0 and y < height").withColumn("y", F.explode(F.sequence(low.cast("int"), high.cast("int"))))


def dilated(runs: DataFrame, sizes: DataFrame, rx: int, ry: int) -> DataFrame:
    """Ink within rx columns and ry rows of ink. sizes: image, width, height; nothing is drawn beyond them."""
    wide = _reaching(runs, sizes, ry)
    return united(wide.select("image", "y", F.greatest(F.lit(0), F.col("x0") - rx).alias("x0"), F.least("width", F.col("x1") + rx).alias("x1")))


def eroded(runs: DataFrame, sizes: DataFrame, rx: int, ry: int) -> DataFrame:
    """Ink all of whose neighbours within rx columns and ry rows, as far as the image goes, are ink. runs: united in each row.

    A row's narrowed runs say where that row allows ink; a pixel stays where as many rows allow it as there are.
    """
    left = F.when(F.col("x0") <= 0, F.col("x0")).otherwise(F.col("x0") + rx)
    right = F.when(F.col("x1") >= F.col("width"), F.col("x1")).otherwise(F.col("x1") - rx)
    narrow = _reaching(runs, sizes, ry).withColumns({"_a": left, "_b": right}).filter("_b > _a")
    need = F.least(F.col("height") - 1, F.col("y") + ry) - F.greatest(F.lit(0), F.col("y") - ry) + 1
    ends = F.array(F.struct(F.col("_a").alias("x"), F.lit(1).alias("step")), F.struct(F.col("_b").alias("x"), F.lit(-1).alias("step")))
    steps = narrow.select("image", "y", need.alias("need"), F.explode(ends).alias("e")).groupBy("image", "y", "need", F.col("e.x").alias("x")).agg(F.sum("e.step").alias("step"))
    by = Window.partitionBy("image", "y").orderBy("x")
    depth = steps.withColumns({"_d": F.sum("step").over(by.rowsBetween(Window.unboundedPreceding, 0)), "x1": F.lead("x").over(by)})
    return united(depth.filter("_d = need and x1 is not null").select("image", "y", F.col("x").alias("x0"), "x1"))


def opened(runs: DataFrame, sizes: DataFrame, rx: int, ry: int) -> DataFrame:
    """Ink without what is narrower than the neighbourhood: erosion, then dilation."""
    return dilated(eroded(runs, sizes, rx, ry), sizes, rx, ry)
