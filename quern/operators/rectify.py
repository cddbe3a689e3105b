"""Upright crops of turned pages: rows of the template joined with the runs of the photo that they cross.

A pixel of a crop takes the photo's pixel nearest to where it comes from. Along a row of the crop the photo's coordinates are
quotients of linear functions, so which columns of the row come from one row of the photo, and of these which from one of its
runs, are intervals in closed form. A crop's row is joined with the few photo rows that it crosses: no pixel is ever a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.operators.filters import united

#: Beyond any column.
FAR = 1.0e9
IDENTITY = [1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0]


def columns_between(low: Column, high: Column, c: Column, p: Column, g: Column, q: Column, at: Column) -> tuple[Column, Column]:
    """[from, to): whole u with low <= f(u) < high for f(u) = (c u + p) / (g u + q), on the side of the pole where at lies.

    There g u + q is positive and f rises or falls throughout, or is constant.
    """
    slope, here = c * q - p * g, (c * at + p) / (g * at + q)

    def reached(t: Column) -> Column:
        """Where f is t; far to one side if f doesn't get there."""
        u = (t * q - p) / F.nullif(c - t * g, F.lit(0.0))
        beyond = F.when((t > here) == (slope > 0), FAR).otherwise(-FAR)
        return F.greatest(F.lit(-FAR), F.least(F.lit(FAR), F.when(g * u + q > 0, u).otherwise(beyond)))

    inside = (here >= low) & (here < high)
    start = F.when(slope > 0, F.ceil(reached(low))).when(slope < 0, F.floor(reached(high)) + 1).when(inside, -FAR).otherwise(FAR)
    end = F.when(slope > 0, F.ceil(reached(high))).when(slope < 0, F.floor(reached(low)) + 1).when(inside, FAR).otherwise(-FAR)
    return start.cast("long"), end.cast("long")


def upright(runs: DataFrame, windows: DataFrame) -> DataFrame:
    """glyph, y, x0, x1: ink of photos (image, y, x0, x1) inside windows, in each window's own coordinates.

    windows: image, glyph, x, y, width, height in template pixels, and back: the homography from template to photo pixels, nine
    numbers (null: the photo is upright already). A window that reaches the horizon has no rows, and neither has one
    without ink.
    """
    w = windows.filter("width > 0 and height > 0").select("image", "glyph", *(F.col(n).cast("int").alias(f"_{n}") for n in ("x", "y", "width", "height")), F.coalesce("back", F.lit(IDENTITY)).alias("b"))
    b = [F.get("b", i) for i in range(9)]
    at_x, right, low = F.col("_x").cast("double"), (F.col("_x") + F.col("_width") - 1).cast("double"), (F.col("_y") + F.col("_height") - 1).cast("double")
    depth = F.array(*(b[6] * x + b[7] * y + b[8] for x in (at_x, right) for y in (F.col("_y").cast("double"), low)))
    w = w.withColumn("_s", F.when(F.array_min(depth) > 0, 1.0).when(F.array_max(depth) < 0, -1.0)).filter("_s is not null")
    w = w.withColumn("b", F.transform("b", lambda v: v * F.col("_s"))).withColumn("_v", F.explode(F.sequence(F.col("_y"), F.col("_y") + F.col("_height") - 1)))
    v = F.col("_v").cast("double")
    w = w.withColumns({"_g": b[6], "_q": b[7] * v + b[8], "_c": b[0], "_p": b[1] * v + b[2], "_d": b[3], "_r": b[4] * v + b[5]}).drop("b", "_s")
    crossed = [(F.col("_d") * u + F.col("_r")) / (F.col("_g") * u + F.col("_q")) for u in (at_x, right)]
    # One row more on either side, so that rounding here can't lose what the intervals below decide.
    first, last = F.floor(F.least(*crossed) + 0.5) - 1, F.floor(F.greatest(*crossed) + 0.5) + 1
    rows = w.withColumn("y", F.explode(F.sequence(first.cast("int"), last.cast("int"))))
    half, s = F.lit(0.5), F.col("y").cast("double")
    a, z = columns_between(s - half, s + half, F.col("_d"), F.col("_r"), F.col("_g"), F.col("_q"), at_x)
    rows = rows.withColumns({"_a": F.greatest(F.col("_x").cast("long"), a), "_z": F.least((F.col("_x") + F.col("_width")).cast("long"), z)}).filter("_a < _z")
    met = rows.join(runs.select("image", F.col("y").cast("int").alias("y"), F.col("x0").cast("double").alias("_x0"), F.col("x1").cast("double").alias("_x1")), ["image", "y"])
    a, z = columns_between(F.col("_x0") - half, F.col("_x1") - half, F.col("_c"), F.col("_p"), F.col("_g"), F.col("_q"), at_x)
    met = met.withColumns({"_a": F.greatest("_a", a), "_z": F.least("_z", z)}).filter("_a < _z")
    found = met.select(F.col("glyph").alias("image"), (F.col("_v") - F.col("_y")).alias("y"), (F.col("_a") - F.col("_x")).cast("int").alias("x0"), (F.col("_z") - F.col("_x")).cast("int").alias("x1"))
    return united(found).withColumnRenamed("image", "glyph")
