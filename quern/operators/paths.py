"""Path strings of drawings as rows: commands M, L, C, Q and Z, and the exact bounds of what they draw.

A curve's bounds are not those of its control points: along an axis it turns where its derivative is zero, which for quadratic
and cubic segments is a closed form. Commands are rows, a path's present point comes from a window, and bounds are an
aggregate. Coordinates are absolute, one segment a command.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

NUMBER = r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?"
#: Numbers that each command takes.
TAKES = {"M": 2, "L": 2, "Q": 4, "C": 6, "Z": 0}


def commands(paths: DataFrame, key: str, d: str) -> DataFrame:
    """key, pos, kind, v (numbers), x0, y0 (where it starts), x, y (where it ends) of each command.

    A command with other than its numbers stops the job; an e belongs to a number. Null and empty paths have no rows.
    """
    each = paths.select(key, F.posexplode(F.regexp_extract_all(F.col(d), F.lit("[A-DF-Za-df-z][^A-DF-Za-df-z]*"), F.lit(0))).alias("pos", "_c"))
    kind = F.substring("_c", 1, 1)
    numbers = F.transform(F.regexp_extract_all(F.substring("_c", 2, 1 << 20), F.lit(NUMBER), F.lit(0)), lambda t: t.cast("double"))
    rows = each.select(key, "pos", kind.alias("kind"), numbers.alias("v"), "_c")
    takes = F.create_map(*(F.lit(x) for pair in TAKES.items() for x in pair))
    wrong = F.coalesce(F.try_element_at(takes, F.col("kind")) != F.size("v"), F.lit(True))
    rows = rows.withColumn("kind", F.when(wrong, F.raise_error(F.concat(F.lit("not a command: "), F.col("_c"))).cast("string")).otherwise(F.col("kind")))
    by = Window.partitionBy(key).orderBy("pos")
    last = F.struct(F.get("v", F.size("v") - 2).alias("x"), F.get("v", F.size("v") - 1).alias("y"))
    begun = F.last(F.when(F.col("kind") == "M", last), ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("_end", F.when(F.col("kind") == "Z", begun).otherwise(last))
    return rows.withColumn("_start", F.lag("_end").over(by)).select(key, "pos", "kind", "v", F.col("_start.x").alias("x0"), F.col("_start.y").alias("y0"), F.col("_end.x").alias("x"), F.col("_end.y").alias("y"))


def _inside(t: Column, value) -> Column:
    """value(t) for 0 < t < 1, else null."""
    return F.when((t > 0) & (t < 1), value(t))


def quadratic_turn(a: Column, b: Column, c: Column) -> Column:
    """Where a quadratic segment from a over b to c turns along an axis; null if it doesn't inside."""
    return _inside((a - b) / F.nullif(a - 2 * b + c, F.lit(0.0)), lambda t: (1 - t) * (1 - t) * a + 2 * t * (1 - t) * b + t * t * c)


def cubic_turns(a: Column, b: Column, c: Column, d: Column) -> tuple[Column, Column]:
    """Where a cubic segment turns along an axis: two values, each null if it isn't there or outside."""
    p, q, r = d - 3 * c + 3 * b - a, 2 * (a - 2 * b + c), b - a
    flat, root = F.abs(p) < 1e-9, F.sqrt(F.when(q * q >= 4 * p * r, q * q - 4 * p * r))
    value = lambda t: (1 - t) * (1 - t) * (1 - t) * a + 3 * t * (1 - t) * (1 - t) * b + 3 * t * t * (1 - t) * c + t * t * t * d
    first = F.when(flat, -r / F.nullif(q, F.lit(0.0))).otherwise((-q - root) / (2 * F.nullif(p, F.lit(0.0))))
    return _inside(first, value), _inside(F.when(~flat, (-q + root) / (2 * F.nullif(p, F.lit(0.0)))), value)


def bounds(paths: DataFrame, key: str, d: str) -> DataFrame:
    """key, x0, y0, x1, y1: the exact bounds of each path's lines and curves; a path without commands has no row."""
    rows = commands(paths, key, d)

    def axis(start: str, end: str, at: int) -> list[Column]:
        v = [F.get("v", F.lit(at + 2 * i)) for i in range(3)]
        quad = F.when(F.col("kind") == "Q", quadratic_turn(F.col(start), v[0], v[1]))
        one, two = (F.when(F.col("kind") == "C", t) for t in cubic_turns(F.col(start), *v))
        return [F.col(end), quad, one, two]

    xs, ys = axis("x0", "x", 0), axis("y0", "y", 1)
    return rows.groupBy(key).agg(*(agg(pick(*values)).alias(name) for name, agg, pick, values in (("x0", F.min, F.least, xs), ("y0", F.min, F.least, ys), ("x1", F.max, F.greatest, xs), ("y1", F.max, F.greatest, ys))))


def path_text(points: Column) -> Column:
    """Straight closed path data of an array of points (x, y), with two decimals."""
    each = F.transform(points, lambda p: F.format_string("%.2f %.2f", p["x"].cast("double"), p["y"].cast("double")))
    return F.concat(F.lit("M "), F.array_join(each, " L "), F.lit(" Z"))
