"""Pairs and groups of things that lie near each other."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window


def near_pairs(df: DataFrame, key: list[str], idx: str, value: str, gap: float) -> DataFrame:
    """key, a, b, distance of all pairs within less than gap: an equi-join on cells of that width, each with the next one."""
    cell = F.floor(F.col(value) / gap).cast("long")
    left = df.select(*key, F.col(idx).alias("a"), F.col(value).alias("_va"), F.explode(F.array(cell - 1, cell, cell + 1)).alias("_cell"))
    right = df.select(*key, F.col(idx).alias("b"), F.col(value).alias("_vb"), cell.alias("_cell"))
    near = left.join(right, [*key, "_cell"]).filter((F.col("a") < F.col("b")) & (F.abs(F.col("_va") - F.col("_vb")) < gap))
    return near.select(*key, "a", "b", F.abs(F.col("_va") - F.col("_vb")).alias("distance"))


def chain(df: DataFrame, key: list[str], idx: str, value: str, gap: float) -> DataFrame:
    """key, a, b of neighbours by value that lie within less than gap: they connect just what all near pairs do, with one edge a row."""
    by = Window.partitionBy(*key).orderBy(value, idx)
    rows = df.select(*key, F.col(idx).alias("b"), F.lag(idx).over(by).alias("a"), (F.col(value) - F.lag(value).over(by)).alias("_d"))
    return rows.filter(F.col("_d") < gap).select(*key, "a", "b")
