"""Joins of many rows with one row a key, where a few keys may hold most of the rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import materialise, small_enough

#: Rows from which a key counts as hot when the keys are too many to broadcast.
HOT_ROWS = 100_000


def _same(a: list[str], b: list[str]) -> Column:
    return reduce(lambda x, y: x & y, (F.col(p).eqNullSafe(F.col(q)) for p, q in zip(a, b)))


def joined(rows: DataFrame, table: DataFrame, keys: list[str], uses: str, how: str = "inner") -> DataFrame:
    """rows (materialised or cheap to read again) with the columns of table (materialised, one row a key; nulls are keys too).

    uses is table's column with the number of rows that a key has at most. A small table is broadcast. Of a larger one the hot
    keys are, of which there is at most one for HOT_ROWS rows; all others meet by a shuffle, in which no key is hot any more.
    """
    other = [f"_k{i}" for i in range(len(keys))]
    named = table.withColumnsRenamed(dict(zip(keys, other)))
    same = _same(keys, other)
    if small_enough(table):
        return rows.join(F.broadcast(named), same, how).drop(*other)
    hot = named.filter(F.col(uses) >= HOT_ROWS)
    known = F.broadcast(hot.select(*other))
    few = rows.join(F.broadcast(hot), same, "inner").drop(*other)
    many = rows.join(known, same, "left_anti").join(named.filter(F.coalesce(uses, F.lit(0)) < HOT_ROWS), same, how).drop(*other)
    return few.unionByName(many)


def joined_totals(rows: DataFrame, keys: list[str], totals: dict[str, Column]) -> DataFrame:
    """rows (materialised) with aggregates over all rows of the same keys; nulls are one key. Partial sums come before the shuffle."""
    table = materialise(rows.groupBy(*keys).agg(F.count("*").alias("_uses"), *(c.alias(n) for n, c in totals.items())))
    return joined(rows, table, keys, "_uses").drop("_uses")
