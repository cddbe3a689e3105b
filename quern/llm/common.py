"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators.components import scratch
from quern.operators.components import stored as materialise

__all__ = ["chunks", "crc_mod", "fresh", "materialise", "scratch", "shuffle_parts", "sized_broadcast", "small_batches", "small_enough", "table", "utf8"]

#: Bytes of text that a worker turns into arrays at a time.
CHUNK_BYTES = 2_000_000
#: Rows up to which a narrow side (ids and numbers) is broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod(column: str, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as 0."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % n, F.lit(0)).cast("int")


def small_batches(spark: SparkSession, size: str = "4m") -> None:
    """Bounds the Arrow batches that tasks hold, in the JVM and in Python, by bytes instead of rows: texts may be long.

    It is a setting of the session, read when a plan runs, so it stays set.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.set(key, size)


def small_enough(df: DataFrame, limit: int = BROADCAST_ROWS) -> bool:
    """Whether df has at most limit rows, from counting no further than that."""
    return df.limit(limit + 1).count() <= limit


def sized_broadcast(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if its row count is under the bound, else df for a shuffled join. df should be materialised."""
    return F.broadcast(df) if small_enough(df, limit) else df


def utf8(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """The texts as UTF-8; null becomes empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def chunks(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut into runs of rows of about limit bytes of text; a longer text stays whole in a run of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.binary_length(batch.column(column)).fill_null(0).to_pylist()
        start, total = 0, 0
        for i, n in enumerate(sizes):
            if total and total + n > limit:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        yield batch.slice(start)


def bounds_of(df: DataFrame, column: str, parts: int) -> list[int]:
    """At most parts - 1 split points of an integer column that deal its rows out evenly."""
    if parts < 2:
        return []
    cuts = df.select(F.col(column).cast("double").alias("_v")).approxQuantile("_v", [i / parts for i in range(1, parts)], max(1e-4, 0.2 / parts))
    return sorted({int(x) for x in cuts})


def part_of(column: str, bounds: list[int]) -> Column:
    """The number of split points at or under the value, by binary search in one literal array. Null goes to part 0."""
    if not bounds:
        return F.lit(0)
    cuts, steps = F.lit(bounds).cast("array<long>"), [1 << i for i in reversed(range(len(bounds).bit_length()))]
    further = lambda at, step: F.when((at + step <= len(bounds)) & (F.get(cuts, at + step - 1) <= F.col(column)), at + step).otherwise(at)
    return F.aggregate(F.lit(steps).cast("array<int>"), F.lit(0), further)


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """names, each with as many underscores before it as it takes to differ from df's columns."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n = f"_{n}"
        out.append(n)
    return out
