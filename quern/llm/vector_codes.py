"""Vector code compression: product quantisation in whole numbers, so that reruns on any cluster agree to the last digit.

A vector's components become integers floor(scale * x) and are cut into parts of equal length; every part position has a
codebook of at most 256 integer entries, and a vector is kept as one entry number a part.

1. The codebooks start as the parts of the vectors with the smallest ids.
2. Each round, Arrow batches assign every part to its nearest entry: |a|^2 - 2ab + |b|^2 by exact int64 matrix products, the
   first of equal distances. Each task adds up what its parts give to every entry; a grouped shuffle merges these sums, which
   are a few rows a task however many vectors there are, and the driver divides them (entries x dimensions numbers).
3. The codebooks are broadcast: parts x entries x part length integers, 32 kB for 64 dimensions.

Defined results: vectors that are null or hold nulls, NaN or infinities are left out, and so are those whose length isn't the
one that most others have (the shorter of equally frequent ones) or can't be cut into the parts. Integers beyond what exact sums allow (2^27 at 64 dimensions)
are set to that limit. Rows may repeat; of equal ids the smaller vector comes first when the codebooks start, null ids come
last. Fewer vectors than entries give smaller codebooks; an empty table gives empty results.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import materialise, small_batches
from quern.llm.hot_keys import joined_totals

#: Parts of a vector, entries of a codebook, rounds of assignment, and the scale before rounding down.
PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Vectors that a task works on at a time; distances of one part take rows x entries x 8 bytes.
ROWS = 8192


@dataclass(frozen=True)
class Codebooks:
    """entries: int64 of shape (parts, entries, part length)."""

    entries: np.ndarray
    scale: int

    @property
    def limit(self) -> int:
        return most_exact(self.entries.shape[0] * self.entries.shape[2])

    def digest(self) -> str:
        """sha256 of all numbers by part, entry and position, comma-joined."""
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def most_exact(dimensions: int) -> int:
    """The largest absolute value of components for which squared distances of whole vectors stay exact in int64."""
    return math.isqrt((2**63 - 1) // (4 * max(1, dimensions)))


def whole(vector: Column) -> Column:
    """Whether all components are there and finite."""
    return vector.isNotNull() & F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False)))


def kept_vectors(rows: DataFrame, vector: str, parts: int = PARTS) -> tuple[DataFrame, int]:
    """(rows with a usable vector, its length); the length is 0 if there are none."""
    good = rows.filter(whole(F.col(vector)))
    size = F.size(vector)
    lengths = good.groupBy(size.alias("n")).agg(F.count("*").alias("rows")).filter(f"n > 0 and n % {parts} = 0")
    top = lengths.agg(F.max_by("n", F.struct("rows", -F.col("n")))).first()[0] or 0  # one row
    return good.filter(size == top), top


def integers(column: pa.Array, dimensions: int, scale: int) -> np.ndarray:
    """Integer components (rows, dimensions) of a list column without nulls."""
    flat = np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype=np.float64)
    most = most_exact(dimensions)
    return np.clip(np.floor(flat * scale), -most, most).astype(np.int64).reshape(-1, dimensions)


def nearest(values: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(numbers, squared distances) of the nearest entries of one codebook to the rows of values; the first among equals."""
    apart = (values * values).sum(axis=1)[:, None] - 2 * (values @ entries.T) + (entries * entries).sum(axis=1)[None, :]
    found = apart.argmin(axis=1)
    return found, apart[np.arange(len(values)), found]


def _blocks(batches: Iterator[pa.RecordBatch], vector: str, dimensions: int, scale: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            yield part, integers(part.column(vector), dimensions, scale)


def _sums(rows: DataFrame, vector: str, books: Codebooks) -> DataFrame:
    """part, entry, n, s0 ... : how many parts each entry got and their component sums."""
    spark, (parts, k, length), scale = rows.sparkSession, books.entries.shape, books.scale
    sent = spark.sparkContext.broadcast(books.entries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries, n, sums = sent.value, np.zeros((parts, k), np.int64), np.zeros((parts, k, length), np.int64)
        for _, values in _blocks(batches, vector, parts * length, scale):
            for p in range(parts):
                part = values[:, p * length : (p + 1) * length]
                found, _ = nearest(part, entries[p])
                n[p] += np.bincount(found, minlength=k)
                order = np.argsort(found, kind="stable")
                first = np.flatnonzero(np.diff(found[order], prepend=-1))
                sums[p, found[order][first]] += np.add.reduceat(part[order], first, axis=0)
        p, e = np.nonzero(n)
        if len(p):
            yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(n[p, e]), *(pa.array(sums[p, e, i]) for i in range(length))], ["part", "entry", "n", *(f"s{i}" for i in range(length))])

    schema = "part int, entry int, n long, " + ", ".join(f"s{i} long" for i in range(length))
    small = rows.select(vector).mapInArrow(run, schema)
    return small.groupBy("part", "entry").agg(F.sum("n").alias("n"), *(F.sum(f"s{i}").alias(f"s{i}") for i in range(length)))


def fit(rows: DataFrame, key: str, vector: str, dimensions: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> Codebooks:
    """Codebooks after rounds over all rows (key, vector); the vectors are whole and have dimensions components (kept_vectors).

    The start is collected (entries vectors), and each round's sums (parts x entries rows); both are bounded by parameters.
    """
    first = rows.select(key, vector).orderBy(F.col(key).asc_nulls_last(), vector).limit(entries).collect()
    if not first:
        return Codebooks(np.zeros((parts, 0, max(1, dimensions // parts)), np.int64), scale)
    start = integers(pa.array([r[1] for r in first]), dimensions, scale)
    books = Codebooks(np.ascontiguousarray(start.reshape(len(first), parts, -1).transpose(1, 0, 2)), scale)
    for _ in range(rounds):
        new = books.entries.copy()
        for r in _sums(rows, vector, books).collect():
            new[r["part"], r["entry"]] = [s // r["n"] for s in r[3:]]  # rounds down
        books = Codebooks(new, scale)
    return books


def encode(rows: DataFrame, vector: str, books: Codebooks, code: str = "code", error: str = "error") -> DataFrame:
    """rows with code (binary, an entry number a part) and error (squared distance of the integer vectors) in place of the vector."""
    spark, (parts, _, length), scale = rows.sparkSession, books.entries.shape, books.scale
    sent, others = spark.sparkContext.broadcast(books.entries), [c for c in rows.columns if c != vector]
    small_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries = sent.value
        for part, values in _blocks(batches, vector, parts * length, scale):
            codes, total = np.zeros((len(values), parts), np.uint8), np.zeros(len(values), np.int64)
            for p in range(parts):
                found, apart = nearest(values[:, p * length : (p + 1) * length], entries[p])
                codes[:, p], total = found, total + apart
            packed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(parts), len(codes), [None, pa.py_buffer(codes.tobytes())]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in others), packed, pa.array(total)], [*others, code, error])

    schema = rows.select(*others).withColumns({code: F.lit(None).cast("binary"), error: F.lit(None).cast("long")}).schema
    return rows.select(*others, vector).mapInArrow(run, schema)


def decode(rows: DataFrame, code: str, books: Codebooks, vector: str = "vector") -> DataFrame:
    """rows with the vector (array<double>) that each code stands for: its entries in part order, scaled back."""
    spark, (parts, k, length), scale = rows.sparkSession, books.entries.shape, books.scale
    sent, others = spark.sparkContext.broadcast(books.entries), [c for c in rows.columns if c != code]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = np.frombuffer(b"".join(batch.column(code).to_pylist()), np.uint8).reshape(-1, parts)
            values = np.concatenate([sent.value[p][codes[:, p]] for p in range(parts)], axis=1) / scale
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(codes) + 1) * values.shape[1], pa.int32()), pa.array(values.ravel()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in others), lists], [*others, vector])

    schema = rows.select(*others).withColumn(vector, F.lit(None).cast("array<double>")).schema
    return rows.select(*others, code).mapInArrow(run, schema)


def coded_vectors(rows: DataFrame) -> DataFrame:
    """A row per kept vector of rows (vec_id, embedding, label): vec_id, code (hex), error, label_error, codebooks_sha256.

    label_error adds up the errors of equal labels, null labels together. Few labels are broadcast; of many, those with a
    large share of the rows are, and the others meet by a shuffle.
    """
    rows = rows.select("vec_id", "embedding", "label")
    kept, dimensions = kept_vectors(rows, "embedding")
    books = fit(kept, "vec_id", "embedding", dimensions)
    if not books.entries.size:
        return kept.limit(0).select("vec_id", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    coded = materialise(encode(kept, "embedding", books))
    out = joined_totals(coded, ["label"], {"label_error": F.sum("error")})
    return out.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))
