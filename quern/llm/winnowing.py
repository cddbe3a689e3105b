"""Document fingerprints by winnowing.

A text's k-grams of code points get rolling hashes; of every WINDOW neighbouring k-grams the smallest hash is kept, the
rightmost of equal ones, with its position. So any two texts that share a run of K + WINDOW - 1 code points share a kept
hash at matching positions (the match guarantee).

Defined results: null text counts as empty and keeps nothing; a text shorter than K is one k-gram (padded), one with fewer
than WINDOW k-grams is one window; two empty sets are alike (1.0); null doc_ids come last in descending order; rows of
equal doc_id are ordered by their texts' hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import bounds_of, part_of, shuffle_parts, small_batches

#: Code points of a k-gram (a power of two) and k-grams of a window.
K, WINDOW = 16, 32
#: Odd multipliers of the rolling hash and of its finish.
BASE, FINISH = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
#: Code points that a task holds as arrays at a time.
CHUNK_CHARS = 500_000


def winnow(texts: list[str], k: int = K, window: int = WINDOW) -> list[tuple[np.ndarray, np.ndarray]]:
    """(hashes, positions) kept of each text, in order of position. All texts are hashed side by side, with gaps."""
    gap = k + window
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    first = np.cumsum(sizes + gap) - sizes - gap
    x = np.frombuffer(("\0" * gap).join([*texts, ""]).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    x = np.concatenate([x, np.zeros(gap, dtype=np.uint64)])
    real = np.zeros(len(x) + 1, dtype=np.int8)
    np.add.at(real, first, 1)
    np.add.at(real, first + sizes, -1)
    h = np.where(np.cumsum(real[:-1]) > 0, x + np.uint64(1), np.uint64(0))
    width, power = 1, BASE
    while width < k:
        h = h[:-width] * np.uint64(power) + h[width:]
        power, width = power * power % (1 << 64), width * 2
    h = (h ^ (h >> np.uint64(29))) * np.uint64(FINISH)
    grams = np.where(sizes > 0, np.maximum(sizes - k + 1, 1), 0)
    key = np.full(len(h) + window, np.iinfo(np.uint64).max, dtype=np.uint64)
    at = np.repeat(first - np.cumsum(grams) + grams, grams) + np.arange(grams.sum())
    key[at] = h[at]
    span, place = 1, np.arange(len(key))
    while span < window:
        step = min(span, window - span)
        right = key[step:] <= key[:-step]  # of equal ones, the one further right
        key, place = np.where(right, key[step:], key[:-step]), np.where(right, place[step:], place[:-step])
        span += step
    windows = np.where(grams > 0, np.maximum(grams - window + 1, 1), 0)
    starts = np.repeat(first - np.cumsum(windows) + windows, windows) + np.arange(windows.sum())
    owner, kept = np.repeat(np.arange(len(texts)), windows), place[starts]
    new = np.ones(len(kept), dtype=bool)
    new[1:] = (kept[1:] != kept[:-1]) | (owner[1:] != owner[:-1])
    owner, kept = owner[new], kept[new]
    hashes, places = h[kept], kept - first[owner]
    cuts = np.searchsorted(owner, np.arange(len(texts) + 1))
    return [(hashes[a:b], places[a:b]) for a, b in zip(cuts, cuts[1:])]


def likeness(a: set, b: set) -> float:
    """Jaccard index of kept hashes; 1 for two empty sets."""
    both = len(a & b)
    return both / (len(a) + len(b) - both) if a or b else 1.0


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, hashes and positions of every row of docs (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column("doc_id").to_pylist(), [t or "" for t in batch.column("text").to_pylist()]
            for a, b in _runs(texts):
                kept = winnow(texts[a:b])
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array(ids[a:b], pa.int64()), "hashes": pa.array([h.view(np.int64) for h, _ in kept], pa.list_(pa.int64())), "positions": pa.array([p for _, p in kept], pa.list_(pa.int64()))})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, hashes array<long>, positions array<long>")


def _runs(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Runs of about CHUNK_CHARS; a longer text stays whole."""
    start, total = 0, 0
    for i, t in enumerate(texts):
        if total and total + len(t) > CHUNK_CHARS:
            yield start, i
            start, total = i, 0
        total += len(t) + K + WINDOW
    if start < len(texts):
        yield start, len(texts)


def edited_documents(docs: DataFrame) -> DataFrame:
    """Each row's fingerprint beside that of its edited text: its second half replaced by the next row's beginning.

    Next is by descending doc_id, and the first after the last. Rows are dealt out in ranges of doc_id; each range also
    gets the first row of the range after it, so texts are shuffled once and no task sees more than its range.
    positions and edited_positions tell where each hash of the fingerprints was kept, for the match guarantee.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    bounds = bounds_of(docs, "doc_id", shuffle_parts(spark))
    rows = docs.withColumns({"part": part_of("doc_id", bounds), "h": F.xxhash64("text")})
    # A null id sorts below all others.
    top = F.max(F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "h")).alias("top")
    tops = {r["part"]: r["top"] for r in rows.groupBy("part").agg(top).collect()}  # a row per range
    order = sorted(tops, reverse=True)
    after = [(tops[p]["doc_id"], tops[p]["h"], order[i - 1]) for i, p in enumerate(order)]
    extra = F.broadcast(spark.createDataFrame(after, "_d long, _h long, _to int"))
    known = [d for d, _, _ in after if d is not None]
    ends = rows.filter(F.col("doc_id").isin(known) | F.col("doc_id").isNull()) if known else rows
    ends = ends.join(extra, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("h") == F.col("_h"))).select("doc_id", "text", F.col("_to").alias("part"), "h", F.lit(1).alias("extra"))
    dealt = rows.select("doc_id", "text", "part", "h", F.lit(0).alias("extra")).unionByName(ends)
    dealt = dealt.repartitionById(len(bounds) + 1, "part").sortWithinPartitions("part", "extra", F.desc_nulls_last("doc_id"), F.desc("h"))

    def made(ids: list, texts: list[str]) -> pa.RecordBatch:
        """Of all but the last, which is only the next of the one before."""
        edited = []
        for t, after in zip(texts, texts[1:]):
            half = len(t) // 2
            edited.append(t[: len(t) - half] + after[:half])
        own, new = winnow(texts), winnow(edited)
        sets, new_sets = [set(h.tolist()) for h, _ in own], [set(h.tolist()) for h, _ in new]
        n = len(edited)
        return pa.RecordBatch.from_pydict(
            {
                "doc_id": pa.array(ids[:n], pa.int64()),
                "n_chars": pa.array([len(t) for t in texts[:n]], pa.int64()),
                "edited_sha256": [hashlib.sha256(t.encode()).hexdigest() for t in edited],
                "fingerprint": [h.astype(">u8").tobytes().hex() for h, _ in own[:n]],
                "edited_fingerprint": [h.astype(">u8").tobytes().hex() for h, _ in new],
                "near_edited": [likeness(a, b) for a, b in zip(sets, new_sets)],
                "near_next": [likeness(a, b) for a, b in zip(sets, sets[1:])],
                "positions": pa.array([p.astype(np.int32) for _, p in own[:n]], pa.list_(pa.int32())),
                "edited_positions": pa.array([p.astype(np.int32) for _, p in new], pa.list_(pa.int32())),
            }
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, ids, texts, size, done = None, [], [], 0, False
        for batch in batches:
            cols = [batch.column(c) for c in ("part", "extra", "doc_id", "text")]
            for i in range(batch.num_rows):
                p, more, d, t = (c[i].as_py() for c in cols)
                if p != part:
                    part, ids, texts, size, done = p, [], [], 0, False
                if done:  # repeated rows of the next range's first
                    continue
                ids.append(d)
                texts.append(t)
                size += len(t)
                if len(texts) > 1 and (more or size > CHUNK_CHARS):
                    yield made(ids, texts)
                    ids, texts, size = ids[-1:], texts[-1:], len(texts[-1])
                done = bool(more)

    return dealt.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, positions array<int>, edited_positions array<int>")
