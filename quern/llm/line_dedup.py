"""Reversible line dedup: which lines many documents share, kept up to date as documents come and go.

The index holds three tables in the shared folder:

* pairs: every (doc_id, key) once. A key is the 128-bit hash of a stripped, lower-cased line of at least MIN_CHARS code points.
* counts: for every key the number of documents that hold it and the largest doc_id of these: exact reference counts.
* filters: one cuckoo filter a shard of keys, whose members are the keys that counts holds.

Adding documents asks the filters first: keys that they deny are new and are appended to counts without reading it; only the
others are looked up. Deleting documents takes their pairs back, lowers counts, finds the next largest doc_id where the
largest went, and takes keys that nobody holds any more out of counts and filters, so that deletion undoes addition exactly.
Rows of counts are never changed in place: newer ones (by version) take the place of older ones.

Keys are aggregated in each task before they are shuffled, so a line of a third of all documents is a row a task. Shards grow in
number with the keys; a shard's keys and its filter of 256 kB are what one task holds. When lines are dropped, documents'
pairs are tested against filters of the frequent keys, and those that pass meet the exact table.

Defined results: a null text is one empty line; rows that share a doc_id are one document, whichever rows hold the line; null
ids are one document, which comes before all others. Adding a document again adds the lines that it didn't hold. An empty
table gives no rows. Only doc_id and text are read, so other columns can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import chunks, materialise, sized_broadcast, small_batches, utf8
from quern.llm.cuckoo import KEYS, Cuckoo
from quern.llm.hot_keys import joined

#: Code points from which a line counts, and documents from which it is dropped.
MIN_CHARS, MIN_DOCS = 20, 3
BLANKS = b" \t\n\x0b\x0c\r"
#: Filters of the frequent keys are broadcast up to so many shards (of 256 kB); beyond it pairs meet the exact table at once.
BROADCAST_SHARDS = 256
_ALL = (1 << 64) - 1
FILTER = "shard long, cells binary, stash binary"
KEY = ["hi", "lo"]


def key_bytes(line: bytes) -> bytes | None:
    """The key of a line of UTF-8 text, or None if it is too short to count."""
    key = line.strip(BLANKS)
    # A code point takes four bytes at most; bytes.lower changes A-Z alone.
    if len(key) < MIN_CHARS or (len(key) < 4 * MIN_CHARS and not key.isascii() and len(key.decode()) < MIN_CHARS):
        return None
    return key.lower()


def _hashed(lines: list[bytes]) -> np.ndarray:
    """(n, 2) int64 of the keys' 128-bit hashes."""
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, lines)), ">i8").astype(np.int64).reshape(-1, 2)


def line_keys(docs: DataFrame) -> DataFrame:
    """doc_id, hi, lo: each key of each row of docs (doc_id, text) once."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            owner, keys = [], []
            for i, text in enumerate(utf8(batch.column("text"))):
                some = {k for line in text.split(b"\n") if (k := key_bytes(line)) is not None}
                owner += [i] * len(some)
                keys += some
            h = _hashed(keys)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(owner, pa.int64())), pa.array(h[:, 0].copy()), pa.array(h[:, 1].copy())], ["doc_id", *KEY])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, hi long, lo long")


def distinct_pairs(docs: DataFrame) -> DataFrame:
    """line_keys with rows that share a doc_id as one document. Only those rows' keys need a shuffle for that."""
    docs = docs.select("doc_id", "text")
    again = materialise(docs.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("doc_id").alias("_d")))
    if not again.limit(1).count():
        return line_keys(docs)
    few = sized_broadcast(again)
    return line_keys(docs.join(few, _same_id(), "left_anti")).unionByName(line_keys(docs.join(few, _same_id(), "left_semi")).distinct())


def _same_id() -> Column:
    return F.col("doc_id").eqNullSafe(F.col("_d"))


def shards_for(keys: int) -> int:
    """A power of two of shards, none of which is likely to get over KEYS of so many keys."""
    return 1 << max(0, (keys * 5 // (4 * KEYS))).bit_length()


def _sharded(keys: DataFrame, shards: int) -> DataFrame:
    return keys.withColumn("shard", F.pmod("hi", F.lit(shards)))


def _by_shard(keys: DataFrame, filters: DataFrame, shards: int, work, schema: str) -> DataFrame:
    """work(shard, keys, filter) for every shard of keys (hi, lo, ...) and filters; the filter is empty where a shard has none."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        found = Cuckoo.read(right["cells"][0].as_py(), right["stash"][0].as_py()) if right.num_rows else Cuckoo.empty()
        return work((left if left.num_rows else right)["shard"][0].as_py(), left, found)

    return _sharded(keys, shards).groupBy("shard").cogroup(filters.groupBy("shard")).applyInArrow(run, schema)


def _lows(keys: pa.Table) -> np.ndarray:
    return np.asarray(keys["lo"].to_numpy(), dtype=np.int64)


def _row(shard: int, f: Cuckoo) -> pa.Table:
    return pa.table({"shard": pa.array([shard], pa.int64()), "cells": pa.array([f.cells.tobytes()], pa.binary()), "stash": pa.array([f.stash.tobytes()], pa.binary())})


def filters_with(filters: DataFrame, keys: DataFrame, shards: int) -> DataFrame:
    """filters with distinct keys (hi, lo) that aren't members yet."""

    def add(shard: int, keys: pa.Table, f: Cuckoo) -> pa.Table:
        f.add(_lows(keys))
        return _row(shard, f)

    return _by_shard(keys.select(*KEY), filters, shards, add, FILTER)


def filters_without(filters: DataFrame, keys: DataFrame, shards: int) -> DataFrame:
    """filters without distinct keys (hi, lo) that are members."""

    def drop(shard: int, keys: pa.Table, f: Cuckoo) -> pa.Table:
        f.drop(_lows(keys))
        return _row(shard, f)

    return _by_shard(keys.select(*KEY), filters, shards, drop, FILTER)


def maybe_known(filters: DataFrame, keys: DataFrame, shards: int) -> DataFrame:
    """keys (hi, lo, refs, top) with known: false only for keys that no filter has taken in."""

    def test(shard: int, keys: pa.Table, f: Cuckoo) -> pa.Table:
        return keys.drop_columns(["shard"]).append_column("known", pa.array(f.holds(_lows(keys))))

    schema = keys.select(*KEY, "refs", "top").withColumn("known", F.lit(True)).schema
    return _by_shard(keys.select(*KEY, "refs", "top"), filters, shards, test, schema)


@dataclass(frozen=True)
class LineIndex:
    """One state of the index; adding and deleting give new states and leave this one as it is.

    pairs: doc_id, hi, lo. runs: hi, lo, refs, top, version, newest by version; refs 0: nobody holds the key any more. keys: how
    many keys somebody holds.
    """

    pairs: DataFrame
    runs: DataFrame
    filters: DataFrame
    shards: int = 1
    version: int = 0
    keys: int = 0

    @classmethod
    def empty(cls, spark: SparkSession, id_type: str = "long") -> LineIndex:
        of = lambda schema: spark.createDataFrame([], schema)
        return cls(of(f"doc_id {id_type}, hi long, lo long"), of(f"hi long, lo long, refs long, top {id_type}, version int"), of(FILTER))

    def counts(self) -> DataFrame:
        """hi, lo, refs, top: one row a key."""
        if self.version == 1:
            return self.runs.drop("version")  # the first run has each key once
        newest = self.runs.groupBy(*KEY).agg(F.max_by(F.struct("refs", "top"), "version").alias("r")).select(*KEY, "r.refs", "r.top")
        return newest.filter("refs > 0")

    def _counts_of(self, keys: DataFrame) -> DataFrame:
        """Counts of the given keys (hi, lo, distinct, materialised) alone."""
        return LineIndex(self.pairs, self.runs.join(sized_broadcast(keys.select(*KEY)), KEY, "left_semi"), self.filters, self.shards, self.version).counts()

    def _changed(self, pairs: DataFrame, run: DataFrame, filters: DataFrame, shards: int, keys: int) -> LineIndex:
        run = materialise(run.select(*KEY, "refs", "top", F.lit(self.version + 1).alias("version")))
        return LineIndex(pairs, self.runs.unionByName(run) if self.version else run, filters, shards, self.version + 1, keys)

    def _not_held(self, docs: DataFrame, new: DataFrame) -> DataFrame:
        """new without the pairs that the index holds; only documents that it knows can have any."""
        ids = sized_broadcast(materialise(docs.select(F.col("doc_id").alias("_d")).distinct()))
        held = materialise(self.pairs.join(ids, _same_id(), "left_semi"))
        if not held.limit(1).count():
            return new
        held = held.withColumnsRenamed({"doc_id": "_d", "hi": "_hi", "lo": "_lo"})
        return new.join(held, _same_id() & (F.col("hi") == F.col("_hi")) & (F.col("lo") == F.col("_lo")), "left_anti")

    def added(self, docs: DataFrame) -> LineIndex:
        """The index with docs (doc_id, text) as well."""
        new = distinct_pairs(docs)
        new = materialise(self._not_held(docs, new) if self.version else new)
        batch = materialise(new.groupBy(*KEY).agg(F.count("*").alias("refs"), F.max("doc_id").alias("top")))
        if not self.version:
            n = batch.count()
            shards = shards_for(n)
            return self._changed(new, batch, materialise(filters_with(self.filters, batch, shards)), shards, n)
        shards, filters = max(self.shards, shards_for(self.keys + batch.count())), self.filters
        if shards > self.shards:  # the exact table has all keys, so the filters can be dealt anew
            filters = materialise(filters_with(filters.limit(0), self.counts(), shards))
        tested = materialise(maybe_known(filters, batch, shards))
        maybe = materialise(tested.filter("known").drop("known"))
        held = materialise(self._counts_of(maybe))
        fresh = materialise(tested.filter("not known").drop("known").unionByName(maybe.join(held, KEY, "left_anti")))
        both = maybe.join(held.select(*KEY), KEY, "left_semi").unionByName(held)
        both = both.groupBy(*KEY).agg(F.sum("refs").alias("refs"), F.max("top").alias("top"))
        return self._changed(self.pairs.unionByName(new), fresh.unionByName(both), materialise(filters_with(filters, fresh, shards)), shards, self.keys + fresh.count())

    def deleted(self, ids: DataFrame) -> LineIndex:
        """The index without the documents that ids (doc_id) names; those that it doesn't hold change nothing."""
        out = sized_broadcast(materialise(ids.select(F.col("doc_id").alias("_d")).distinct()))
        gone = self.pairs.join(out, _same_id(), "left_semi")
        left = materialise(self.pairs.join(out, _same_id(), "left_anti"))
        minus = materialise(gone.groupBy(*KEY).agg(F.count("*").alias("n")))
        held = materialise(self._counts_of(minus))
        tops = joined(left, held.drop("top"), KEY, "refs").groupBy(*KEY).agg(F.max("doc_id").alias("top"))
        run = held.drop("top").join(minus, KEY).join(tops, KEY, "left").select(*KEY, (F.col("refs") - F.col("n")).alias("refs"), "top")
        run = materialise(run)
        free = run.filter("refs = 0")
        return self._changed(left, run, materialise(filters_without(self.filters, free, self.shards)), self.shards, self.keys - free.count())

    def _maybe_in(self, often: DataFrame) -> DataFrame:
        """The pairs whose key may be in often (hi, lo; materialised): all of these, and few others."""
        shards = shards_for(often.count())
        if shards > BROADCAST_SHARDS:
            return self.pairs
        rows = filters_with(self.filters.limit(0), often, shards).collect()
        sent = self.pairs.sparkSession.sparkContext.broadcast({r["shard"]: (bytes(r["cells"]), bytes(r["stash"])) for r in rows})

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found = {shard: Cuckoo.read(*f) for shard, f in sent.value.items()}
            for batch in batches:
                hi, lo = (np.asarray(batch.column(c).to_numpy(), dtype=np.int64) for c in KEY)
                shard, some = hi & (shards - 1), np.zeros(len(hi), bool)
                for s in np.unique(shard).tolist():
                    if s in found:
                        mine = np.flatnonzero(shard == s)
                        some[mine] = found[s].holds(lo[mine])
                yield batch.filter(pa.array(some))

        return self.pairs.mapInArrow(run, self.pairs.schema)

    def drops(self, least: int = MIN_DOCS) -> DataFrame:
        """doc_id, hi, lo: lines that at least so many documents hold, in all of these but the one with the largest doc_id."""
        often = materialise(self.counts().filter(F.col("refs") >= least))
        found = joined(self._maybe_in(often), often, KEY, "refs")
        return found.filter(~F.col("doc_id").eqNullSafe(F.col("top"))).select("doc_id", *KEY)

    def deduplicated(self, docs: DataFrame, least: int = MIN_DOCS) -> DataFrame:
        """doc_id, n_lines, n_dropped, text of docs (doc_id, text), all of them in the index, without the lines that are dropped."""
        lists = self.drops(least).groupBy(F.col("doc_id").alias("_d")).agg(F.collect_list(F.struct(*KEY)).alias("_drop"))
        rows = docs.select("doc_id", "text").join(lists, _same_id(), "left").select("doc_id", "text", "_drop")
        small_batches(docs.sparkSession)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in chunks(batches):
                n, dropped, texts = [], [], []
                for text, drop in zip(utf8(batch.column("text")), batch.column("_drop").to_pylist()):
                    lines = text.split(b"\n")
                    if drop:
                        out = {(d["hi"] & _ALL) << 64 | d["lo"] & _ALL for d in drop}
                        kept = [x for x in lines if (k := key_bytes(x)) is None or xxhash.xxh3_128_intdigest(k) not in out]
                        text = b"\n".join(kept)
                    n.append(len(lines))
                    dropped.append(len(lines) - len(kept) if drop else 0)
                    texts.append(text)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(dropped, pa.int64()), pa.array(texts, pa.binary()).cast(pa.string())], ["doc_id", "n_lines", "n_dropped", "text"])

        kind = docs.schema["doc_id"].dataType.simpleString()
        return rows.mapInArrow(run, f"doc_id {kind}, n_lines long, n_dropped long, text string")


def line_deduplicated(docs: DataFrame) -> DataFrame:
    """A row per document: doc_id, n_lines, n_dropped, kept_sha256, by an index of all of docs."""
    docs = docs.select("doc_id", "text")
    index = LineIndex.empty(docs.sparkSession, docs.schema["doc_id"].dataType.simpleString()).added(docs)
    return index.deduplicated(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))
