"""Token ids in a compact file: canonical, length-limited Huffman codes from global counts.

Layout, all Parquet so that any executor can write and any reader prune:

* ``codebook``: one row, the code length of every id (0: unused). Lengths alone fix canonical codes.
* ``blocks``: rows in ascending doc_id order (part, block). A block is decodable alone: its payload holds byte-aligned
  documents, and ``marks`` holds the bit offset of the start of every document and of every MARK-th id in it.

Defined results: a null or empty text is the end id alone; null doc_ids come first; equal doc_ids keep all their rows,
ordered by the ids' bytes; an empty table gives no blocks.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import bounds_of, chunks, materialise, part_of, scratch, shuffle_parts, small_batches

#: Longest code: a decoding table of 2 ** MAX_BITS entries.
MAX_BITS = 16
#: Ids between two checkpoints in a document.
MARK = 256
#: Payload bytes after which a block is closed.
BLOCK_BYTES = 1 << 20
#: Words whose ids a worker keeps; beyond it the rarer ones are forgotten. Bytes of text that it encodes at a time.
CACHE_WORDS, ENCODE_BYTES = 500_000, 5_000_000
#: Words of characters that are letters before and after lowering and normalising, with stops and commas behind them.
PLAIN = re.compile("[a-zÀ-ÖØ-öø-įı-ňŋ-ž]+[.,]*").fullmatch

class _Words(dict):
    """Word -> number, given on first sight; the ids of number n are ids[starts[n] : starts[n + 1]]."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs a task on every core already
        from tokenizers import Regex, Tokenizer, pre_tokenizers

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        # The same model for plain words, which need neither normalising nor the full pattern.
        self.plain = Tokenizer(self.tokenizer.model)
        signs = pre_tokenizers.Split(Regex("[.,]+"), "isolated")
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), signs, pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.ends = np.zeros(1 << 16, dtype=bool)  # whether an id ends a piece
        self.ends[[i for piece, i in self.tokenizer.get_vocab().items() if piece.endswith("</w>")]] = True
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.new: list[bytes] = []
        self.ids, self.starts = np.zeros(0, dtype="<u2"), np.zeros(1, dtype=np.int64)
        self.used = np.zeros(0, dtype=np.int32)

    def trim(self, most: int) -> None:
        """Keeps at most most words, those met most often; their counts are halved."""
        words, used, ids, starts = list(self), self.used, self.ids, self.starts
        kept = np.flatnonzero(used > np.partition(used, -most - 1)[-most - 1])
        self.forget()
        self.update(zip((words[i] for i in kept.tolist()), range(len(kept))))
        size = (starts[1:] - starts[:-1])[kept]
        self.starts = np.concatenate([[0], np.cumsum(size)])
        self.ids = ids[np.repeat(starts[kept] - self.starts[:-1], size) + np.arange(self.starts[-1])]
        self.used = used[kept] // 2

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        self.new.append(word)
        return number

    def learn(self) -> None:
        """Encodes the words seen since the last time.

        A word of letters is one piece for the pre-tokenizer, and stops and commas behind it are another: many such words
        are encoded as one text, whose ids fall into pieces at the ids that end one. Other words are encoded one by one.
        """
        new, self.new = self.new, []  # an empty word, beside white space at a text's ends, has no ids
        texts = b"\n".join(new).decode().split("\n")
        plain = np.fromiter(map(bool, map(PLAIN, texts)), dtype=bool, count=len(texts))
        sizes, parts = np.zeros(len(texts), dtype=np.int64), []
        at = np.flatnonzero(plain)
        easy = [texts[i] for i in at.tolist()]
        coded = self.plain.encode_batch_fast([" ".join(easy[i : i + 200]).lower() for i in range(0, len(easy), 200)], add_special_tokens=False)
        ids = np.concatenate([np.zeros(0, dtype="<u2"), *(np.array(e.ids, dtype="<u2") for e in coded)])
        last = np.fromiter((s[-1] in ".," for s in easy), dtype=np.int64, count=len(easy))
        ends = np.flatnonzero(self.ends[ids]) + 1
        if len(ends) == int((1 + last).sum()):
            sizes[at] = np.diff(ends[np.cumsum(1 + last) - 1], prepend=0)
        else:
            plain[:], ids = False, ids[:0]
        rest = np.flatnonzero(~plain)
        for i in range(0, len(rest), 20_000):
            group = rest[i : i + 20_000]
            coded = self.tokenizer.encode_batch_fast([texts[j] for j in group.tolist()], add_special_tokens=False)
            parts += [e.ids for e in coded]
            sizes[group] = [len(e) for e in parts[-len(group) :]]
        starts = np.concatenate([[0], np.cumsum(sizes)])
        both = np.zeros(int(starts[-1]), dtype="<u2")
        of = np.repeat(plain, sizes)
        both[of], both[~of] = ids, np.fromiter(chain.from_iterable(parts), dtype="<u2", count=int((~of).sum()))
        self.ids = np.concatenate([self.ids, both])
        self.starts = np.concatenate([self.starts, self.starts[-1] + starts[1:]])


_STORES: dict[str, _Words] = {}


def encode_texts(texts: pa.Array, path: str, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts, each followed by end_id; how many of each text). texts: strings; null counts as empty.

    The vocabulary's normaliser lowers letters, and its pre-tokenizer never joins across white space and drops it, so a
    text's ids are those of its white-space separated words; each distinct word is encoded once per worker. Texts that
    may hold a special token, which is matched before lowering, keep their case.
    """
    store = _STORES.get(path) or _STORES.setdefault(path, _Words(path))
    if len(store) > CACHE_WORDS:
        store.trim(CACHE_WORDS // 2)
    texts = texts.fill_null("")
    words = pc.ascii_split_whitespace(pc.if_else(pc.match_substring(texts, "<|"), texts, pc.ascii_lower(texts)))
    count = words.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    coded = words.flatten().dictionary_encode()
    distinct, place = coded.dictionary.cast(pa.binary()).to_pylist(), coded.indices.to_numpy(zero_copy_only=False)
    number = np.fromiter(map(store.__getitem__, distinct), dtype=np.int64, count=len(distinct))
    if store.new:
        store.learn()
        store.used = np.concatenate([store.used, np.zeros(len(store) - len(store.used), dtype=np.int32)])
    store.used[number] += np.bincount(place, minlength=len(number)).astype(np.int32)
    size = (store.starts[number + 1] - store.starts[number]).astype(np.int32)[place]
    # A word's ids, and after a text's last word the end id: gaps of one at the texts' ends.
    upto = np.concatenate([np.zeros(1, dtype=np.int64), np.cumsum(size)])
    last = np.cumsum(count)
    n = upto[last] - upto[last - count]
    at = np.arange(upto[-1], dtype=np.int32)
    source = np.repeat((store.starts[number][place] - upto[:-1]).astype(np.int32), size) + at
    at += np.repeat(np.arange(len(n), dtype=np.int32), n)
    ids = np.full(int(upto[-1]) + len(n), end_id, dtype="<u2")
    ids[at] = store.ids[source]
    return ids, n + 1


def code_lengths(counts: np.ndarray, limit: int = MAX_BITS) -> np.ndarray:
    """Optimal code lengths of at most limit bits (package-merge); 0 where the count is 0."""
    lengths = np.zeros(len(counts), dtype=np.uint8)
    used = np.flatnonzero(counts)
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} ids don't fit codes of {limit} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    weights = counts[order].astype(np.int64)
    row, leaves = weights, [np.ones(len(weights), dtype=bool)]
    for _ in range(limit - 1):
        pairs = row[: len(row) // 2 * 2].reshape(-1, 2).sum(1)
        both = np.concatenate([weights, pairs])
        by = np.argsort(both, kind="stable")
        row = both[by]
        leaves.append(by < len(weights))
    take, times = 2 * len(weights) - 2, np.zeros(len(weights), dtype=np.int64)
    for leaf in reversed(leaves):
        n = int(leaf[:take].sum())
        times[:n] += 1
        take = 2 * (take - n)
    lengths[order] = times
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of (length, id)."""
    codes, code, last = np.zeros(len(lengths), dtype=np.uint64), 0, 0
    used = np.flatnonzero(lengths)
    order = used[np.lexsort((used, lengths[used]))]
    for n in np.unique(lengths[order]):
        same = order[lengths[order] == n]
        code <<= int(n) - last
        codes[same] = code + np.arange(len(same), dtype=np.uint64)
        code, last = code + len(same), int(n)
    return codes


def decoding_table(lengths: np.ndarray, bits: int = MAX_BITS) -> tuple[np.ndarray, np.ndarray]:
    """(id, code length) for each value of the next bits bits."""
    codes = canonical_codes(lengths)
    ids, lens = np.zeros(1 << bits, dtype=np.uint16), np.ones(1 << bits, dtype=np.uint8)
    used = np.flatnonzero(lengths)
    order = used[np.argsort(codes[used] << (bits - lengths[used]).astype(np.uint64), kind="stable")]
    span = 1 << (bits - lengths[order].astype(np.int64))
    n = int(span.sum())
    ids[:n], lens[:n] = np.repeat(order, span), np.repeat(lengths[order], span)
    return ids, lens


def pack(ids: np.ndarray, n_tokens: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray]:
    """(payload with byte-aligned documents, byte offset of each and of the end, bit start of every id in its document)."""
    size = lengths[ids].astype(np.int64)
    ends = np.cumsum(size)
    first = np.cumsum(n_tokens) - n_tokens
    before = ends - size
    doc_bits = np.add.reduceat(size, first)
    at = np.concatenate([[0], np.cumsum((doc_bits + 7) // 8)])
    inside = before - np.repeat(before[first], n_tokens)
    start = inside + np.repeat(at[:-1] * 8, n_tokens)
    word, left = start >> 5, (start & 31).astype(np.uint64)
    shifted = codes[ids] << (np.uint64(64) - size.astype(np.uint64) - left)
    n = int(at[-1] * 8 >> 5) + 2
    out = np.bincount(word, weights=(shifted >> np.uint64(32)).astype(np.float64), minlength=n)
    out += np.bincount(word + 1, weights=(shifted & np.uint64(0xFFFFFFFF)).astype(np.float64), minlength=n)[:n]
    return out.astype(">u4").tobytes()[: at[-1]], at, inside


def unpack(payload: bytes, starts: np.ndarray, counts: np.ndarray, table: tuple[np.ndarray, np.ndarray], bits: int = MAX_BITS) -> np.ndarray:
    """The ids of all runs, one run after the other: run i has counts[i] ids from bit starts[i] on. Runs advance side by side."""
    raw = np.frombuffer(payload + b"\0\0\0", dtype=np.uint8).astype(np.uint32)
    peek = (raw[:-2] << 16) | (raw[1:-1] << 8) | raw[2:]
    ids, lens = table
    order = np.argsort(-counts, kind="stable")
    bit, to = starts[order].astype(np.int64), (np.cumsum(counts) - counts)[order]
    active = np.searchsorted(-counts[order], -np.arange(counts.max(initial=0)), side="left")
    out = np.empty(int(counts.sum()), dtype=np.uint16)
    mask = np.uint32((1 << bits) - 1)
    for step, n in enumerate(active):
        b = bit[:n]
        window = (peek[b >> 3] >> (24 - bits - (b & 7)).astype(np.uint32)) & mask
        out[to[:n] + step] = ids[window]
        b += lens[window]
    return out


def encoded(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """doc_id and ids (uint16 bytes) of every row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, limit=ENCODE_BYTES):
            ids, n = encode_texts(batch.column("text"), path, end_id)
            offsets = np.concatenate([[0], 2 * np.cumsum(n)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.BinaryArray.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(offsets), pa.py_buffer(ids)])], names=["doc_id", "ids"])

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids binary")


def count_ids(coded: DataFrame) -> np.ndarray:
    """How often each id occurs in all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << 16, dtype=np.int64)
        for batch in chunks(batches, "ids"):
            total += np.bincount(np.frombuffer(b"".join(batch.column("ids").to_pylist()), dtype="<u2"), minlength=1 << 16)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"id": used.astype(np.int32), "n": total[used]})

    sums = coded.select("ids").mapInArrow(run, "id int, n long").groupBy("id").agg(F.sum("n").alias("n"))
    counts = np.zeros(1 << 16, dtype=np.int64)
    for id_, n in sums.collect():  # one row per vocabulary id at most
        counts[id_] = n
    return counts


BLOCK = "part int, block int, start_in_part long, doc_ids array<long>, n_tokens array<int>, payload binary, offsets array<int>, marks binary"


def write_token_file(docs: DataFrame, out: str, path: str, end_id: int = 2) -> None:
    """Encodes docs (doc_id, text), counts ids over all of them, and writes blocks and codebook below out in doc_id order."""
    spark = docs.sparkSession
    ids = materialise(encoded(docs, path, end_id), f"{out}/ids", "zstd")  # texts are encoded once
    lengths = code_lengths(count_ids(ids))
    book = spark.sparkContext.broadcast((lengths, canonical_codes(lengths)))  # 65,536 entries
    bounds = bounds_of(ids, "doc_id", shuffle_parts(spark))

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lens, codes = book.value
        _STORES.clear()  # all texts are encoded: the worker's memory is for codes now
        for batch in chunks(batches, "ids", 600_000):
            each = batch.column("ids").to_pylist()
            n = np.array([len(x) // 2 for x in each], dtype=np.int64)
            payload, at, inside = pack(np.frombuffer(b"".join(each), dtype="<u2"), n, codes, lens)
            first, marks = np.cumsum(n) - n, []
            for f, k in zip(first, n, strict=True):
                marks.append(inside[f : f + k : MARK].astype("<u4").tobytes())
            yield pa.RecordBatch.from_pydict(
                {
                    "part": batch.column("part"),
                    "doc_id": batch.column("doc_id"),
                    "n": n.astype(np.int32),
                    "marks": pa.array(marks, pa.binary()),
                    "payload": pa.array([payload[a:b] for a, b in zip(at, at[1:])], pa.binary()),
                }
            )

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, before, size, rows = None, 0, 0, 0, []

        def close() -> pa.RecordBatch:
            at = np.concatenate([[0], np.cumsum([len(r["payload"]) for r in rows])])
            marks = [np.frombuffer(r["marks"], dtype="<u4").astype("<u8") + int(a) * 8 for r, a in zip(rows, at)]
            one = {"part": part, "block": number, "start_in_part": before, "doc_ids": [r["doc_id"] for r in rows], "n_tokens": [r["n"] for r in rows], "payload": b"".join(r["payload"] for r in rows), "offsets": at.tolist(), "marks": np.concatenate(marks).tobytes()}
            return pa.RecordBatch.from_pylist([one], schema=SCHEMA)

        for batch in batches:
            for row in batch.to_pylist():
                if rows and (row["part"] != part or size >= BLOCK_BYTES or len(rows) >= 4096):
                    yield close()
                    number, before, size, rows = number + 1, before + sum(r["n"] for r in rows), 0, []
                if row["part"] != part:
                    part, number, before = row["part"], 0, 0
                rows.append(row)
                size += len(row["payload"])
        if rows:
            yield close()

    coded = ids.withColumn("part", part_of("doc_id", bounds)).mapInArrow(code, "part int, doc_id long, n int, marks binary, payload binary")
    placed = coded.repartitionById(len(bounds) + 1, "part").sortWithinPartitions("part", F.asc_nulls_first("doc_id"), "payload")
    placed.mapInArrow(block, BLOCK).write.parquet(f"{out}/blocks")
    spark.createDataFrame([(lengths.tolist(),)], "lengths array<int>").write.parquet(f"{out}/codebook")


SCHEMA = pa.schema(
    [
        ("part", pa.int32()),
        ("block", pa.int32()),
        ("start_in_part", pa.int64()),
        ("doc_ids", pa.list_(pa.int64())),
        ("n_tokens", pa.list_(pa.int32())),
        ("payload", pa.binary()),
        ("offsets", pa.list_(pa.int32())),
        ("marks", pa.binary()),
    ]
)


def _blocks(spark: SparkSession, out: str) -> tuple[DataFrame, dict[int, int], np.ndarray]:
    blocks = spark.read.schema(BLOCK).parquet(f"{out}/blocks")
    totals = blocks.groupBy("part").agg(F.sum(F.expr("aggregate(n_tokens, 0L, (a, x) -> a + x)")).alias("n")).collect()  # a row per part
    base, at = {}, 0
    for part, n in sorted(totals):
        base[part], at = at, at + n
    lengths = np.array(spark.read.parquet(f"{out}/codebook").first()[0], dtype=np.uint8)
    return blocks, base, lengths


def _decoded(batches: Iterator[pa.RecordBatch], table: tuple[np.ndarray, np.ndarray]) -> Iterator[tuple[dict, np.ndarray]]:
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1).to_pylist()[0]
            n = np.array(row["n_tokens"], dtype=np.int64)
            runs = (n + MARK - 1) // MARK
            counts = np.full(int(runs.sum()), MARK, dtype=np.int64)
            counts[np.cumsum(runs) - 1] = n - (runs - 1) * MARK
            yield row, unpack(row["payload"], np.frombuffer(row["marks"], dtype="<u8"), counts, table)


def read_token_file(spark: SparkSession, out: str) -> DataFrame:
    """(doc_id, start, ids) of every document in the file."""
    blocks, base, lengths = _blocks(spark, out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, ids in _decoded(batches, decoding_table(lengths)):
            n = np.array(row["n_tokens"], dtype=np.int64)
            at = np.concatenate([[0], np.cumsum(n)])
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array(row["doc_ids"], pa.int64()), "start": base[row["part"]] + row["start_in_part"] + at[:-1], "ids": pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids.astype(np.int32)))})

    return blocks.mapInArrow(run, "doc_id long, start long, ids array<int>")


def digest_token_file(spark: SparkSession, out: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the decoded ids."""
    blocks, base, lengths = _blocks(spark, out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, ids in _decoded(batches, decoding_table(lengths)):
            n = np.array(row["n_tokens"], dtype=np.int64)
            at, raw = np.concatenate([[0], np.cumsum(n)]), memoryview(ids.astype("<u4").tobytes())
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array(row["doc_ids"], pa.int64()), "start": base[row["part"]] + row["start_in_part"] + at[:-1], "n_tokens": n, "ids_crc32": np.array([zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at, at[1:])], dtype=np.int64)})

    return blocks.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_digests(docs: DataFrame, path: str, end_id: int = 2) -> DataFrame:
    """Writes the token file of docs to the shared folder and returns its digests."""
    out = scratch(docs.sparkSession)
    write_token_file(docs, out, path, end_id)
    return digest_token_file(docs.sparkSession, out)
