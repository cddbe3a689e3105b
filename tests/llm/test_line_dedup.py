"""The filters against sets, the index against a fresh one, and dropped lines against brute force."""

import hashlib

import numpy as np
import pytest

from quern.llm import hot_keys, line_dedup
from quern.llm.cuckoo import Cuckoo
from quern.llm.line_dedup import LineIndex

SCHEMA = "doc_id long, text string"
BLANKS = " \t\n\x0b\x0c\r"


def key(line):
    line = line.strip(BLANKS)
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line) if len(line) >= 20 else None


def brute(rows, least=3):
    """doc_id, n_lines, n_dropped, kept text; a null id is one document before all others."""
    held = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            held.setdefault(key(line), set()).add(-1 if i is None else i)
    out = []
    for i, t in rows:
        lines, me = (t or "").split("\n"), -1 if i is None else i
        kept = [x for x in lines if key(x) is None or len(held[key(x)]) < least or max(held[key(x)]) == me]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def answer(index, docs):
    return sorted(map(tuple, index.deduplicated(docs).collect()), key=str)


def long(i):
    return f"A line that several documents hold, {i}"


def corpus(n=60, seed=3):
    r = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        lines = [long(int(k)) for k in r.integers(0, 25, r.integers(0, 6))] + [f"line of document {i} alone"] * int(r.integers(0, 3)) + ["short"] * int(r.integers(0, 3))
        rows.append((i, "\n".join(r.permutation(lines).tolist())))
    return rows


EDGES = [
    (100, None), (101, ""), (102, "\n\n"), (103, long(1).upper() + "\r\n \t" + long(1) + " "), (104, "é" * 19), (105, "é" * 19), (106, "é" * 19), (107, "é" * 20), (108, "é" * 20), (109, " " + "é" * 20),
    (110, "É" * 20), (111, "É" * 20), (112, "x " * 10 + "\n" + long(2)), (112, long(2) + "\n" + long(9)), (112, long(2) + "\n" + long(9)), (None, long(2)), (None, long(7)), (None, long(7)), (113, "word " * 200_000 + "\n" + long(1)), (114, " " + "q" * 20), (115, " " + "q" * 20), (116, "q" * 20),
]


def test_filter_as_a_set():
    r = np.random.default_rng(1)
    keys = np.unique(r.integers(-(2**63), 2**63 - 1, 900))
    for bits in (8, 5):  # the second is overfull: what finds no cell is stashed
        f = Cuckoo.empty(bits)
        f.add(keys[:500])
        f.add(keys[500:])
        assert f.holds(keys).all() and (len(f.stash) > 0) == (bits == 5)
        f.drop(keys[::2])
        assert f.holds(keys[1::2]).all()
        f = Cuckoo.read(f.cells.tobytes(), f.stash.tobytes())
        f.add(keys[::2])
        f.drop(keys)
        assert not f.cells.any() and not len(f.stash)
    same = (np.arange(1, 40, dtype=np.int64) << 40) | 5  # one fingerprint, few buckets: more than two buckets hold
    f = Cuckoo.empty(2)
    f.add(same)
    assert f.holds(same).all()
    f.drop(same)
    assert not f.cells.any() and not len(f.stash)
    with pytest.raises(KeyError):
        f.drop(same[:1])


def test_few_false_positives():
    r = np.random.default_rng(2)
    f = Cuckoo.empty()
    f.add(np.unique(r.integers(-(2**63), 2**63 - 1, 100_000)))
    assert not len(f.stash) and f.holds(r.integers(-(2**63), 2**63 - 1, 200_000)).mean() < 5e-4


@pytest.mark.parametrize("rows", [corpus(), EDGES, EDGES[:1], corpus(12) + EDGES])
def test_dropped_lines(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    assert answer(LineIndex.empty(spark).added(docs), docs) == brute(rows)


def test_query_columns_and_empty_table(spark):
    rows = corpus(12) + EDGES
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as hi", "'x' as lo", "2 as n_lines", "text as kept_sha256", "3 as _d", "4 as _drop")
    got = sorted(map(tuple, line_dedup.line_deduplicated(docs).collect()), key=str)
    assert got == sorted(((i, n, d, hashlib.sha256(t.encode()).hexdigest()) for i, n, d, t in brute(rows)), key=str)
    assert line_dedup.line_deduplicated(docs.limit(0)).collect() == []


def state(index):
    return sorted(map(tuple, index.counts().collect()), key=str), sorted(map(tuple, index.pairs.collect()), key=str)


def members(index):
    """How many fingerprints the filters hold; and whether they hold all keys of counts."""
    filters = {r.shard: Cuckoo.read(bytes(r.cells), bytes(r.stash)) for r in index.filters.collect()}
    keys = np.array([(r.hi, r.lo) for r in index.counts().collect()], np.int64).reshape(-1, 2)
    known = all(filters[hi & (index.shards - 1)].holds(np.array([lo]))[0] for hi, lo in keys.tolist())
    return sum(int((f.cells != 0).sum()) + len(f.stash) for f in filters.values()), len(keys), known


def test_adding_and_deleting_is_reversible(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "KEYS", 20)  # shards grow as documents come
    docs = spark.createDataFrame(corpus() + EDGES, SCHEMA)
    part = lambda s: docs.filter(s)
    fresh = LineIndex.empty(spark).added(docs)
    index = LineIndex.empty(spark).added(part("doc_id % 3 = 0"))
    first, small = state(index), index.shards
    index = index.added(part("doc_id % 3 = 1 or doc_id is null")).added(part("doc_id % 3 = 2")).added(part("doc_id between 10 and 20"))
    assert index.shards > small and state(index) == state(fresh) and answer(index, docs) == answer(fresh, docs)
    n, keys, known = members(index)
    assert n == keys == index.keys == fresh.keys and known
    # Deleting takes back exactly what adding did, the largest holders of lines and the null ids included.
    less = index.deleted(part("doc_id % 3 = 2 or doc_id > 50 or doc_id is null").select("doc_id"))
    left = part("doc_id % 3 <> 2 and doc_id <= 50")
    assert state(less) == state(LineIndex.empty(spark).added(left)) and answer(less, left) == brute([tuple(r) for r in left.collect()])
    assert members(less)[0] == members(less)[1] == less.keys and members(less)[2]
    back = less.added(part("doc_id % 3 = 2 or doc_id > 50 or doc_id is null"))
    assert state(back) == state(fresh) and answer(back, docs) == brute(corpus() + EDGES)
    none = back.deleted(docs.select("doc_id"))
    assert state(none) == ([], []) and members(none) == (0, 0, True) and none.keys == 0
    assert state(none.added(part("doc_id % 3 = 0"))) == first
    assert state(none.deleted(docs.select("doc_id"))) == ([], [])


def test_many_frequent_keys(spark, monkeypatch):
    """Too many keys to broadcast and no filters to test with: hot keys are broadcast and the others shuffled."""
    rows = corpus() + EDGES
    docs = spark.createDataFrame(rows, SCHEMA)
    index = LineIndex.empty(spark).added(docs)
    monkeypatch.setattr(line_dedup, "BROADCAST_SHARDS", 0)
    monkeypatch.setattr(hot_keys, "small_enough", lambda *a: False)
    monkeypatch.setattr(hot_keys, "HOT_ROWS", 8)
    assert answer(index, docs) == brute(rows)
