import itertools
import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quern.llm import simhash as s
from quern.llm.components import components


def brute_print(text, size=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]
    h = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def brute_components(ids, link):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for x in range(len(ids)):
        for y in range(x):
            if link(x, y):
                a, b = sorted((find(ids[x]), find(ids[y])))
                root[b] = a
    return {i: find(i) for i in ids}


def test_whole_query_against_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(1)
    rows = []
    for g in range(12):
        base = [f"w{x}É" for x in rng.integers(0, 50, 60)]
        for _ in range(12):
            w = list(base)
            for _ in range(rng.integers(0, 3)):
                w[rng.integers(0, 60)] = f"X{rng.integers(0, 9)}"
            rows.append((len(rows), " ".join(w)))
    rows += [(900, None), (901, ""), (902, " \t\n"), (903, "one two"), (904, "ONE\x0btwo"), (905, "long " * 70000)]
    monkeypatch.setattr(s, "TRIE_LEAVES", 16)  # so that tries are cut into pieces
    got = {r.doc_id: r for r in s.simhash_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    prints = [brute_print(t) for _, t in rows]
    want = brute_components([d for d, _ in rows], lambda x, y: (prints[x] ^ prints[y]).bit_count() <= 4)
    assert {d: got[d].fingerprint for d, _ in rows} == {d: f"{p:016x}" for (d, _), p in zip(rows, prints)}
    assert {d: got[d].component_id for d in got} == want


def test_trie_pairs_are_exact(monkeypatch):
    rng = np.random.default_rng(3)
    v = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    v = np.concatenate([v, v[:20] ^ (np.uint64(1) << rng.integers(0, 63, 20).astype(np.uint64)), v[:5]])
    g = rng.integers(0, 2, len(v))
    o = np.lexsort((v, g))
    g, v = g[o], v[o]
    for most in (1 << 20, 8):
        monkeypatch.setattr(s, "PAIRS", most)  # so that pairs of nodes are taken in turns
        got = sorted((int(i), int(j)) for a, b in s._pairs(g, v, 6) for i, j in zip(a, b))
        assert got == [(x, y) for x in range(len(v)) for y in range(x + 1, len(v)) if g[x] == g[y] and int(v[x] ^ v[y]).bit_count() <= 6]


def test_components(spark):
    rng = np.random.default_rng(5)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(i, i + 1) for i in range(400, 460)] + [(500, i) for i in range(501, 560)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    ids = sorted({x for e in edges for x in e if e[0] != e[1]})
    have = set(edges)
    want = brute_components(ids, lambda x, y: (ids[x], ids[y]) in have or (ids[y], ids[x]) in have)
    assert got == want


def test_nulls_and_empty(spark):
    df = spark.createDataFrame([(None, "a b"), (None, "a b"), (4, "c d"), (4, "c d")], "doc_id long, text string")
    assert sorted((str(r.doc_id), str(r.component_id)) for r in s.simhash_components(df).collect()) == [("4", "4"), ("4", "4"), ("None", "None"), ("None", "None")]
    assert s.simhash_components(df.limit(0)).count() == 0


def test_keep_one(spark):
    base = " ".join(f"word{i}" for i in range(400))
    near = base.replace("word200 ", "other ")
    rows = [(1, base, "x"), (2, base, "y"), (3, near, "z"), (4, "something else entirely here now", None), (5, None, "n"), (None, "q r", "n"), (7, "u v w", "n"), (7, "u v w", "n"), (8, " ".join(f"word{i}" for i in range(200)), "half")]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string").withColumn("_g", F.lit(1))
    got = s.keep_one_of_each(df)
    assert got.columns == df.columns
    assert sorted((r.doc_id for r in got.collect()), key=str) == [1, 4, 5, 7, 8, None]


def grams_of(text, size=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def similar(a, b):
    return not a and not b or len(a & b) >= 0.8 * len(a | b) > 0


def test_pairs_of_equal_values_are_all_found():
    v = np.array([5, 5, 5, 7, 7], dtype=np.uint64)
    got = {(int(i), int(j)) for a, b in s._pairs(np.zeros(5, dtype=np.int64), v, 0) for i, j in zip(a, b)}
    assert got == {(0, 1), (0, 2), (1, 2), (3, 4)}


def test_keep_one_against_brute_force(spark, monkeypatch):
    """Near copies around the threshold, a passage that most texts share, short texts, chains, ties and repeats."""
    rng, rows = np.random.default_rng(7), []
    passage = " ".join(f"shared{i}" for i in range(30))
    for pair in range(150):
        words = [f"w{pair}x{x}" for x in rng.integers(0, 5000, 30 if pair % 3 == 0 else 150)]
        other = list(words)
        for at in rng.choice(len(words), rng.integers(1, 6), replace=False):
            other[at] = f"new{at}"
        more = list(other)
        more[3] = "third"
        for t in (words, other, more):
            text = " ".join(t)
            rows.append((int(rng.integers(0, 1 << 62)), f"{passage} {text}" if pair % 2 else text))
    rows += [(1 << 62, "a b c d e f g h"), ((1 << 62) + 5, "A b c d e f g h"), (11, "a b"), (12, "a  b"), (13, "b a"), (14, None), (15, ""), (16, " \n"), (None, "q r"), (None, "q r"), (None, "s t u v w x y"), (17, "long " * 70000), (18, "LONG " * 70000), (19, "x y"), (19, "z z")]
    monkeypatch.setattr(s, "TRIE_LEAVES", 24)  # so that the passage's min-hashes are refined and cut into pieces
    monkeypatch.setattr(s, "WIDE_TASKS", 50)  # so that rows with their tasks are too many to broadcast
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"fp": F.lit("x"), "_g": F.lit(1), "node": F.lit(2)})
    got = s.keep_one_of_each(df)
    assert got.columns == df.columns
    sets = [grams_of(t) for _, t in rows]
    part = brute_components(list(range(len(rows))), lambda x, y: rows[x] == rows[y] or similar(sets[x], sets[y]))
    groups = defaultdict(list)
    for i, g in part.items():
        groups[g].append(rows[i])
    want = {min(g, key=lambda r: (r[0] is None, r[0] or 0))[0] for g in groups.values()}
    found = [r.doc_id for r in got.collect()]
    near = sum(len(g) - 1 for g in groups.values())
    assert near > 100 and want <= set(found) and len(found) <= len(groups) + 0.02 * near, (len(found), len(groups), near)


@pytest.mark.parametrize("leaves", [2048, 2])
def test_recall_of_pairs_at_the_threshold(spark, monkeypatch, leaves):
    """Pairs of similarity 0.8125 whose texts all share a passage: as few are missed when all their min-hashes are crowded."""
    rng, rows, pairs = np.random.default_rng(11), [], 600
    for p in range(pairs):
        words = [f"p{p}w{i}" for i in range(183)]
        at = [30, 70, 110, 150]  # five shingles each: 20 of 179 on either side, so 159 of 199 and a little more with the passage
        other = [f"other{p}x{i}" if i in at else w for i, w in enumerate(words)]
        passage = [f"shared{i}" for i in range(11)]
        rows += [(2 * p, " ".join(passage + words)), (2 * p + 1, " ".join(passage + other))]
    a, b = grams_of(rows[0][1]), grams_of(rows[1][1])
    assert 0.8 <= len(a & b) / len(a | b) < 0.83
    monkeypatch.setattr(s, "TRIE_LEAVES", leaves)
    left = {r.doc_id for r in s.keep_one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {i for i in range(0, 2 * pairs, 2)} <= left and len(left) - pairs <= 0.012 * pairs, len(left) - pairs


def test_recall_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.orderBy("doc_id").collect()]
    by_gram, sets = defaultdict(list), [grams_of(t) for _, t in rows]
    for i, g in enumerate(sets):
        for x in g:
            by_gram[x].append(i)
    shared = defaultdict(int)
    for ids in by_gram.values():
        for x, y in itertools.combinations(ids, 2):
            shared[x, y] += 1
    link = {p for p, n in shared.items() if n >= 0.8 * (len(sets[p[0]]) + len(sets[p[1]]) - n)}
    empty = [i for i, g in enumerate(sets) if not g]
    link |= set(zip(empty, empty[1:]))
    part = brute_components(list(range(len(rows))), lambda x, y: (y, x) in link)
    copies = {rows[i][0] for i, g in part.items() if i != g}
    kept = {r.doc_id for r in s.keep_one_of_each(docs).collect()}
    assert len(copies) > 20 and len(kept & copies) <= 0.02 * len(copies)
    assert kept | copies == {d for d, _ in rows}


def test_large_and_shared_ids(spark):
    rows = [((1 << 62) + 5, "a b c d e"), ((1 << 62) + 9, "a b c d e"), (-3, "p q r s"), ((1 << 63) - 1, "p q r s"), (4, "u v w x"), (4, "k l m n o p")]
    got = s.simhash_components(spark.createDataFrame(rows, "doc_id long, text string").withColumns({"node": F.lit(1), "fp": F.lit("y"), "component": F.lit(0)})).collect()
    prints = [brute_print(t) for _, t in rows]
    assert {prints[x] ^ prints[y] for x, y in ((0, 1), (2, 3))} == {0}
    assert sorted((r.doc_id, r.component_id) for r in got) == [(-3, -3), (4, 4), (4, 4), ((1 << 62) + 5, (1 << 62) + 5), ((1 << 62) + 9, (1 << 62) + 5), ((1 << 63) - 1, -3)]
