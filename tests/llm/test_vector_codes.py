"""Vector codes against plain integer arithmetic, and the cases that have a defined result."""

import math

import numpy as np
import pytest

from quern.llm import vector_codes as vc

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, parts=16, entries=64, rounds=2):
    """Codes by Python's own integers: {(vec_id, position): (code, error, label_error)} and the codebooks."""
    rows = [(i, e, x) for i, e, x in rows if e is not None and all(v is not None and math.isfinite(v) for v in e)]
    rows.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    length = len(rows[0][1]) // parts
    cut = [[tuple(math.floor(256 * v) for v in e[p * length : (p + 1) * length]) for p in range(parts)] for _, e, _ in rows]
    books = [[v[p] for v in cut[:entries]] for p in range(parts)]

    def near(v, book):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), k) for k, c in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            got = {}
            for v in cut:
                got.setdefault(near(v[p], books[p])[1], []).append(v[p])
            books[p] = [tuple(sum(c) // len(got[k]) for c in zip(*got[k])) if k in got else e for k, e in enumerate(books[p])]
    found = [[near(v[p], books[p]) for p in range(parts)] for v in cut]
    errors = [sum(d for d, _ in f) for f in found]
    totals = {}
    for (_, _, label), e in zip(rows, errors):
        totals[label] = totals.get(label, 0) + e
    return sorted(((i, "".join(f"{k:02x}" for _, k in f), e, totals[label]) for (i, _, label), f, e in zip(rows, found, errors)), key=str)


def answer(df):
    return sorted(((r.vec_id, r.code, r.error, r.label_error) for r in vc.coded_vectors(df).collect()), key=str)


@pytest.fixture(scope="module")
def vectors():
    r = np.random.default_rng(5)
    rows = [(int(i), [float(np.float32(x)) for x in r.normal(0, 0.3, 32)], [None, 1, 2][i % 3]) for i in r.permutation(150)]
    rows += [rows[0], (7, rows[3][1], 9), (None, rows[4][1], None), (200, [0.0] * 32, 1), (201, [-0.001] * 32, 1)]
    return rows + [(300, None, 1), (301, [None] + [0.0] * 31, 1), (302, [float("nan")] * 32, 1), (303, [float("inf")] * 32, 1), (304, [], 1), (305, [0.5] * 16, 1), (306, [0.5] * 33, 1)]


def test_same_as_plain_integers(spark, vectors):
    df = spark.createDataFrame(vectors, SCHEMA).repartition(5)
    usable = [r for r in vectors if r[0] is None or r[0] < 300]
    assert answer(df) == brute(usable)
    extra = df.selectExpr("*", "1 as code", "'x' as error", "label as label_error", "2 as part", "3 as entry")
    assert answer(extra) == brute(usable)


def test_few_vectors_and_none(spark, vectors):
    df = spark.createDataFrame(vectors[:3], SCHEMA)
    assert answer(df) == brute(vectors[:3])
    for none in (df.limit(0), df.selectExpr("vec_id", "cast(null as array<float>) as embedding", "label")):
        got = vc.coded_vectors(none)
        assert got.collect() == [] and got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]


def test_ties_go_to_the_first_entry():
    values, entries = np.array([[0, 0], [4, 0]]), np.array([[2, 0], [2, 0], [-2, 0]])
    assert [x.tolist() for x in vc.nearest(values, entries)] == [[0, 0], [4, 4]]


def test_large_components_stay_exact():
    most = vc.most_exact(64)
    assert 64 * (2 * most) ** 2 < 2**63 and most > 2**27
    values = np.array([[most] * 4, [-most] * 4])
    assert vc.nearest(values, -values)[1].tolist() == [0, 0]
    assert vc.nearest(values, values[:1])[1].tolist() == [0, 4 * (2 * most) ** 2]
    import pyarrow as pa

    assert vc.integers(pa.array([[3e38] * 64, [-3e38] * 64], pa.list_(pa.float32())), 64, 256)[:, 0].tolist() == [most, -most]


def test_decoded_vectors_are_near(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    kept, n = vc.kept_vectors(df, "embedding")
    books = vc.fit(kept, "vec_id", "embedding", n)
    rows = vc.decode(vc.encode(kept.withColumn("other", kept.embedding), "embedding", books), "code", books)
    for r in rows.collect():
        a = np.floor(256 * np.array(r.other, dtype=np.float64)).astype(np.int64)
        assert ((a - (np.array(r.vector) * 256).round().astype(np.int64)) ** 2).sum() == r.error


def test_totals_of_many_and_hot_labels(spark, monkeypatch):
    """Without a broadcast of all labels, hot ones are broadcast and the others shuffled: nothing changes."""
    from quern.llm import hot_keys

    rows = [(i, e, None if i % 3 else i) for i, e, _ in ((i, [i / 7.0] * 16, 0) for i in range(90))]
    df = spark.createDataFrame(rows, SCHEMA)
    want = answer(df)
    monkeypatch.setattr(hot_keys, "small_enough", lambda *a: False)
    monkeypatch.setattr(hot_keys, "HOT_ROWS", 5)
    assert answer(df) == want == brute(rows)
