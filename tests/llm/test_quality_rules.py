import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm import quality_rules as q
from quern.llm.common import table

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    got = q.scored_documents(docs, labels)
    assert got.count() == docs.count()
    held = got.join(labels, "doc_id").filter("held_out").toPandas()
    good, bad = held[held.quality == 1].score, held[held.quality == 0].score
    auc = np.mean([(g > bad).mean() + (g == bad).mean() / 2 for g in good])
    assert auc > 0.9 and (held.predicted == held.quality).mean() > 0.9
    rules = q.learn(docs, labels)
    assert 0 < len(rules.rules) < 200


def test_column_matches_rules(spark):
    rng = np.random.default_rng(0)
    x = rng.random((600, len(q.STATS)))
    y = ((x[:, 4] > 0.6) & (x[:, 10] < 0.5)).astype(float)
    rules = q.fit_rules(x, y)
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], list(q.STATS)).select(F.struct(*q.STATS).alias("s"))
    got = np.array([r[0] for r in df.select(rules.column("s")).collect()])
    raw = np.full(600, rules.bias)
    for rule, w in rules.rules:
        holds = np.ones(600, dtype=bool)
        for name, over, cut in rule:
            v = x[:, q.STATS.index(name)]
            holds &= (v > cut) if over else (v <= cut)
        raw += w * holds
    assert np.allclose(got, 1 / (1 + np.exp(-raw)))
    assert ((got > 0.5) == y).mean() > 0.97


@pytest.mark.parametrize("labels", [[], [(1, 1), (2, 1)], [(1, None), (None, 0)]])
def test_edges(spark, labels):
    rows = [(1, "A good text.", "s"), (2, None, "s"), (2, "", "s"), (None, " \n\t", None), (5, "x" * 200_000, "t"), (5, "x" * 200_000, "t")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_bytes string")
    marks = spark.createDataFrame(labels, "doc_id long, quality int")
    got = q.scored_documents(docs, marks).collect()
    assert len(got) == 6 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    kept = q.keep_good(docs, marks)
    assert kept.columns == docs.columns and kept.count() == 6
    assert q.scored_documents(docs.limit(0), marks).count() == 0


def test_statistics_against_plain_python():
    letters = set(range(65, 91)) | set(range(97, 123))
    for text in ["A good Text. With two lines,\nand a third!\nA good Text.", "é É ü 12,5 %", "x", "##! a\n\n\n", " \n\t", "W " * 50]:
        raw, got = text.encode(), dict(zip(q.STATS, q.text_statistics(text.encode())))
        words, lines = raw.split(), raw.split(b"\n")
        n, alpha = len(raw), max(1, sum(b in letters or b > 127 for b in raw))
        signs = set(b"!\"#$%&'()*+-/:;<=>?@[\\]^_`{|}~")
        want = {"n_bytes": n, "n_words": len(words), "newlines": raw.count(b"\n") / n}
        if words:
            want |= {"word_bytes": sum(map(len, words)) / len(words), "longest": max(map(len, words)), "upper": sum(65 <= b <= 90 for b in raw) / alpha, "digits": sum(48 <= b <= 57 for b in raw) / n}
            want |= {"symbols": sum(b in signs for b in raw) / n, "stops": sum(b in b".," for b in raw) / n, "beyond_ascii": sum(b > 127 for b in raw) / n, "distinct_words": len(set(words)) / len(words)}
            want |= {"distinct_pairs": len(set(zip(words, words[1:]))) / max(1, len(words) - 1), "top_word": max(map(words.count, words)) / len(words), "symbol_ends": sum(w[-1] in signs for w in words) / len(words)}
            want |= {"capital_starts": sum(65 <= w[0] <= 90 for w in words) / len(words), "distinct_lines": len(set(lines)) / len(lines)}
        assert got == pytest.approx({**dict.fromkeys(q.STATS, 0.0), **want})


def test_paths_are_conjunctions_of_real_cuts():
    rng = np.random.default_rng(2)
    x = rng.random((500, 4))
    y = (x[:, 0] > 0.5).astype(float)
    cuts = [np.linspace(0.1, 0.9, 9) for _ in range(4)]
    paths = q._paths(x, y, cuts, rng)
    assert any(j == 0 and abs(cut - 0.5) < 1e-9 for p in paths for j, _, cut in p)
    for p in paths:
        holds = np.ones(500, dtype=bool)
        for j, over, cut in p:
            holds &= (x[:, j] > cut) == over
            assert cut in cuts[j]
        assert 1 <= len(p) <= q.DEPTH and holds.sum() >= q.LEAF


def test_lasso_meets_its_optimality_conditions():
    rng = np.random.default_rng(3)
    z = rng.normal(size=(800, 6))
    y = (rng.random(800) < 1 / (1 + np.exp(-(1.5 * z[:, 0] - z[:, 1])))).astype(float)
    for penalty in (0.02, 0.1, 10.0):
        bias, w = q._lasso(z, y, penalty, 3000)
        p = 1 / (1 + np.exp(-(bias + z @ w)))
        slope = z.T @ (p - y) / len(y)
        assert abs((p - y).mean()) < 1e-6
        for k in range(6):
            if w[k]:
                assert slope[k] == pytest.approx(-penalty * np.sign(w[k]), abs=1e-5)
            else:
                assert abs(slope[k]) <= penalty + 1e-6
        assert penalty < 10 or not w.any()
