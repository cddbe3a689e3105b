import itertools
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from quern.llm import hmm_lm as h
from quern.llm.common import table

SF = "/root/testdata/sf0.01"


def random_model(rng, states=3, symbols=5):
    def norm(a, axis):
        return a / a.sum(axis, keepdims=True)

    return h.Model(norm(rng.random(states), 0), norm(rng.random((states, states)), 1), norm(rng.random((symbols, states)), 0))


def paths(m, seq):
    for p in itertools.product(range(len(m.start)), repeat=len(seq)):
        v = m.start[p[0]]
        for i, s in enumerate(seq):
            v *= m.emit[s, p[i]] * (m.move[p[i - 1], p[i]] if i else 1)
        yield p, v


def test_forward_and_counts_are_exact():
    rng = np.random.default_rng(0)
    m = random_model(rng)
    seqs = [rng.integers(0, 5, n) for n in (1, 4, 6, 2, 7, 5)]
    flat, sizes = np.concatenate(seqs), np.array([len(s) for s in seqs])
    want = [math.log(sum(v for _, v in paths(m, s))) for s in seqs]
    for span in (100, 3, 2, 1):
        assert np.allclose(h.log_likelihoods(flat, sizes, m, span), want)
    starts, moves, emissions, total = h.expected_counts(flat, sizes, m)
    a, b, c = np.zeros(3), np.zeros((3, 3)), np.zeros((5, 3))
    cut = h.expected_counts(flat, sizes, m, 3, 10)  # all that is cut off is read as lead
    for s in seqs:
        whole = sum(v for _, v in paths(m, s))
        for p, v in paths(m, s):
            a[p[0]] += v / whole
            for i, x in enumerate(s):
                c[x, p[i]] += v / whole
                if i:
                    b[p[i - 1], p[i]] += v / whole
    assert np.allclose(starts, a) and np.allclose(moves, b) and np.allclose(emissions, c) and total == pytest.approx(sum(want))
    assert all(np.allclose(x, y) for x, y in zip(cut, (a, b, c, total)))


def test_cuts_lose_no_move_and_add_no_start():
    rng = np.random.default_rng(4)
    m = random_model(rng, 4, 30)
    sizes = np.array([3000, 1, 513, 90])
    flat = rng.integers(0, 30, sizes.sum())
    whole, cut = h.expected_counts(flat, sizes, m, 10_000), h.expected_counts(flat, sizes, m)
    assert cut[0].sum() == pytest.approx(4) and cut[1].sum() == pytest.approx(sizes.sum() - 4) and cut[2].sum() == pytest.approx(sizes.sum())
    for x, y in zip(whole, cut):
        assert np.allclose(x, y, rtol=1e-6)


def test_likelihood_rises(spark, monkeypatch):
    monkeypatch.setattr(h, "ROUNDS", 5)
    monkeypatch.setattr(h, "SETTLED", 0.0)
    docs = table(spark, SF, "documents").select("doc_id", "text")
    counts = h.materialise(h.word_counts(docs))
    words, _ = h.learn_words(counts, docs.count())
    coded = h.materialise(h.coded_documents(docs, words))
    _, history = h.learn(coded, words)
    assert len(history) > 2 and all(b > a for a, b in zip(history, history[1:]))


def brute_base(rows):
    def toks(t):
        return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + [None]

    held = {d: d is not None and zlib.crc32(str(d).encode()) % 7 == 2 for d, _ in rows}
    c = Counter(x for d, t in rows if not held[d] for x in toks(t))
    n, v = sum(c.values()), len(c)
    return {(d, t): (held[d], len(toks(t)), sum(c[x] > 0 for x in toks(t)), n, sum(math.log10((c[x] + 1) / (n + v + 1)) for x in toks(t))) for d, t in rows}


def brute_score(rows, model, text, dictionary):
    """log10 of the forward recursion, word by word, with each word's share of its symbol from the counts."""
    train = [t for d, t in rows if d is None or zlib.crc32(str(d).encode()) % 7 != 2]
    words = [(t or "").translate({i: i + 32 for i in range(65, 91)}).encode().split() for t in train]
    c = Counter(w for ws in words for w in ws)
    # The dictionary is what a threshold by count lets in, so the model's own words are read off its size.
    own = len(model[0].emit) - h.CLASSES - 1
    top = sorted(c, key=lambda w: (-c[w], w))[:own]
    kinds = Counter(h.class_of(w) for w in c if w not in top)
    total = Counter()
    for w in c:
        if w not in top:
            total[h.class_of(w)] += c[w]
    m, a, log = model[0], None, 0.0
    for w in [*(text or "").translate({i: i + 32 for i in range(65, 91)}).encode().split(), None]:
        symbol, share = (own + h.CLASSES, 1.0) if w is None else (top.index(w), 1.0) if w in top else (own + h.class_of(w), (c[w] + 1) / (total[h.class_of(w)] + kinds[h.class_of(w)] + 1))
        a = m.emit[symbol] * (m.start if a is None else a @ m.move)
        log += math.log10(a.sum() * share)
        a = a / a.sum()
    return log


@pytest.mark.parametrize("dictionary", [40, 200_000, 0])
def test_query(spark, monkeypatch, dictionary):
    monkeypatch.setattr(h, "DICTIONARY", dictionary)
    monkeypatch.setattr(h, "OWN_WORDS", 20)
    rng = np.random.default_rng(1)
    rows = [(i, " ".join(f"W{int(x)}" for x in rng.zipf(1.5, rng.integers(0, 50)) % 300)) for i in range(120)]
    rows += [(500, None), (501, ""), (502, "É x\x0by\x1cz"), (None, "a b"), (503, "long w1 " * 20000)]
    real, found = h.learn, []
    monkeypatch.setattr(h, "learn", lambda *a: found.append(real(*a)[0]) or (found[0], []))
    df = spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id long, text string, score double").repartition(3)
    got = h.scored_documents(df).collect()
    want = brute_base(rows)
    assert len(got) == len(rows)
    text = dict(rows)
    for r in got:
        held, n, known, total, base = want[(r.doc_id, text[r.doc_id])]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, n, known, total)
        assert r.base_score == pytest.approx(base, rel=1e-9)
        assert r.score == pytest.approx(brute_score(rows, found, text[r.doc_id], dictionary), rel=1e-7)


def test_better_than_base(spark):
    docs = table(spark, SF, "documents")
    got = h.scored_documents(docs).toPandas()
    held = got[got.held_out]
    assert len(got) == docs.count() and held.score.sum() > held.base_score.sum()


def test_symbols():
    words = h.Words({b"a": 0, b"b": 1}, np.array([0, 1 + h.class_of(b"b")]), np.array([5, 3]), 1, np.ones(h.CLASSES), 12, 3, 4)
    flat, sizes, each = words.sequences([b"a zz", b""])
    assert flat.tolist() == [0, -1, -2, -2] and sizes.tolist() == [3, 1]
    assert words.symbols(flat, sizes, each).tolist() == [0, 1 + h.class_of(b"zz"), words.end, words.end]


def test_probabilities_sum_to_one():
    """Over all sequences of three symbols; and over the words of a class, with one share left for words never seen."""
    m = random_model(np.random.default_rng(9))
    every = np.array(list(itertools.product(range(5), repeat=3)))
    assert np.exp(h.log_likelihoods(every.reshape(-1), np.full(125, 3), m)).sum() == pytest.approx(1)
    counts = {b"a1x": 5, b"b1x": 2, b"c1x": 1}
    total = sum(counts.values()) + len(counts) + 1
    assert sum((c + 1) / total for c in counts.values()) + 1 / total == pytest.approx(1)


def test_empty(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert h.scored_documents(empty).count() == 0
