import hashlib
import random

import pytest

from quern.llm import winnowing as w


def brute(text, k=w.K, window=w.WINDOW):
    """Kept (k-gram, position) by plain loops, with the module's hash of each k-gram."""
    if not text:
        return []
    grams = [text[i : i + k] for i in range(max(1, len(text) - k + 1))]

    def h(g):
        x = [ord(c) + 1 for c in g] + [0] * (k - len(g))
        v = 0
        for c in x:
            v = (v * w.BASE + c) % (1 << 64)
        return (v ^ (v >> 29)) * w.FINISH % (1 << 64)

    hs, out = [h(g) for g in grams], []
    for s in range(max(1, len(hs) - window + 1)):
        part = hs[s : s + window]
        best = min(part)
        at = s + max(i for i, v in enumerate(part) if v == best)
        if not out or out[-1] != (best, at):
            out.append((best, at))
    return out


def test_winnow_against_brute_force():
    rng = random.Random(4)
    texts = ["", "a", "abc" * 3, "x" * 200, *("".join(rng.choice("ab é漢\0") for _ in range(rng.randint(1, 400))) for _ in range(60))]
    for t, (h, p) in zip(texts, w.winnow(texts)):
        assert list(zip(h.tolist(), p.tolist())) == brute(t)


def test_match_guarantee():
    rng = random.Random(6)
    for _ in range(50):
        run = "".join(rng.choice("abcdef ") for _ in range(w.K + w.WINDOW - 1))
        a, b = ("".join(rng.choice("uvwxyz") for _ in range(rng.randint(0, 90))) for _ in "12")
        one, two = a + run + b, b + run + a
        (ha, pa_), (hb, pb) = w.winnow([one, two])
        off = len(b) - len(a)
        assert {(h, p + off) for h, p in zip(ha.tolist(), pa_.tolist())} & set(zip(hb.tolist(), pb.tolist()))


@pytest.mark.parametrize("parts", [1, 5])
def test_query(spark, parts):
    rng = random.Random(8)
    rows = [(i * 3, "".join(rng.choice("abcé ") for _ in range(rng.randint(0, 300)))) for i in range(60)]
    rows += [(500, None), (501, "same text " * 30), (502, "same text " * 30), (503, "q" * 150_000), (None, "none " * 20), (502, "same text " * 30)]
    got = w.edited_documents(spark.createDataFrame([(*r, "f") for r in rows], "doc_id long, text string, fingerprint string").repartition(parts)).collect()
    order = sorted(((d, t or "") for d, t in rows), key=lambda r: (-1 if r[0] is None else r[0]), reverse=True)
    want = []
    for (d, t), (_, n) in zip(order, order[1:] + order[:1]):
        half = len(t) // 2
        e = t[: len(t) - half] + n[:half]
        sets = [{h for h, _ in brute(x)} for x in (t, e, n)]
        near = [len(sets[0] & s) / len(sets[0] | s) if sets[0] | s else 1.0 for s in sets[1:]]
        want.append((d, len(t), hashlib.sha256(e.encode()).hexdigest(), "".join(f"{h:016x}" for h, _ in brute(t)), "".join(f"{h:016x}" for h, _ in brute(e)), *near, [p for _, p in brute(t)], [p for _, p in brute(e)]))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_edges(spark):
    one = spark.createDataFrame([(1, "only")], "doc_id long, text string")
    r = w.edited_documents(one).first()
    assert r.edited_sha256 == hashlib.sha256(b"onon").hexdigest() and r.near_next == 1.0
    assert w.edited_documents(one.limit(0)).count() == 0
    assert w.fingerprints(one).first().positions == [0]
