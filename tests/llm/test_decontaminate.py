import hashlib
import re

import pytest

from quern.llm import decontaminate as d


def brute(docs, items):
    def words(t):
        t = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)

    out = []
    for doc_id, text in docs:
        w, hit, ids = words(text), set(), set()
        for item_id, t in items:
            iw = words(t)
            if not iw:
                continue
            size = min(10, len(iw))
            for s in range(len(iw) - size + 1):
                win = iw[s : s + size]
                for p in range(len(w) - size + 1):
                    if w[p : p + size] == win:
                        hit |= set(range(p, p + size))
                        ids |= {str(item_id)} - {"None"}
        out.append((doc_id, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


ITEMS = [
    (1, "The quick brown fox jumps over the lazy dog and then It runs away from ÉTÉ to the far hills"),
    (10, "a a a a a a a a a a a a a"),
    (2, "short item"),
    (3, "Solo"),
    (4, ""),
    (5, None),
    (None, "ignored item words"),
    (6, "the quick brown fox jumps over the lazy dog and then"),
    (6, "the quick brown fox jumps over the lazy dog and then"),
]
DOCS = [
    (1, "xx the QUICK brown-fox jumps over; the lazy dog and then stop"),
    (2, "the quick brown fox jumps over the lazy cat and then"),
    (3, "b " + "a " * 25 + "c"),
    (4, "a short   item, and a short item"),
    (5, None),
    (6, ""),
    (7, "solo"),
    (70, "these are ignored item words"),
    (71, "short item: ignored ITEM words"),
    (8, "then it runs away from ÉTÉ to the far hills. fox jumps over the lazy dog and then it runs"),
    (None, "a short item"),
    (9, "clean text"),
    (12, "THE QUICK brown fox jumps over the lazy dog and then it runs away from été to the far hills"),
    (13, "\u0130x A Short \u212atem item short ITEM"),
    (9, "a short item"),
    (9, "a short item"),
    (11, "w " * 40000 + "quick brown fox jumps over the lazy dog and then end"),
]


@pytest.mark.parametrize("limit", [400_000, 0])
def test_against_brute_force(spark, monkeypatch, limit):
    for bound in ("BROADCAST_SHINGLES", "BROADCAST_WINDOWS"):
        monkeypatch.setattr(d, bound, limit)
    docs = spark.createDataFrame([(*r, "x") for r in DOCS], "doc_id long, text string, shingle string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = sorted((tuple(r) for r in d.contaminated_documents(docs, items).collect()), key=str)
    assert got == brute(DOCS, ITEMS)
    kept = d.drop_contaminated(docs, items)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(x[0]) for x in got if not x[5])


def test_empty(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert all(not r.contaminated for r in d.contaminated_documents(docs, none).collect())
    assert d.contaminated_documents(docs.limit(0), spark.createDataFrame(ITEMS, "item_id long, text string")).count() == 0
