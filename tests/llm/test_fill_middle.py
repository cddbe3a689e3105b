"""Ropes against plain strings, and examples against the rules spelled out."""

import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from quern.llm import fill_middle as fm

TEXTS = st.text(alphabet="ab \t\n\x0b\x1c é😀<PSM>", max_size=80)
PLAIN_UNIT = re.compile("[\x20\x09-\x0d]*[^\x20\x09-\x0d]+|[\x20\x09-\x0d]+")


def brute(doc_id, text, seed=42):
    units = PLAIN_UNIT.findall(text)
    h = hashlib.sha256(f"{seed}:{doc_id}".encode()).hexdigest()
    h = [int(h[i : i + 8], 16) for i in range(0, 32, 8)]
    form = "plain" if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50 else "spm" if h[3] % 100 < 80 else "psm"
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    out = {"plain": text, "psm": f"<P>{p}<S>{s}<M>{m}", "spm": f"<S>{s}<P>{p}<M>{m}"}[form]
    return len(units), form, None if form == "plain" else len(p), None if form == "plain" else len(m), out


@settings(max_examples=400, deadline=None)
@given(TEXTS, st.integers(0, 10**6))
def test_examples_and_back(text, doc_id):
    made = fm.example(text, fm.Draw.of(42, doc_id))
    assert made == brute(doc_id, text)
    assert fm.original(made[4], made[1]) == text


@settings(max_examples=200, deadline=None)
@given(TEXTS, st.data())
def test_ropes(text, data):
    r = fm.rope(text * 40)
    units = PLAIN_UNIT.findall(text * 40)
    assert (r.units, r.chars, fm.written(r)) == (len(units), len(text) * 40, text * 40)
    k = data.draw(st.integers(0, len(units)))
    a, b = fm.split(r, k)
    assert (fm.written(a), fm.written(b)) == ("".join(units[:k]), "".join(units[k:]))
    assert (a.units, b.units, a.chars + b.chars) == (k, len(units) - k, r.chars)
    c = data.draw(st.integers(0, r.chars))
    a, b = fm.split(fm.pieces(text * 40, 7), c, False)
    assert (fm.written(a), fm.written(b)) == ((text * 40)[:c], (text * 40)[c:])


def test_long_texts_and_single_leaves():
    for text in ("w " * 200_000, "x" * 2_000_000, " " * 300_000, " a" * 513, "a\n" * 1024):
        seen = set()
        for i in range(12):
            made = fm.example(text, fm.Draw.of(42, i))
            assert made == brute(i, text) and fm.original(made[4], made[1]) == text
            seen.add(made[1])
        assert "plain" in seen and len(seen) > 1
    assert fm.rope("a " * 5000).left is not None


ROWS = [(1, "one two three four"), (2, None), (3, ""), (4, "has <S> inside"), (5, "  \n "), (5, "same id, other text"), (5, "  \n "), (None, "no id at all"), (7, "A very " * 5000)]


def test_table(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string").selectExpr("*", "7 as n", "'x' as form", "text as output", "1 as prefix_chars")
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = []
    for i, t in ROWS:
        n, form, p, m, out = brute("" if i is None else i, t or "")
        want.append((i, n, form, p, m, sha(out), sha(t or "")))
    got = [tuple(r) for r in fm.middle_documents(df).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert fm.middle_documents(df.limit(0)).collect() == []
    rows = fm.restored(fm.transformed(df, rate=100, spm=0))
    assert {(r.doc_id, r.text) for r in rows.collect()} == {(i, t or "") for i, t in ROWS}
    assert {r.form for r in rows.collect()} == {"plain", "psm"}
