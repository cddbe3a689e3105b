"""Fill-in-the-middle examples on ropes: trees whose leaves are pieces of a text.

Every node caches how many units (a word with the blanks before it) and code points lie under it, so a text is split at a unit
rank by one walk down, which cuts at most one leaf, and pieces are concatenated without copying texts. A document is split
at two unit ranks, its three subtrees are put in a new order behind sentinels, and the whole is written once. The way
back takes the text and its form alone: sentinels are looked up, a rope of the text is split at their code-point ranks, and the
subtrees are put back in order.

Defined results: a null text is empty; an empty text, one that holds a sentinel, and those that the draw leaves alone are
plain, which is the text itself. Draws depend on doc_id and the seed only: rows that share a doc_id share their
draws, a null doc_id draws as an empty one. Extra columns of the input aren't carried along, so names can't clash.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import chunks, small_batches

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED, RATE, SPM = 42, 50, 80
#: Units in a leaf; a leaf is the most text that a split has to look through.
LEAF = 512
UNIT = re.compile(r"[ \t-\r]*+[^ \t-\r]++|[ \t-\r]++")
#: Up to LEAF units with words; only the end of a text may have blanks without a word.
WORDS = re.compile(rf"(?:[ \t-\r]*+[^ \t-\r]++){{1,{LEAF}}}+")


@dataclass(frozen=True, slots=True)
class Rope:
    """A leaf has text; an inner node has left and right."""

    units: int
    chars: int
    text: str = ""
    left: Rope | None = None
    right: Rope | None = None


EMPTY = Rope(0, 0)


def leaf(text: str, units: int) -> Rope:
    return Rope(units, len(text), text) if text else EMPTY


def concat(a: Rope, b: Rope) -> Rope:
    if not a.chars:
        return b
    if not b.chars:
        return a
    return Rope(a.units + b.units, a.chars + b.chars, "", a, b)


def balanced(leaves: list[Rope]) -> Rope:
    """The leaves as a tree of least depth."""
    while len(leaves) > 1:
        leaves = [concat(leaves[i], leaves[i + 1]) if i + 1 < len(leaves) else leaves[i] for i in range(0, len(leaves), 2)]
    return leaves[0] if leaves else EMPTY


def rope(text: str) -> Rope:
    """A text in leaves of at most LEAF units. Units tile the text, so leaves can be cut one after another."""
    cut, at = [], 0
    while found := WORDS.match(text, at):
        cut.append(found.group())
        at = found.end()
    # All pieces but the last are full.
    leaves = [leaf(t, LEAF) for t in cut[:-1]] + [leaf(t, len(UNIT.findall(t))) for t in cut[-1:]]
    if at < len(text):
        leaves.append(leaf(text[at:], 1))
    return balanced(leaves)


def pieces(text: str, size: int = 8192) -> Rope:
    """A text in leaves of at most size code points, for splits by code points; its units aren't counted."""
    return balanced([leaf(text[i : i + size], 0) for i in range(0, len(text), size)])


def _cut(r: Rope, rank: int, by_units: bool) -> tuple[Rope, Rope]:
    if not by_units:
        return leaf(r.text[:rank], 0), leaf(r.text[rank:], 0)
    at = 0
    for _ in range(rank):
        at = UNIT.match(r.text, at).end()
    return leaf(r.text[:at], rank), leaf(r.text[at:], r.units - rank)


def split(r: Rope, rank: int, by_units: bool = True) -> tuple[Rope, Rope]:
    """The first rank units (or code points) of a rope, and the rest."""
    if rank <= 0:
        return EMPTY, r
    if rank >= (r.units if by_units else r.chars):
        return r, EMPTY
    if r.left is None:
        return _cut(r, rank, by_units)
    before = r.left.units if by_units else r.left.chars
    if rank <= before:
        a, b = split(r.left, rank, by_units)
        return a, concat(b, r.right)
    a, b = split(r.right, rank - before, by_units)
    return concat(r.left, a), b


def written(r: Rope) -> str:
    """The text of a rope, leaf by leaf."""
    out, todo = [], [r]
    while todo:
        node = todo.pop()
        if node.left is None:
            out.append(node.text)
        else:
            todo += (node.right, node.left)
    return "".join(out)


@dataclass(frozen=True)
class Draw:
    """What a document's id decides: h1 to h4 of the sha256 of seed:id."""

    h: tuple[int, ...]

    @classmethod
    def of(cls, seed: int, doc_id: object) -> Draw:
        digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
        return cls(tuple(int(digest[i : i + 8], 16) for i in range(0, 32, 8)))

    def form(self, rate: int, spm: int) -> str:
        return "plain" if self.h[2] % 100 >= rate else "spm" if self.h[3] % 100 < spm else "psm"

    def ranks(self, units: int) -> tuple[int, int]:
        a, b = self.h[0] % (units + 1), self.h[1] % (units + 1)
        return min(a, b), max(a, b)


def arranged(prefix: Rope, middle: Rope, suffix: Rope, form: str) -> Rope:
    p, s, m = (leaf(x, 0) for x in (PREFIX, SUFFIX, MIDDLE))
    order = (p, prefix, s, suffix, m, middle) if form == "psm" else (s, suffix, p, prefix, m, middle)
    out = EMPTY
    for r in order:
        out = concat(out, r)
    return out


def example(text: str, draw: Draw, rate: int = RATE, spm: int = SPM) -> tuple[int, str, int | None, int | None, str]:
    """(units, form, code points of prefix and of middle, output) of one text."""
    whole = rope(text)
    form = draw.form(rate, spm)
    if not text or form == "plain" or any(x in text for x in (PREFIX, SUFFIX, MIDDLE)):
        return whole.units, "plain", None, None, text
    first, second = draw.ranks(whole.units)
    before, suffix = split(whole, second)
    prefix, middle = split(before, first)
    return whole.units, form, prefix.chars, middle.chars, written(arranged(prefix, middle, suffix, form))


def original(output: str, form: str) -> str:
    """The text that example made output from. Sentinels occur once: no text with one was rearranged."""
    if form == "plain":
        return output
    whole = pieces(output)
    head, second = (PREFIX, SUFFIX) if form == "psm" else (SUFFIX, PREFIX)
    i, j = output.index(second), output.index(MIDDLE)
    rest, tail = split(whole, j, False)
    one, two = split(rest, i, False)
    one, two, middle = (split(r, len(x), False)[1] for r, x in ((one, head), (two, second), (tail, MIDDLE)))
    prefix, suffix = (one, two) if form == "psm" else (two, one)
    return written(concat(concat(prefix, middle), suffix))


def transformed(docs: DataFrame, seed: int = SEED, rate: int = RATE, spm: int = SPM) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output of docs (doc_id, text).

    rate: per cent of texts that are rearranged; spm: per cent of these that begin with the suffix. No shuffle: every row is
    decided by itself.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            ids = batch.column("doc_id").to_pylist()
            made = [example(t or "", Draw.of(seed, i), rate, spm) for i, t in zip(ids, batch.column("text").to_pylist())]
            n, form, prefix, middle, output = zip(*made)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(form), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(output, pa.string())], ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(rows: DataFrame) -> DataFrame:
    """rows with text, rebuilt from output and form alone."""
    small_batches(rows.sparkSession)
    others = [c for c in rows.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "output"):
            texts = [original(o, f) for o, f in zip(batch.column("output").to_pylist(), batch.column("form").to_pylist())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in others), pa.array(texts, pa.string())], [*others, "text"])

    return rows.select(*others).mapInArrow(run, rows.select(*others).withColumn("text", F.lit(None).cast("string")).schema)


def middle_documents(docs: DataFrame) -> DataFrame:
    """A row per document: doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256."""
    rows = restored(transformed(docs))
    digest = [F.sha2(F.col(c).cast("binary"), 256).alias(n) for c, n in (("output", "output_sha256"), ("text", "restored_sha256"))]
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digest)
