"""Language identification by prediction by partial matching.

Each language has a context tree of bytes with escape probabilities; a text's score in a language is its exact code length
under the frozen statistics, and the shortest wins.

The trees are fitted on a seeded sample of FIT_DOCS whole documents a language, or of fewer where these would be more than the
language's share of FIT_BYTES (documented bounds, as expected numbers; every language keeps its share and one document at
least, however many there are). All other steps cover all rows and whole texts. Defined results: null texts and texts without a letter are ``und`` with
score 0, and so is all text if no language was learned; documents without lang teach nothing; equal rows get equal results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import chunks, crc_mod, sized_broadcast, small_batches, utf8
from quern.llm.context_tree import ContextTree, train

#: Documents of each language that the trees see, and bytes of all together: so many for FIT_LANGUAGES languages and less for more,
#: since every string has numbers for all languages.
FIT_DOCS, FIT_BYTES, FIT_LANGUAGES = 250, 4_000_000, 6
#: Bytes of context. Strings of the sample that occur at least so often are kept: all, since escapes are estimated from rare ones.
ORDER, LEAST = 4, 1
#: Nats a byte are multiplied by this before languages are weighed against each other.
SHARPNESS = 25.0

_ASCII_LETTER, _LETTER = regex.compile(rb"[A-Za-z]"), regex.compile(r"\p{L}")


def has_letter(text: bytes) -> bool:
    """Whether text holds a character of Unicode category L; digits, fractions and circled numbers are none."""
    return bool(_ASCII_LETTER.search(text)) or (not text.isascii() and bool(_LETTER.search(text.decode())))


def learn(docs: DataFrame, held_out: int = 5) -> ContextTree | None:
    """Trees from docs (doc_id, text, lang) without those whose crc32(doc_id) mod held_out is 0."""
    known = docs.select("doc_id", "text", "lang").filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (crc_mod("doc_id", held_out) != 0))
    place = F.pmod(F.xxhash64("doc_id", F.xxhash64("text")), F.lit(1 << 30))
    sizes = known.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes"), F.min(place).alias("least")).collect()  # a row per language
    if not sizes:
        return None
    # Rows whose hash is under their language's rate: about as many of each, whichever tasks they are in.
    most = FIT_BYTES * min(1.0, FIT_LANGUAGES / len(sizes)) / len(sizes)
    rates = sorted((r["lang"], max(r["least"] + 1, int(min(1.0, FIT_DOCS / r["n"], most / max(1, r["bytes"])) * (1 << 30)))) for r in sizes)
    known = known.join(sized_broadcast(docs.sparkSession.createDataFrame(rates, "lang string, _rate long")), "lang")
    sample = known.filter(place < F.col("_rate"))
    rows = sorted((r["lang"], r["text"]) for r in sample.select("lang", "text").collect())
    langs = sorted({lang for lang, _ in rows})
    if not langs:
        return None
    return train([t.encode() for _, t in rows], np.array([langs.index(lang) for lang, _ in rows]), langs, ORDER, LEAST)


def identify(texts: list[bytes], tree: ContextTree | None) -> tuple[list[str], np.ndarray]:
    """(language, score) of each text."""
    if tree is None:
        return ["und"] * len(texts), np.zeros(len(texts))
    nats = tree.log_probabilities(texts)
    mean = nats / np.maximum(1, np.array([len(t) for t in texts]))[:, None]
    odds = np.exp(SHARPNESS * (mean - mean.max(1, keepdims=True)))
    letters = np.array([has_letter(t) for t in texts], dtype=bool)
    best = nats.argmax(1)
    score = np.where(letters, odds[np.arange(len(texts)), best] / odds.sum(1), 0.0)
    return [tree.classes[b] if ok else "und" for b, ok in zip(best, letters)], score


def language_of(docs: DataFrame, tree: ContextTree | None) -> DataFrame:
    """doc_id, lang_pred and score of every row of docs (doc_id, text)."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(tree)  # bounded by the sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, limit=1_000_000):
            langs, score = identify(utf8(batch.column("text")), shared.value)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "lang_pred": pa.array(langs, pa.string()), "score": score})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def identified_documents(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row of docs (doc_id, text, lang)."""
    return language_of(docs, learn(docs)).select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score")
