import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from quern.llm import token_output as t

PATH = public_tokenizers.path("word_bpe_49k.json")


def expected(rows):
    tok, at, out = Tokenizer.from_file(PATH), 0, []
    for d, text in rows:
        ids = tok.encode(text or "", add_special_tokens=False).ids + [2]
        out.append((d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def test_round_trip(spark):
    rows = [(3, "It's  A test,\x85of words　é ́x"), (1, None), (2, ""), (7, "<|endoftext|> x<|endoftext|>y " * 400), (5, "Été 12 ###" * 900)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(map(tuple, t.token_digests(df, PATH).collect())) == expected(sorted(rows))


def test_repeats_nulls_and_empty(spark):
    rows = [(None, "b"), (1, "a a"), (1, "a a"), (2, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = t.token_digests(df, PATH).collect()
    assert [(r.doc_id, r.start, r.n_tokens) for r in sorted(got, key=lambda r: r.start)] == [(None, 0, 2), (1, 2, 3), (1, 5, 3), (2, 8, 1)]
    assert t.token_digests(df.limit(0), PATH).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_codes(seed):
    rng = np.random.default_rng(seed)
    counts = (rng.pareto(0.3, 3000) * 10).clip(0, 1e15).astype(np.int64)
    lengths = t.code_lengths(counts, 14)
    used = lengths[counts > 0].astype(int)
    assert used.max() <= 14 and (lengths[counts == 0] == 0).all()
    assert sum(2.0**-n for n in used) <= 1
    ids = rng.choice(np.flatnonzero(counts), 5000)
    n = np.array([1, 0 + 999, 4000])
    full = t.code_lengths(counts, 16)
    payload, at, inside = t.pack(ids, n, t.canonical_codes(full), full)
    starts = np.array([at[0] * 8, at[1] * 8, at[2] * 8])
    assert (t.unpack(payload, starts, n, t.decoding_table(full)) == ids).all()


def test_lengths_are_optimal():
    import heapq

    counts = np.array([5, 9, 12, 13, 16, 45, 0])
    heap, cost = sorted(int(c) for c in counts if c), 0
    while len(heap) > 1:
        a = heapq.heappop(heap) + heapq.heappop(heap)
        cost += a
        heapq.heappush(heap, a)
    assert int((t.code_lengths(counts) * counts).sum()) == cost
