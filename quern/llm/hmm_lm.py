"""Language-model scoring with a hidden Markov model over words.

Symbols: the OWN_WORDS most frequent words and the end of a text have emissions of their own; all other words fall into
CLASSES by their last bytes, and within a class a word has (c + 1) / (N + V + 1) of the class's own counts.

Training: word counts over all training documents; then every document is written once as symbols of two bytes, and
Baum-Welch runs over these: tasks add up expected counts and only sums of fixed size (STATES by symbols) reach the driver.
A few rounds run over a seeded sample of START_SHARE of the documents, START_DOCS at least, to find a start; then rounds over
every training document follow until the log-likelihood a token rises by less than SETTLED, ROUNDS at most.

Long texts are trained on in runs of SPAN words. A run also reads the LEAD words before and behind it, which bring its
states to where they would be, so moves across cuts are counted and only a text's first word counts as a start.
Scoring: the exact scaled forward recursion; long texts are cut into runs whose transfer matrices are multiplied.

Counts of the DICTIONARY most frequent words are sent to the tasks (a bound by construction: a count threshold that at
most so many words reach); all rarer words meet their counts in a join, once per distinct word and text.

Defined results: null text counts as empty, which is the end token alone; a null doc_id is a training document; rows of
equal doc_id each keep their row; without training documents all symbols are alike.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import chunks, crc_mod, materialise, small_batches, utf8

STATES, OWN_WORDS, CLASSES, DICTIONARY = 8, 8192, 512, 200_000
#: Documents that the start is found on: a share of all, and so many at least. Rounds over these, and over all documents at most.
START_SHARE, START_DOCS, START_ROUNDS, ROUNDS, SETTLED = 1 / 32, 1200, 6, 6, 0.002
#: Words of a run in training, words that it reads before and behind, and words of a run in scoring.
SPAN, LEAD, SCORE_SPAN = 512, 32, 2048
#: Bytes of text, and of symbols, that a task holds as arrays at a time.
TEXT_BYTES, TRAIN_BYTES, SCORE_BYTES = 4_000_000, 800_000, 1_600_000
#: Distinct words that a task holds while counting.
HELD_WORDS = 400_000


def words_of(text: bytes) -> list[bytes]:
    """Words with A-Z lowered: bytes.lower and bytes.split know ASCII alone, and exactly its white space."""
    return text.lower().split()


def class_of(word: bytes) -> int:
    return zlib.crc32(word[-3:]) % CLASSES


def word_counts(docs: DataFrame) -> DataFrame:
    """word (binary), class and c of every distinct word of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def out() -> pa.RecordBatch:
            words = list(held)
            return pa.RecordBatch.from_pydict({"word": pa.array(words, pa.binary()), "class": pa.array([class_of(w) for w in words], pa.int32()), "c": pa.array(list(held.values()), pa.int64())})

        for batch in chunks(batches):
            for t in utf8(batch.column("text")):
                held.update(words_of(t))
            if len(held) > HELD_WORDS:
                yield out()
                held.clear()
        if held:
            yield out()

    return docs.select("text").mapInArrow(run, "word binary, class int, c long").groupBy("word", "class").agg(F.sum("c").alias("c"))


@dataclass
class Words:
    """What tasks know of words: index by frequency, and per index symbol and count; per class its count and kinds."""

    index: dict[bytes, int]
    symbol: np.ndarray
    count: np.ndarray
    own: int
    class_total: np.ndarray
    tokens: int
    kinds: int
    ends: int

    @property
    def end(self) -> int:
        return self.own + CLASSES

    def sequences(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[list[bytes]]]:
        """(index or -1 of every word and -2 of ends, tokens of each text, words of each text)."""
        words = [words_of(t) for t in texts]
        sizes = np.array([len(w) + 1 for w in words], dtype=np.int64)
        flat = np.empty(int(sizes.sum()), dtype=np.int32)
        at, get = 0, self.index.get
        for w in words:
            flat[at : at + len(w)] = np.fromiter(map(get, w, repeat(-1)), dtype=np.int32, count=len(w))
            at += len(w) + 1
            flat[at - 1] = -2
        return flat, sizes, words

    def symbols(self, flat: np.ndarray, sizes: np.ndarray, words: list[list[bytes]]) -> np.ndarray:
        known = np.append(self.symbol, [self.end, 0]).astype(np.int32)  # -2: the end
        out = known[flat]
        rare = np.flatnonzero(flat == -1)
        if len(rare):
            doc = np.searchsorted(np.cumsum(sizes), rare, side="right")
            first = np.cumsum(sizes) - sizes
            out[rare] = [self.own + class_of(words[d][i]) for d, i in zip(doc.tolist(), (rare - first[doc]).tolist())]
        return out


def learn_words(counts: DataFrame, ends: int) -> tuple[Words, int]:
    """(Words, least count of a dictionary word) from counts (word, class, c; materialised)."""
    total = counts.agg(F.sum("c"), F.count("*")).first()
    tokens, kinds = (total[0] or 0) + ends, total[1] + (ends > 0)
    # Words by the order of magnitude of their counts (eight steps to a doubling): a few hundred rows.
    step = F.floor(F.log2(F.col("c").cast("double")) * 8 + 1e-9)
    bins = sorted(((r["b"], r["n"]) for r in counts.groupBy(step.alias("b")).agg(F.count("*").alias("n")).collect()), reverse=True)
    lowest, n = None, 0
    for b, k in bins:
        if n + k > DICTIONARY:
            break
        lowest, n = b, n + k
    if lowest is None:
        frequent = []
    else:
        frequent = sorted(((-r["c"], bytes(r["word"])) for r in counts.filter(step >= lowest).select("word", "c").collect()))
    least = -frequent[-1][0] if frequent else (1 << 62)
    own = min(OWN_WORDS, len(frequent))
    words = [w for _, w in frequent]
    c = np.array([-x for x, _ in frequent], dtype=np.int64)
    classes = np.array([class_of(w) for w in words], dtype=np.int64)
    symbol = np.where(np.arange(len(words)) < own, np.arange(len(words)), own + classes).astype(np.int32)
    class_total = np.ones(CLASSES)
    for r in counts.groupBy("class").agg(F.sum("c").alias("c"), F.count("*").alias("n")).collect():  # CLASSES rows
        class_total[r["class"]] += r["c"] + r["n"]
    np.add.at(class_total, classes[:own], -(c[:own] + 1.0))
    return Words({w: i for i, w in enumerate(words)}, symbol, c, own, class_total, tokens, kinds, ends), least


@dataclass
class Model:
    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray  # [symbol, state]


def _layout(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sequences by falling length, how many of them reach each step)."""
    order = np.argsort(-sizes, kind="stable")
    return order, np.searchsorted(-sizes[order], -np.arange(1, sizes.max(initial=0) + 1), side="right")


def _runs(sizes: np.ndarray, span: int, lead: int) -> tuple[np.ndarray, ...]:
    """(first, length, own, ends, head) of runs of span words.

    A run reads length places from first on, of which own to ends are its own; head tells whether its text begins there.
    """
    pieces = (sizes + span - 1) // span
    owner = np.repeat(np.arange(len(sizes)), pieces)
    start = (np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * span
    base, end = (np.cumsum(sizes) - sizes)[owner], np.minimum(start + span, sizes[owner])
    low, high = np.maximum(start - lead, 0), np.minimum(end + lead, sizes[owner])
    return base + low, high - low, start - low, end - low, low == 0


def expected_counts(symbols: np.ndarray, sizes: np.ndarray, m: Model, span: int = SPAN, lead: int = LEAD) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """(starts, moves, emissions, log likelihood): Baum-Welch counts of sequences, all runs stepped side by side.

    They are exact for sequences of up to span words; at cuts they are as near as lead words on both sides make them.
    """
    first, length, own, ends, head = _runs(sizes, span, lead)
    order, reach = _layout(length)
    first, own, ends, head = first[order], own[order], ends[order], head[order]
    at = np.concatenate([[0], np.cumsum(reach)])
    place = np.concatenate([first[:n] + t for t, n in enumerate(reach)])  # by step, then by run
    counted = np.concatenate([(own[:n] <= t) & (t < ends[:n]) for t, n in enumerate(reach)])
    steady = np.linalg.matrix_power(m.move, 1 << 10)[0]
    begin = np.where(head[:, None], m.start, steady)
    emit = m.emit[symbols[place]]
    alpha, scale = np.empty_like(emit), np.empty(len(emit))
    for t, n in enumerate(reach):
        a = emit[at[t] : at[t] + n] * (begin if not t else alpha[at[t - 1] : at[t - 1] + n] @ m.move)
        s = a.sum(1)
        scale[at[t] : at[t] + n] = s
        alpha[at[t] : at[t] + n] = a / s[:, None]
    moves, gamma = np.zeros_like(m.move), alpha.copy()
    beta = np.ones((reach[-1], len(m.start)))
    for t in range(len(reach) - 1, 0, -1):
        here, before = slice(at[t], at[t] + reach[t]), slice(at[t - 1], at[t - 1] + reach[t])
        ahead = emit[here] * beta / scale[here][:, None]
        moves += alpha[before].T @ (ahead * counted[here][:, None])
        beta = np.ones((reach[t - 1], len(m.start)))
        beta[: reach[t]] = ahead @ m.move.T
        gamma[at[t - 1] : at[t]] *= beta
    seen = symbols[place[counted]]
    emissions = np.stack([np.bincount(seen, weights=gamma[counted, k], minlength=len(m.emit)) for k in range(gamma.shape[1])], axis=1)
    return gamma[: reach[0]][own == 0].sum(0), moves * m.move, emissions, float(np.log(scale[counted]).sum())


def log_likelihoods(symbols: np.ndarray, sizes: np.ndarray, m: Model, span: int = SCORE_SPAN) -> np.ndarray:
    """The natural log-probability of each sequence, by the scaled forward recursion."""
    pieces = (sizes + span - 1) // span
    owner = np.repeat(np.arange(len(sizes)), pieces)
    rank = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    first = (np.cumsum(sizes) - sizes)[owner] + rank * span
    length = np.minimum(span, sizes[owner] - rank * span)
    k = len(m.start)
    head, rest = np.flatnonzero(rank == 0), np.flatnonzero(rank > 0)
    out, state = np.zeros(len(sizes)), np.zeros((len(sizes), k))
    order, reach = _layout(length[head])
    a, log = None, np.zeros(len(head))
    ids = head[order]
    done = np.zeros((len(head), k))
    for t, n in enumerate(reach):
        a = m.emit[symbols[first[ids[:n]] + t]] * (m.start if a is None else a[:n] @ m.move)
        s = a.sum(1)
        a /= s[:, None]
        log[:n] += np.log(s)
        done[:n] = a
    out[owner[ids]], state[owner[ids]] = log, done
    if len(rest):
        order, reach = _layout(length[rest])
        ids = rest[order]
        moved, log = np.repeat(np.eye(k)[None], len(rest), axis=0), np.zeros(len(rest))
        for t, n in enumerate(reach):
            b = (moved[:n] @ m.move) * m.emit[symbols[first[ids[:n]] + t]][:, None, :]
            s = b.max(axis=(1, 2))
            moved[:n] = b / s[:, None, None]
            log[:n] += np.log(s)
        for i in np.lexsort((rank[ids], owner[ids])):
            d = owner[ids[i]]
            v = state[d] @ moved[i]
            s = v.sum()
            state[d] = v / s
            out[d] += log[i] + np.log(s)
    return out


def _symbols(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(symbols of all texts, how many of each) from binary values of two bytes a symbol."""
    each = column.to_pylist()
    return np.frombuffer(b"".join(each), dtype="<u2").astype(np.int32), np.array([len(x) // 2 for x in each], dtype=np.int64)


def _improved(coded: DataFrame, model: Model) -> tuple[Model, float]:
    """One round of Baum-Welch over coded (symbols), and the log-likelihood before it.

    Tasks sum up; the driver gets a row per state and symbol at most.
    """
    shared = coded.sparkSession.sparkContext.broadcast(model)
    k = len(model.start)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        starts, moves, emissions, total = np.zeros(k), np.zeros((k, k)), np.zeros_like(m.emit), np.zeros(k)
        for batch in chunks(batches, "symbols", TRAIN_BYTES):
            a, b, c, d = expected_counts(*_symbols(batch.column("symbols")), m)
            starts, moves, emissions = starts + a, moves + b, emissions + c
            total[0] += d
        some = np.flatnonzero(emissions.any(1))
        table = np.concatenate([total[None], starts[None], moves, emissions[some]])
        keys = np.concatenate([np.arange(-2 - k, 0), some])
        yield pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int32)), *(pa.array(table[:, i]) for i in range(k))], names=["key", *(f"s{i}" for i in range(k))])

    parts = coded.select("symbols").mapInArrow(run, "key int, " + ", ".join(f"s{i} double" for i in range(k)))
    # Rounded sums: their order then doesn't show in the result.
    got = parts.groupBy("key").agg(*(F.sum(F.col(f"s{i}").cast("decimal(38,9)")).cast("double").alias(f"s{i}") for i in range(k))).collect()
    emissions, starts, moves, total = np.zeros_like(model.emit), np.zeros(k), np.zeros((k, k)), 0.0
    for r in got:
        if r["key"] >= 0:
            emissions[r["key"]] = r[1:]
        elif r["key"] == -2 - k:
            total = r[1]
        elif r["key"] == -1 - k:
            starts[:] = r[1:]
        else:
            moves[r["key"] + k] = r[1:]
    overall = emissions.sum(1) + 0.05
    emissions = emissions + 200 * (overall / overall.sum())[:, None]
    return Model((starts + 0.1) / (starts + 0.1).sum(), (moves + 0.1) / (moves + 0.1).sum(1, keepdims=True), emissions / emissions.sum(0)), total


def _first_model(texts: list[np.ndarray], size: int) -> Model:
    """States start from documents (their symbols) that are unlike each other, mixed with the counts of all."""
    base = np.bincount(np.concatenate([np.zeros(0, dtype=np.int64), *texts]), minlength=size) + 0.05
    base = base / base.sum()
    rows = [np.bincount(s, minlength=size) / len(s) for s in texts if len(s) > 50]
    picks: list[np.ndarray] = []
    near = np.zeros(len(rows))
    for _ in range(STATES):
        if not rows:
            break
        pick = rows[int(near.argmin())]
        picks.append(pick)
        near = np.maximum(near, [float(np.sqrt(pick * r).sum()) for r in rows])
    rng = np.random.default_rng(0)
    while len(picks) < STATES:
        picks.append(base * rng.random(size) * 2)
    emit = np.stack([0.6 * base + 0.4 * p for p in picks], axis=1)
    move = np.full((STATES, STATES), 0.1 / (STATES - 1)) + (0.9 - 0.1 / (STATES - 1)) * np.eye(STATES)
    return Model(np.full(STATES, 1 / STATES), move, emit / emit.sum(0))


def learn(training: DataFrame, words: Words) -> tuple[Model, list[float]]:
    """The model from training (hash, symbols; materialised), and the log-likelihood before each round over all of it."""
    n, size = words.ends, words.end + 1
    rate = min(1.0, max(START_SHARE, START_DOCS / max(1, n)))
    sample = materialise(training.filter(F.pmod("hash", F.lit(1 << 30)) < int(rate * (1 << 30))))
    first = sample.orderBy("hash", "symbols").select("symbols").limit(200).collect()
    model, history = _first_model([np.frombuffer(r[0], dtype="<u2").astype(np.int64) for r in first], size), []
    if n:
        for _ in range(START_ROUNDS):
            model, _ = _improved(sample, model)
        for _ in range(ROUNDS):
            model, total = _improved(training, model)
            history.append(total)
            if len(history) > 1 and history[-1] - history[-2] < SETTLED * words.tokens:
                break
    return model, history


def coded_documents(docs: DataFrame, words: Words) -> DataFrame:
    """Every document of docs (doc_id, text) as symbols, beside what its words add to its scores: read once, used by all rounds.

    row, hash, doc_id, held_out, n_tokens, n_known, base_score, within, symbols, and words and times of those outside the
    dictionary, whose counts aren't in the scores yet.
    """
    shared = docs.sparkSession.sparkContext.broadcast(words)  # DICTIONARY words at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        log_count = np.log10(np.concatenate([w.count, [w.ends, 0]]) + 1.0)
        whole, log_class = np.log10(w.tokens + w.kinds + 1), np.log10(w.class_total)
        for batch in chunks(batches, limit=TEXT_BYTES):
            flat, sizes, each = w.sequences(utf8(batch.column("text")))
            symbols, first = w.symbols(flat, sizes, each), np.cumsum(sizes) - sizes
            counted = log_count[flat]  # -2: the end, -1: rare, so far as if it never occurred
            in_class = (symbols >= w.own) & (symbols < w.end)
            within = np.where(in_class, counted - log_class[np.where(in_class, symbols - w.own, 0)], 0.0)
            ends = np.cumsum(sizes)
            known = np.add.reduceat(((flat >= 0) | (flat == -2) & (w.ends > 0)).astype(np.int64), first)
            rare_words, rare_times, cuts = [], [], [0]
            rare = flat == -1
            for a, b, ws in zip(first.tolist(), ends.tolist(), each):
                times = Counter(ws[i] for i in np.flatnonzero(rare[a:b]).tolist())
                rare_words += times.keys()
                rare_times += times.values()
                cuts.append(len(rare_words))
            cuts, raw = pa.array(cuts, pa.int32()), symbols.astype("<u2").tobytes()
            yield pa.RecordBatch.from_pydict(
                {
                    **{c: batch.column(c) for c in ("row", "hash", "doc_id", "held_out")},
                    "n_tokens": sizes,
                    "n_known": known,
                    "base_score": np.add.reduceat(counted, first) - sizes * whole,
                    "within": np.add.reduceat(within, first),
                    "symbols": pa.array([raw[2 * a : 2 * b] for a, b in zip(first.tolist(), ends.tolist())], pa.binary()),
                    "words": pa.ListArray.from_arrays(cuts, pa.array(rare_words, pa.binary())),
                    "times": pa.ListArray.from_arrays(cuts, pa.array(rare_times, pa.int32())),
                }
            )

    held = (crc_mod("doc_id", 7) == 2).alias("held_out")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.xxhash64("doc_id", F.xxhash64("text")).alias("hash"), "doc_id", held, "text")
    return rows.mapInArrow(run, "row long, hash long, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, within double, symbols binary, words array<binary>, times array<int>")


def scored(coded: DataFrame, model: Model) -> DataFrame:
    """row, doc_id, held_out, n_tokens, n_known, base_score and score of coded; words outside the dictionary aren't counted yet."""
    kept = ["row", "doc_id", "held_out", "n_tokens", "n_known", "base_score"]
    shared = coded.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "symbols", SCORE_BYTES):
            score = log_likelihoods(*_symbols(batch.column("symbols")), shared.value) / np.log(10)
            yield pa.RecordBatch.from_pydict({**{c: batch.column(c) for c in kept}, "score": score + batch.column("within").to_numpy()})

    return coded.select(*kept, "within", "symbols").mapInArrow(run, "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")


def scored_documents(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row of docs (doc_id, text)."""
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    training = docs.filter(crc_mod("doc_id", 7) != 2)
    counts = materialise(word_counts(training))
    words, least = learn_words(counts, training.count())
    coded = materialise(coded_documents(docs, words))
    model, _ = learn(coded.filter("not held_out").select("hash", "symbols"), words)
    rare = coded.select("row", F.explode(F.arrays_zip("words", "times")).alias("w")).select("row", F.col("w.words").alias("word"), F.col("w.times").alias("times"))
    # Words without a count have log10(0 + 1) = 0 and need no row.
    more = rare.join(counts.filter(F.col("c") < least).select("word", "c"), "word").groupBy("row").agg(F.sum("times").alias("known"), F.sum(F.col("times") * F.log10(F.col("c") + F.lit(1.0))).alias("logs"))
    logs = F.coalesce("logs", F.lit(0.0))
    return scored(coded, model).join(more, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"),
        F.lit(words.tokens).cast("long").alias("train_tokens"),
        (F.col("base_score") + logs).alias("base_score"),
        (F.col("score") + logs).alias("score"),
    )
