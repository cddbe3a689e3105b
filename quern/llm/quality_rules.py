"""A sparse rule ensemble for text quality.

Statistics of whole texts feed small trees; every path from a root to a node becomes a conjunctive rule; a lasso logistic
regression keeps few rules; these are compiled into one Spark column expression over the statistics.

The fit uses a seeded sample of FIT_ROWS labelled rows (a documented bound); everything else covers all rows.
Defined results: null text counts as empty, and its statistics are 0; repeated labels of a doc_id are averaged; null labels
are ignored; without labels of both kinds the score is their mean, or 0.5 if there are none.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import crc_mod, fresh, small_batches, utf8

#: Labelled rows, as expected, that the fit sees.
FIT_ROWS = 12_000
KEEP_AT = 0.3
TREES, DEPTH, CUTS, LEAF = 40, 3, 24, 20
PENALTY = 8e-4
STATS = ("n_bytes", "n_words", "word_bytes", "longest", "upper", "symbols", "stops", "digits", "beyond_ascii", "newlines", "distinct_words", "distinct_pairs", "top_word", "symbol_ends", "capital_starts", "distinct_lines")

# Kinds of bytes: 1 upper, 2 lower, 3 digit, 4 full stop or comma, 5 other ASCII signs, 6 newline, 7 beyond ASCII, 0 rest.
KIND = np.zeros(256, dtype=np.uint8)
KIND[65:91], KIND[97:123], KIND[48:58], KIND[128:] = 1, 2, 3, 7
KIND[[i for i in range(33, 127) if not chr(i).isalnum()]] = 5
KIND[[44, 46]], KIND[10] = 4, 6


def text_statistics(text: bytes) -> list[float]:
    """STATS of a text, from all of it."""
    if not text:
        return [0.0] * len(STATS)
    data = np.frombuffer(text, dtype=np.uint8)
    kinds = np.bincount(KIND[data], minlength=8)
    words = text.split()
    n, letters = len(data), max(1, int(kinds[1] + kinds[2] + kinds[7]))
    if not words:
        return [float(n), *[0.0] * 8, kinds[6] / n, *[0.0] * 6]
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    lines = text.split(b"\n")
    pairs = len(set(zip(words, words[1:])))
    ends = np.cumsum([len(w) for w in words])
    joined = KIND[np.frombuffer(b"".join(words), dtype=np.uint8)]
    return [
        float(n),
        float(len(words)),
        float(ends[-1]) / len(words),
        float(max(map(len, counts))),
        kinds[1] / letters,
        kinds[5] / n,
        kinds[4] / n,
        kinds[3] / n,
        kinds[7] / n,
        kinds[6] / n,
        len(counts) / len(words),
        pairs / max(1, len(words) - 1),
        max(counts.values()) / len(words),
        float((joined[ends - 1] == 5).mean()),
        float((joined[np.concatenate([[0], ends[:-1]])] == 1).mean()),
        len(set(lines)) / len(lines),
    ]


def _statistics(column: pa.Array) -> pa.Array:
    rows = []
    for i in range(0, len(column), 500):
        rows += [text_statistics(t) for t in utf8(column.slice(i, 500))]
    table = np.array(rows, dtype=np.float64).reshape(-1, len(STATS))
    return pa.StructArray.from_arrays([pa.array(table[:, i]) for i in range(len(STATS))], names=list(STATS))


def statistics(text: Column) -> Column:
    """A struct of STATS. It counts as nondeterministic so that Spark computes it once a row."""
    made = F.arrow_udf(_statistics, ", ".join(f"{s} double" for s in STATS)).asNondeterministic()
    return made(text)


@dataclass
class Rules:
    """score = logistic(bias + sum of the weights of the rules that hold); a rule: ((statistic, is_over, cut), ...)."""

    bias: float
    rules: list[tuple[tuple[tuple[str, bool, float], ...], float]] = field(default_factory=list)

    def column(self, stats: str) -> Column:
        """The score as a column expression over a struct column of statistics."""
        total = F.lit(float(self.bias))
        for rule, weight in self.rules:
            holds = None
            for name, over, cut in rule:
                s = F.col(f"{stats}.{name}")
                one = s > cut if over else s <= cut
                holds = one if holds is None else holds & one
            total = total + F.when(holds, F.lit(float(weight))).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def _paths(x: np.ndarray, y: np.ndarray, cuts: list[np.ndarray], rng: np.random.Generator, path: tuple = ()) -> list[tuple]:
    """The rules of all nodes of one randomised tree: at each node the best Gini split over half of the features."""
    if len(path) == DEPTH or len(y) < 2 * LEAF or y.min() == y.max():
        return [path] if path else []
    best = (1e-9, None, None)
    base = len(y) * y.mean() * (1 - y.mean())
    for j in rng.permutation(x.shape[1])[: (x.shape[1] + 1) // 2]:
        low = x[:, j, None] <= cuts[j][None]
        n, s = low.sum(0), (low & (y[:, None] > 0)).sum(0)
        m, t = len(y) - n, y.sum() - s
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = base - s * (1 - s / n) - t * (1 - t / m)
        gain[(n < LEAF) | (m < LEAF)] = 0
        k = int(gain.argmax())
        if gain[k] > best[0]:
            best = (gain[k], j, cuts[j][k])
    if best[1] is None:
        return [path] if path else []
    _, j, cut = best
    low, own = x[:, j] <= cut, [path] if path else []
    return own + _paths(x[low], y[low], cuts, rng, (*path, (int(j), False, float(cut)))) + _paths(x[~low], y[~low], cuts, rng, (*path, (int(j), True, float(cut))))


def _lasso(z: np.ndarray, y: np.ndarray, penalty: float, steps: int = 400) -> tuple[float, np.ndarray]:
    """Bias and weights of the l1-penalised logistic regression, by accelerated proximal gradients."""
    n, d = z.shape
    step = 4.0 / max(1e-9, np.linalg.norm(z, 2) ** 2 / n + 1)
    w, v, t = np.zeros(d + 1), np.zeros(d + 1), 1.0
    w[0] = v[0] = np.log(max(y.mean(), 1e-6) / max(1 - y.mean(), 1e-6))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-(v[0] + z @ v[1:])))
        new = v - step * np.concatenate([[(p - y).mean()], z.T @ (p - y) / n])
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - step * penalty, 0)
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, w, t = new + (t - 1) / t2 * (new - w), new, t2
    return float(w[0]), w[1:]


def fit_rules(x: np.ndarray, y: np.ndarray, seed: int = 0) -> Rules:
    """Rules from statistics (rows in a fixed order) and labels 0 or 1."""
    if not len(y):
        return Rules(0.0)
    mean = float(np.clip(y.mean(), 1e-6, 1 - 1e-6))
    if y.min() == y.max():
        return Rules(float(np.log(mean / (1 - mean))))
    rng = np.random.default_rng(seed)
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0.02, 0.98, CUTS))) for j in range(x.shape[1])]
    found: dict[tuple, None] = {}
    for _ in range(TREES):
        rows = rng.integers(0, len(y), min(len(y), 4000))
        for p in _paths(x[rows], y[rows], cuts, rng):
            found.setdefault(tuple(sorted(p)))
    kept, columns, seen = [], [], set()
    for rule in found:
        holds = np.ones(len(y), dtype=bool)
        for j, over, cut in rule:
            holds &= (x[:, j] > cut) == over
        if 0.002 < holds.mean() < 0.998 and (key := holds.tobytes()) not in seen:
            seen.add(key)
            kept.append(rule)
            columns.append(holds)
    if not kept:
        return Rules(float(np.log(mean / (1 - mean))))
    z = np.array(columns, dtype=np.float64).T
    centre, spread = z.mean(0), z.std(0)
    bias, w = _lasso((z - centre) / spread, y, PENALTY)
    w = w / spread
    named = [(tuple((STATS[j], over, cut) for j, over, cut in rule), float(v)) for rule, v in zip(kept, w) if abs(v) > 1e-6]
    return Rules(bias - float(w @ centre), named)


def learn(docs: DataFrame, labels: DataFrame, target: str = "quality", rows: int = FIT_ROWS, held_out: int = 5) -> Rules:
    """Rules from docs (doc_id, text) with labels (doc_id, target), without those whose crc32(doc_id) mod held_out is 0."""
    small_batches(docs.sparkSession)
    marks = labels.filter(F.col(target).isNotNull() & F.col("doc_id").isNotNull() & (crc_mod("doc_id", held_out) != 0))
    marks = marks.groupBy("doc_id").agg((F.avg(target) >= 0.5).cast("double").alias("_y"))
    rate = min(1.0, rows / max(1, marks.count()))
    # The rows whose hash is under the rate; the count is then about the bound, so the sample may be broadcast.
    sample = marks.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(rate * (1 << 30)))
    seen = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("doc_id", "_y", F.xxhash64("text").alias("_h"), statistics(F.col("text")).alias("_s"))
    got = seen.select("doc_id", "_h", "_y", "_s.*").toPandas().sort_values(["doc_id", "_h"])
    return fit_rules(got[list(STATS)].to_numpy(dtype=np.float64), got["_y"].to_numpy(dtype=np.float64))


def scored_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of docs (doc_id, text)."""
    rules = learn(docs, labels)
    rows = docs.select("doc_id", statistics(F.col("text")).alias("_s")).select("doc_id", rules.column("_s").alias("score"))
    return rows.select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= KEEP_AT).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, at: float = KEEP_AT) -> DataFrame:
    """The rows of docs with a score of at least at."""
    rules, [s] = learn(docs, labels), fresh(docs, "_s")
    return docs.withColumn(s, statistics(F.col("text"))).filter(rules.column(s) >= at).select(*docs.columns)
