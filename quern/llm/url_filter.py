"""URL filtering by rules, and by the ratio of two character language models where no rule fits.

The URLs that rules accept and reject train one smoothed variable-order Markov model each; a URL passes if its
length-normalised log-likelihood difference reaches a threshold, calibrated on ruled URLs that the models haven't seen.

Both are worked out from all ruled URLs: tasks count the strings of up to ORDER + 1 bytes in those that aren't held out, a
shuffle adds them up, and the driver receives each string once, as a number with its counts: there are as many as the URLs'
alphabet and digits allow, however many URLs hold them. The threshold comes from the scores of all held-out ones. Defined results: a null URL or one
without ``://`` has empty host and path, fits no rule and scores 0; if either side has no URLs, URLs score 0 and pass
unless only rejected ones are known; equal rows get equal results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from quern.llm.common import chunks, crc_mod, fresh, materialise, shuffle_parts, utf8
from quern.llm.context_tree import ContextTree, counted, grown

#: (verdict, rule). A rule is a host and the path's beginning behind the slash.
RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))
#: Bytes of context; strings that occur at least so often are kept: all, since what is spread to shorter contexts is estimated from rare ones.
ORDER, LEAST = 5, 1
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), CAPITALS, SMALL), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls. Rules of a length keep their order."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, text in sorted(rules, key=lambda r: len(r[1])):
        domain, _, start = text.partition("/")
        fits = ((host == domain) | host.endswith(f".{domain}")) & path.startswith(f"/{start}")
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, said).otherwise(verdict)
    return rule, verdict


def _differences(texts: list[bytes], tree: ContextTree) -> np.ndarray:
    nats = tree.log_probabilities(texts)
    return (nats[:, 0] - nats[:, 1]) / np.maximum(1, np.array([len(t) for t in texts]))


def _strings(seen: DataFrame) -> DataFrame:
    """key, allow, block: every string of up to ORDER + 1 bytes in seen (address, blocked), and how often each side has it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "address"):
            keys, n = counted(utf8(batch.column("address")), batch.column("blocked").to_numpy(zero_copy_only=False).astype(np.int64), 2, ORDER)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n[:, 0]), pa.array(n[:, 1])], names=["key", "allow", "block"])

    each = seen.select("address", "blocked").mapInArrow(run, "key long, allow long, block long")
    return each.groupBy("key").agg(F.sum("allow").alias("allow"), F.sum("block").alias("block"))


def _scored(rows: DataFrame, tree: ContextTree | None, column: str) -> DataFrame:
    """rows with score: the difference a byte of the text in column; 0 without models."""
    shared = rows.sparkSession.sparkContext.broadcast(tree)  # each string of the training URLs once

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, column, 1_000_000):
            texts = utf8(batch.column(column))
            score = _differences(texts, shared.value) if shared.value else np.zeros(len(texts))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score)], names=[*batch.schema.names, "score"])

    return rows.mapInArrow(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema) + ", score double")


def _threshold(held: DataFrame, allowed: int, blocked: int) -> float:
    """The threshold of best balanced accuracy on held (score, blocked): midway between neighbouring values, below or above all.

    Of equally good ones the middle one is taken. Values are sorted in ranges, whose sums the driver adds up.
    """
    each = held.groupBy("score").agg(F.count_if(~F.col("blocked")).alias("a"), F.count_if("blocked").alias("b"))
    part = F.spark_partition_id().alias("part")
    each = materialise(each.repartitionByRange(shuffle_parts(held.sparkSession), "score").select("score", "a", "b", part))
    below, before = {}, (0, 0, None)
    for r in sorted(each.groupBy("part").agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.max("score").alias("most")).collect()):
        below[r["part"]] = before
        before = (before[0] + r["a"], before[1] + r["b"], r["most"])
    offset = held.sparkSession.createDataFrame([(p, *v) for p, v in below.items()], "part int, a0 long, b0 long, most double")
    by = Window.partitionBy("part").orderBy("score")
    up = by.rowsBetween(Window.unboundedPreceding, -1)
    a, b = (F.col(f"{n}0") + F.coalesce(F.sum(n).over(up), F.lit(0)) for n in "ab")
    last = F.coalesce(F.lag("score").over(by), F.col("most"))
    edge = F.coalesce((F.col("score") + last) / 2, F.col("score") - 1)
    # Blocked ones below an edge and allowed ones above it are right: their shares' sum, times both numbers, less a constant.
    edges = each.join(F.broadcast(offset), "part").select(edge.alias("edge"), (b * allowed - a * blocked).alias("gain"))
    edges = materialise(edges.union(each.select((F.max("score") + 1).alias("edge"), F.lit(0).cast("long").alias("gain"))))
    best = edges.filter(F.col("gain") == edges.agg(F.max("gain")).first()[0])
    return best.orderBy("edge").offset(best.count() // 2).first()["edge"]


def learn(ruled: DataFrame, held_out: int = 5) -> tuple[ContextTree | None, float]:
    """(models of accepted and rejected, threshold) from ruled (page_id, address, verdict)."""
    rows = ruled.select("address", (F.col("verdict") == "block").alias("blocked"), (crc_mod("page_id", held_out) == 0).alias("held"))
    counts = {(r["blocked"], r["held"]): r["n"] for r in rows.groupBy("blocked", "held").agg(F.count("*").alias("n")).collect()}
    sides = {b: counts.get((b, False), 0) + counts.get((b, True), 0) for b in (False, True)}
    if not all(sides.values()):
        return None, float("inf") if sides[True] else 0.0
    some = any(not held for _, held in counts)
    found = _strings(rows.filter("not held") if some else rows).toArrow()
    tree = grown(found["key"].to_numpy(), np.stack([found["allow"].to_numpy(), found["block"].to_numpy()], axis=1), ["allow", "block"], ORDER, LEAST, True)
    other = [counts.get((b, True), 0) for b in (False, True)]
    if not all(other):
        return tree, 0.0
    return tree, _threshold(_scored(rows.filter("held"), tree, "address").select("score", "blocked"), *other)


def judged_pages(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict and score of every row of pages (page_id, url)."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.select("*", rule.alias("rule"), verdict.alias("said"), F.concat("host", "path").alias("text"))
    tree, threshold = learn(rows.filter("said is not null").select("page_id", F.col("text").alias("address"), F.col("said").alias("verdict")))
    scored = _scored(rows, tree, "text")
    return scored.select("page_id", "host", "path", "rule", F.coalesce("said", F.when(F.col("score") >= threshold, "allow").otherwise("block")).alias("verdict"), "score")


def keep_accepted(pages: DataFrame, rules=RULES) -> DataFrame:
    """The rows of pages whose verdict is allow. page_id names a row."""
    [p] = fresh(pages, "_p")
    kept = judged_pages(pages, rules).filter("verdict = 'allow'").select(F.col("page_id").alias(p)).distinct()
    return pages.join(kept, F.col("page_id").eqNullSafe(F.col(p)), "left_semi")
