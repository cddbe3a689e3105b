"""Keeping, voting, numbering and matching by rank."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window


def keep_best(df: DataFrame, key: list[str], score: str, seq: str) -> DataFrame:
    """The row of the highest score of each key, the first by seq among equals. One partial aggregate: a hot key is pre-reduced."""
    names = [c for c in df.columns if c not in key]
    best = F.max_by(F.struct(*names), F.struct(F.col(score), -F.col(seq)))
    return df.groupBy(*key).agg(best.alias("_best")).select(*key, *(F.col(f"_best.{c}").alias(c) for c in names)).select(*df.columns)


def discarded(df: DataFrame, key: list[str], score: str, seq: str) -> DataFrame:
    """Rows that lose when rows arrive by seq and only a strictly higher score replaces: with kept_seq, the winner at that time."""
    w = Window.partitionBy(*key).orderBy(seq)
    place = F.struct(F.col(score), (-F.col(seq)).alias("_s"))
    winner = F.max(place).over(w.rowsBetween(Window.unboundedPreceding, 0))
    before = F.max(place).over(w.rowsBetween(Window.unboundedPreceding, -1))
    now = df.withColumns({"_now": -winner["_s"], "_was": -before["_s"]}).filter("_was is not null")
    gone = F.when(F.col("_now") == F.col(seq), F.col("_was")).otherwise(F.col(seq))
    return now.select(*key, gone.alias("discarded_seq"), F.col("_now").alias("kept_seq"))


def vote(df: DataFrame, key: list[str], value: Column, seq: str) -> DataFrame:
    """key, value, votes: the most frequent value of each key, the first seen among equals."""
    counts = df.groupBy(*key, value.alias("value")).agg(F.count("*").alias("votes"), F.min(seq).alias("_first"))
    best = F.max_by(F.struct("value", "votes"), F.struct(F.col("votes"), -F.col("_first")))
    return counts.groupBy(*key).agg(best.alias("b")).select(*key, "b.value", "b.votes")


def clustered_rows(df: DataFrame, page: list[str], centre: str, x: str, gap: Column, idx: str) -> DataFrame:
    """df with row_id and reading_order: a new row starts where the centre rises by more than gap; rows read by x."""
    by = Window.partitionBy(*page).orderBy(centre, idx)
    new = (F.col(centre) - F.lag(centre).over(by) > gap).cast("int")
    rows = df.withColumn("_new", F.coalesce(new, F.lit(0)))
    rows = rows.withColumn("row_id", F.sum("_new").over(by.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")
    return rows.withColumn("reading_order", F.row_number().over(Window.partitionBy(*page).orderBy("row_id", x, centre, idx)))


def matched_by_position(left: DataFrame, right: DataFrame, key: list[str], left_order: list, right_order: list) -> DataFrame:
    """The i-th row of left with the i-th of right in each key, where both have as many rows; otherwise none of the key's."""
    a = left.withColumns({"_i": F.row_number().over(Window.partitionBy(*key).orderBy(*left_order)), "_n": F.count("*").over(Window.partitionBy(*key))})
    b = right.withColumns({"_i": F.row_number().over(Window.partitionBy(*key).orderBy(*right_order)), "_n": F.count("*").over(Window.partitionBy(*key))})
    return a.join(b, [*key, "_i", "_n"]).withColumnRenamed("_i", "position").drop("_n")


def position_counts(left: DataFrame, right: DataFrame, key: list[str]) -> DataFrame:
    """key, found, expected, matches: how many rows of either side a key has, and whether they can be matched by position."""
    both = left.groupBy(*key).agg(F.count("*").alias("found")).join(right.groupBy(*key).agg(F.count("*").alias("expected")), key, "full")
    return both.fillna(0, ["found", "expected"]).withColumn("matches", F.col("found") == F.col("expected"))


def row_gaps(df: DataFrame, page: list[str], height: str, share: float) -> DataFrame:
    """page, gap: the vertical step that starts a new row, a share of the page's median height."""
    return df.groupBy(*page).agg((share * F.median(height)).alias("gap"))


def near_largest(df: DataFrame, key: list[str], value: str, ratio: float) -> DataFrame:
    """Rows of at least ratio times their key's largest value: an aggregate and a join, so that a hot key can be split."""
    top = df.groupBy(*key).agg(F.max(value).alias("_top"))
    return df.join(top, key).filter(F.col(value) >= ratio * F.col("_top")).drop("_top")


def upserted(old: DataFrame, new: DataFrame, key: list[str], version: str) -> DataFrame:
    """One row per key, the newest by version, new before old among equals."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    names = [c for c in old.columns if c not in key]
    return both.groupBy(*key).agg(F.max_by(F.struct(*names), F.struct(version, "_new")).alias("r")).select(*key, *(F.col(f"r.{c}").alias(c) for c in names))


def otsu(df: DataFrame, page: list[str], value: str) -> DataFrame:
    """page, threshold: the first value of greatest between-class variance; windows run over histograms, not rows."""
    hist = df.filter(F.col(value).isNotNull()).groupBy(*page, F.col(value).alias("v")).agg(F.count("*").cast("double").alias("n"))
    upto, whole = Window.partitionBy(*page).orderBy("v"), Window.partitionBy(*page)
    h = hist.withColumns({"w": F.sum("n").over(upto), "s": F.sum(F.col("n") * F.col("v")).over(upto), "tw": F.sum("n").over(whole), "ts": F.sum(F.col("n") * F.col("v")).over(whole)})
    apart = F.col("s") / F.col("w") - (F.col("ts") - F.col("s")) / (F.col("tw") - F.col("w"))
    h = h.withColumn("between", F.when(F.col("w") < F.col("tw"), F.col("w") * (F.col("tw") - F.col("w")) * apart * apart).otherwise(0.0))
    return h.groupBy(*page).agg(F.max_by("v", F.struct(F.round("between", 3), -F.col("v"))).alias("threshold"))
