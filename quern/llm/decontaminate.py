"""Benchmark decontamination as a prefix-filtered set join, in DataFrame operations only.

An item window is the set of its positioned shingles. A document holds a window only if it holds all of them (containment
1), so one necessary shingle is enough as prefix: the rarest in the documents. Steps:

1. One pass counts, over all documents, the shingles that occur in any window: hashes, added up before they are shuffled.
2. Each window's shingles are ordered by these counts; the rarest is its prefix, and windows with a count of 0 are out.
3. A second pass joins the documents' shingles with the prefixes alone and gives candidate starts; those that leave the
   document at either end are dropped (positional and length bounds).
4. Candidates are verified exactly: the document's words at start, start + 1, ... are joined with the windows as text.

The passes lower texts with Spark's own function, which changes more letters than A-Z but never where words begin or end;
so they find candidates for every true occurrence, and step 4 lowers A-Z only. Windows that start at the same place are
merged as intervals, so overlapping ones count a word once.

Defined results: null texts have no words; rows that share doc_id and text get the same result; equal doc_ids with other
texts are judged apart; an empty benchmark leaves every document clean; windows of items without an item_id hit and contaminate
like any other, but such an item has no id to list and isn't counted in n_items.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from quern.llm.common import fresh, materialise, sized_broadcast

#: Consecutive words of a window.
WINDOW = 10
#: Words of a shingle.
SHINGLE = 3
#: Hashes of shingles up to which they are broadcast (a few numbers each); beyond it the join shuffles.
BROADCAST_SHINGLES = 1_000_000
#: Windows (ten words as text) and rows of item_ids up to which they are broadcast.
BROADCAST_WINDOWS = 200_000
#: Separators of words: ASCII other than digits and letters.
BREAKS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lowered(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), CAPITALS, SMALL)


def split_words(text: Column) -> Column:
    """The words of a text, without lowering."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BREAKS), "")


def words_of(text: Column) -> Column:
    return split_words(lowered(text))


def shingle_hashes(words: str, n: int) -> Column:
    """A hash for each place of the array column words: of the n words from there on, or of fewer at its end."""
    return F.transform(F.col(words), lambda w, i: F.xxhash64(F.lit(n), w, *(F.get(F.col(words), i + k) for k in range(1, n))))


def windows_of(items: DataFrame) -> DataFrame:
    """(window, words, size, item_ids) of the distinct windows of items (item_id, text). window: the space-joined words."""
    words = items.select("item_id", words_of(F.col("text")).alias("words")).filter(F.size("words") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - WINDOW + 1, F.lit(1)))
    each = words.select("item_id", F.explode(F.transform(starts, lambda i: F.slice(F.col("words"), i, WINDOW))).alias("words"))
    return each.select("item_id", "words", F.size("words").alias("size"), F.array_join("words", " ").alias("window")).distinct()


def _places(docs: DataFrame, n: int) -> DataFrame:
    """(doc_id, h, n_words, pos, shingle) of all shingles of n words. docs: (doc_id, text)."""
    rows = docs.select("doc_id", F.xxhash64("text").alias("h"), split_words(F.lower("text")).alias("words"))
    # n_words comes before the places, or each of them would carry all words of its document.
    rows = rows.withColumn("n_words", F.size("words"))
    return rows.select("doc_id", "h", "n_words", F.posexplode(shingle_hashes("words", n)).alias("pos", "shingle"))


def hits(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, h, start, end, item_id) of every occurrence of an item's window; positions count words from 0.

    docs: (doc_id, text); h is the hash of the text and tells rows apart that share a doc_id.
    """
    docs = docs.select("doc_id", "text")
    windows = materialise(windows_of(items))
    parts = windows.select("window", "size", F.least("size", F.lit(SHINGLE)).alias("n"), split_words(F.lower("window")).alias("w")).distinct()
    sizes = sorted(r[0] for r in parts.select("n").distinct().collect())  # SHINGLE at most, and 1 or 2 for items that short
    if not sizes:
        return docs.select("doc_id", F.lit(0).cast("long").alias("h"), F.lit(0).alias("start"), F.lit(0).alias("end"), F.lit("").alias("item_id")).limit(0)
    each = None
    for n in sizes:
        one = parts.filter(F.col("n") == n).select("window", "size", "n", F.posexplode(F.slice(shingle_hashes("w", n), 1, F.col("size") - n + 1)).alias("offset", "shingle"))
        each = one if each is None else each.unionByName(one)
    parts = materialise(each)
    wanted = sized_broadcast(materialise(parts.select("shingle").distinct()), BROADCAST_SHINGLES)
    counts = None
    for n in sizes:
        one = _places(docs, n).select("shingle").join(wanted, "shingle", "left_semi").groupBy("shingle").agg(F.count("*").alias("times"))
        counts = one if counts is None else counts.unionByName(one)  # hashes of other sizes hardly ever meet; extra counts only change the order
    counts = materialise(counts.groupBy("shingle").agg(F.sum("times").alias("times")))
    # A window's shingles must all occur; order them by rarity and take the first as prefix.
    known = parts.join(sized_broadcast(counts, BROADCAST_SHINGLES), "shingle", "left")
    ranked = known.groupBy("window", "size", "n").agg(F.min(F.struct(F.coalesce("times", F.lit(0)).alias("times"), "offset", "shingle")).alias("rare"))
    prefix = ranked.filter("rare.times > 0").select("n", "size", F.col("rare.offset").alias("at"), F.col("rare.shingle").alias("shingle")).distinct()
    prefix = sized_broadcast(materialise(prefix), BROADCAST_SHINGLES)
    starts = None
    for n in sizes:
        one = _places(docs, n).join(prefix.filter(F.col("n") == n).drop("n"), "shingle").withColumn("start", F.col("pos") - F.col("at"))
        one = one.filter("start >= 0 and start + size <= n_words").select("doc_id", "h", "start", "size")
        starts = one if starts is None else starts.unionByName(one)
    # A document's starts are at most its words times the sizes of windows (ten at most).
    starts = materialise(starts.groupBy("doc_id", "h").agg(F.collect_set(F.struct("start", "size")).alias("starts"))).withColumnsRenamed({"doc_id": "_d", "h": "_h"})
    same = F.col("doc_id").eqNullSafe(F.col("_d")) & (F.xxhash64("text") == F.col("_h"))
    few = sized_broadcast(starts.select("_d", "_h"))  # only these documents' texts go on
    some = docs.join(few, same, "left_semi").join(starts, same).dropDuplicates(["_d", "_h"])
    some = some.select("doc_id", F.col("_h").alias("h"), "starts", words_of(F.col("text")).alias("words"))
    at = F.transform("starts", lambda x: F.struct(x["start"].alias("start"), x["size"].alias("size"), F.array_join(F.slice(F.col("words"), x["start"] + 1, x["size"]), " ").alias("window")))
    at = some.select("doc_id", "h", F.explode(at).alias("_x")).select("doc_id", "h", "_x.*")
    texts = sized_broadcast(windows.select("window", "item_id"), BROADCAST_WINDOWS)
    return at.join(texts, "window").select("doc_id", "h", "start", (F.col("start") + F.col("size")).alias("end"), "item_id")


def contamination(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, h, n_hit, item_ids) of the documents that hold a window: words inside any, and the items' ids, sorted as strings."""
    found = materialise(hits(docs, items))
    key = ["doc_id", "h"]
    spans = found.groupBy(*key, "start").agg(F.max("end").alias("end"))
    before = Window.partitionBy(*key).orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    new = F.greatest(F.lit(0), F.col("end") - F.greatest(F.col("start"), F.coalesce(F.max("end").over(before), F.lit(0))))
    words = spans.withColumn("new", new).groupBy(*key).agg(F.sum("new").alias("n_hit"))
    ids = found.groupBy(*key).agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("item_ids"))
    other = ids.withColumnsRenamed({"doc_id": "_d", "h": "_h"})
    return words.join(other, words["doc_id"].eqNullSafe(other["_d"]) & (words["h"] == other["_h"])).select(*key, "n_hit", "item_ids")


def contaminated_documents(docs: DataFrame, items: DataFrame) -> DataFrame:
    """A row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    docs = docs.select("doc_id", "text")
    digest = F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256")  # so that rows to broadcast have a fixed size
    found = contamination(docs, items).select(F.col("doc_id").alias("_d"), F.col("h").alias("_h"), "n_hit", F.size("item_ids").cast("long").alias("n_items"), digest)
    found = sized_broadcast(materialise(found))
    all_ = docs.select("doc_id", F.xxhash64("text").alias("h"), F.size(split_words(F.col("text"))).cast("long").alias("n_words"))
    both = all_.join(found, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("h") == F.col("_h")), "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return both.select("doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"), F.coalesce("items_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def drop_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of docs whose text holds no window of items."""
    d, h = fresh(docs, "_d", "_dh")
    found = materialise(contamination(docs.select("doc_id", "text"), items).select(F.col("doc_id").alias(d), F.col("h").alias(h)))
    return docs.join(sized_broadcast(found), docs["doc_id"].eqNullSafe(F.col(d)) & (F.xxhash64(docs["text"]) == F.col(h)), "left_anti")
