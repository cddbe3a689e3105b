"""Chat formatting by quotation linking.

Parse. A message's lines have a level, the number of leading ``>``. Neighbouring lines of equal level make up a passage:
own words at level 0, a quotation above. A passage is normalised (marks off, lower case, single spaces, lines joined, so
wrapping doesn't matter) and hashed whole; so are its sentences, and of own words also the paragraphs and lines.

Link. A quotation comes from the nearest earlier turn of its conversation whose own words hold it whole: as a passage, a
paragraph, a line or a sentence. One found nowhere whole is linked by its sentences, each to its nearest earlier turn, if
those of one turn make up at least half of it (the turn with the most; then the latest). Links are an as-of join by hash.

Reply. A turn answers the turn that most of its linked level-1 quotations come from, by length (then the latest); without
any, the same for the lowest level that has links, which names an ancestor; without links, the nearest earlier turn.

Order. A conversation is the tree of its replies in reading order: a turn is followed by the answers to it, each with all
below it, by turn. Linked quotations are left out; quotations that were found nowhere stay as they are.

Defined results: equal (conv_id, turn, role, text) rows are one message; messages that share a turn are one node, all stay,
by role and text (among equal starts of 64 characters by hash); null text is an empty message, a null role is ``unknown``.
A message with a null conv_id or turn is a conversation of its own, in a row of its own (thread is its turn, block is 0, or
null with the turn). thread is the first turn; a row holds a block of at most BLOCK messages. An empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from quern.llm.common import chunks, materialise, shuffle_parts, small_batches

#: Messages of a conversation that make up one row of output.
BLOCK = 1024
#: Turns (three numbers each) of a conversation that one task puts in order; larger ones are ordered by joins.
LOCAL_TURNS = 100_000
#: Bits of a turn that tell rows apart inside one step of an as-of join.
STEP_BITS = 12
ROUNDS = 60
MARKS, BLANKS, SENTENCE = re.compile(r"[ \t]*((?:>[ \t]?)+)"), re.compile(r"[\x20\x09-\x0D]+"), re.compile(r"[^.!?]+[.!?]*")


def passages(text: str) -> list[tuple[int, str]]:
    """(level, raw lines) of a text's passages, in order."""
    out: list[tuple[int, list[str]]] = []
    for line in text.split("\n"):
        mark = MARKS.match(line)
        level = mark[1].count(">") if mark else 0
        if not out or out[-1][0] != level:
            out.append((level, []))
        out[-1][1].append(line)
    return [(level, "\n".join(lines)) for level, lines in out]


def normalised(raw: str) -> str:
    """Lines without marks, joined, in lower case, with single spaces."""
    return BLANKS.sub(" ", " ".join(MARKS.sub("", x, count=1) if MARKS.match(x) else x for x in raw.split("\n")).lower()).strip(" ")


def sentences(norm: str) -> list[str]:
    return [s for s in (x.strip(" ") for x in SENTENCE.findall(norm)) if s]


def units(raw: str) -> set[str]:
    """What a quotation of own words may be: all of them, a paragraph, a line or a sentence."""
    lines, paragraphs = raw.split("\n"), [[]]
    for line in lines:
        if BLANKS.sub("", line):
            paragraphs[-1].append(line)
        elif paragraphs[-1]:
            paragraphs.append([])
    found = {normalised(raw), *map(normalised, lines), *(normalised("\n".join(p)) for p in paragraphs)}
    return {u for x in found for u in (x, *sentences(x)) if u}


def _hash(unit: str) -> int:
    return xxhash.xxh64_intdigest(unit.encode(), 7) - (1 << 63)


def without_linked(text: str, linked: set[int]) -> str:
    """The text without the passages numbered in linked, and without white space around it."""
    return "\n".join(raw for i, (_, raw) in enumerate(passages(text)) if i not in linked).strip(" \t\n\r\x0b\f")


def messages_of(chats: DataFrame) -> DataFrame:
    """id, conv_id, turn, role and text of every distinct message; the ids are fixed by writing."""
    rows = chats.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return materialise(rows.distinct().withColumn("id", F.monotonically_increasing_id()))


def parsed(messages: DataFrame) -> DataFrame:
    """conv_id, turn, id, at, level, whole, kind and hash and n (length) of all units: own ones (level 0) and those of quotations.

    whole tells a quotation from its sentences.
    """
    small_batches(messages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            ids, turns, convs = (batch.column(c).to_pylist() for c in ("id", "turn", "conv_id"))
            rows = []
            for i, turn, conv, text in zip(ids, turns, convs, batch.column("text").to_pylist()):
                for at, (level, raw) in enumerate(passages(text)):
                    if not level:
                        rows += [(conv, turn, i, at, 0, False, _hash(u), len(u)) for u in units(raw)]
                    elif norm := normalised(raw):
                        rows.append((conv, turn, i, at, level, True, _hash(norm), len(norm)))
                        rows += [(conv, turn, i, at, level, False, _hash(u), len(u)) for u in sentences(norm)]
            columns = list(zip(*rows)) if rows else [[] for _ in range(8)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, TYPES.values())], names=list(TYPES))

    known = messages.filter("conv_id is not null and turn is not null").select("conv_id", "turn", "id", "text")
    return known.mapInArrow(run, "conv_id long, turn long, id long, at int, level int, whole boolean, hash long, n int")


TYPES = {"conv_id": pa.int64(), "turn": pa.int64(), "id": pa.int64(), "at": pa.int32(), "level": pa.int32(), "whole": pa.bool_(), "hash": pa.int64(), "n": pa.int32()}


def as_of(asked: DataFrame, events: DataFrame, key: list[str]) -> DataFrame:
    """asked (key, turn) with source: the largest turn of events (key, turn) below its own, or null.

    A key's turns are dealt out by steps of 2 ** STEP_BITS; between steps only their largest turns count.
    """
    steps = [*key, "_step"]
    step = F.shiftright("turn", STEP_BITS).alias("_step")
    rows = asked.select("*", step, F.lit(None).cast("long").alias("_at")).unionByName(events.select(*key, "turn", step, F.col("turn").alias("_at")).distinct(), allowMissingColumns=True)
    inside = F.max("_at").over(Window.partitionBy(*steps).orderBy("turn").rangeBetween(Window.unboundedPreceding, -1))
    tops = rows.groupBy(*steps).agg(F.max("_at").alias("_top"))
    before = F.max("_top").over(Window.partitionBy(*key).orderBy("_step").rowsBetween(Window.unboundedPreceding, -1))
    tops = tops.select(*steps, before.alias("_before"))
    rows = rows.withColumn("source", inside).filter("_at is null").join(tops, steps)
    return rows.withColumn("source", F.coalesce("source", "_before")).drop("_step", "_at", "_before")


def links(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, id, at, level, n, source): the turn that each linked quotation comes from; n is its length."""
    found = materialise(parsed(messages))
    quotes, key = found.filter("level > 0"), ["conv_id", "hash", "n"]
    own = found.filter("level = 0").select(*key, "turn").join(quotes.select(*key).distinct(), key, "left_semi")
    known = materialise(as_of(quotes, own, key))
    place = ["conv_id", "turn", "id", "at", "level"]
    whole = known.filter("whole and source is not null").select(*place, "n", "source")
    parts = known.filter("not whole").join(whole.select("id", "at"), ["id", "at"], "left_anti")
    length = parts.groupBy(*place).agg(F.sum("n").alias("n"))
    best = parts.filter("source is not null").groupBy("id", "at", "source").agg(F.sum("n").alias("got")).groupBy("id", "at").agg(F.max(F.struct("got", "source")).alias("best"))
    half = length.join(best, ["id", "at"]).filter("best.got * 2 >= n").select(*place, "n", F.col("best.source").alias("source"))
    return whole.withColumn("n", F.col("n").cast("long")).unionByName(half)


def replies(messages: DataFrame, linked: DataFrame) -> DataFrame:
    """(conv_id, turn, reply_to, by) of every distinct turn; by is quote, turn or null. linked: the rows of links()."""
    turns = messages.filter("conv_id is not null and turn is not null").select("conv_id", "turn").distinct()
    votes = linked.groupBy("conv_id", "turn", "level", "source").agg(F.sum("n").alias("n"))
    best = votes.groupBy("conv_id", "turn").agg(F.max(F.struct((-F.col("level")).alias("low"), "n", "source")).alias("best")).select("conv_id", "turn", F.col("best.source").alias("quoted"))
    rows = as_of(turns, turns, ["conv_id"]).join(best, ["conv_id", "turn"], "left")
    by = F.when(F.col("quoted").isNotNull(), "quote").when(F.col("source").isNotNull(), "turn")
    return rows.select("conv_id", "turn", F.coalesce("quoted", "source").alias("reply_to"), by.alias("by"))


def reading_order(parent: np.ndarray) -> np.ndarray:
    """The place of every node of a forest in preorder. parent: each node's parent, a smaller number, or -1."""
    n = len(parent)
    size = np.ones(n, dtype=np.int64)
    for v in range(n - 1, -1, -1):
        if parent[v] >= 0:
            size[parent[v]] += size[v]
    place, used, roots = np.zeros(n, dtype=np.int64), np.ones(n, dtype=np.int64), 0
    for v in range(n):  # a node's place follows its parent and the earlier answers with all below them
        p = parent[v]
        if p < 0:
            place[v], roots = roots, roots + size[v]
        else:
            place[v] = place[p] + used[p]
            used[p] += size[v]
    return place


def _order_local(answers: DataFrame) -> DataFrame:
    """(conv_id, turn, place) of conversations of bounded size: each in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def done(t: pa.Table) -> Iterator[pa.RecordBatch]:
            conv, turn, to = (t.column(c).to_numpy() for c in ("conv_id", "turn", "reply_to"))
            cuts = [0, *(np.flatnonzero(conv[1:] != conv[:-1]) + 1).tolist(), len(conv)]
            for a, b in zip(cuts, cuts[1:]):
                parent = np.where(to[a:b] < turn[a:b], np.searchsorted(turn[a:b], to[a:b]), -1)
                yield pa.RecordBatch.from_pydict({"conv_id": conv[a:b], "turn": turn[a:b], "place": reading_order(parent)})

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                t = pa.Table.from_batches(held)
                conv = t.column("conv_id").to_numpy()
                end = int(np.searchsorted(conv, conv[-1]))  # the last conversation may go on
                if end:
                    yield from done(t.slice(0, end))
                    held = t.slice(end).to_batches()
        if held:
            yield from done(pa.Table.from_batches(held))

    rows = answers.select("conv_id", "turn", F.coalesce("reply_to", "turn").alias("reply_to"))  # the first turn has none
    return rows.repartition(shuffle_parts(rows.sparkSession), "conv_id").sortWithinPartitions("conv_id", "turn").mapInArrow(run, "conv_id long, turn long, place long")


def _order_by_joins(answers: DataFrame) -> DataFrame:
    """(conv_id, turn, place) of conversations of any size, by pointer jumping in joins.

    A turn is followed by its first answer; a turn without answers by the next answer to the same turn, or to the nearest
    ancestor that has one. Places are the distances along these steps.
    """
    answers = materialise(answers.select("conv_id", "turn", "reply_to"))
    child = answers.filter("reply_to is not null")
    siblings = as_of(child, child.select("conv_id", "reply_to", "turn"), ["conv_id", "reply_to"])
    after = siblings.filter("source is not null").select("conv_id", F.col("source").alias("turn"), F.col("turn").alias("sibling"))
    first = child.groupBy("conv_id", "reply_to").agg(F.min("turn").alias("first")).withColumnRenamed("reply_to", "turn")
    rows = materialise(answers.join(after, ["conv_id", "turn"], "left").join(first, ["conv_id", "turn"], "left"))
    # up: the next sibling of the nearest of a turn and its ancestors that has one.
    ends = materialise(rows.select("conv_id", "turn", "sibling", F.when(F.col("sibling").isNull(), F.col("reply_to")).alias("up")))
    for _ in range(ROUNDS):
        if not ends.filter("up is not null").limit(1).count():
            break
        above = ends.select("conv_id", F.col("turn").alias("up"), F.col("sibling").alias("_s"), F.col("up").alias("_u"))
        ends = materialise(ends.join(above, ["conv_id", "up"], "left").select("conv_id", "turn", F.coalesce("sibling", "_s").alias("sibling"), F.when(F.col("sibling").isNull(), F.col("_u")).alias("up")))
    steps = materialise(rows.select("conv_id", "turn", "first").join(ends, ["conv_id", "turn"]).select("conv_id", "turn", F.coalesce("first", "sibling").alias("next"), F.when(F.coalesce("first", "sibling").isNull(), 0).otherwise(1).cast("long").alias("left")))
    for _ in range(ROUNDS):
        if not steps.filter("next is not null").limit(1).count():
            break
        ahead = steps.select("conv_id", F.col("turn").alias("next"), F.col("next").alias("_n"), F.col("left").alias("_l"))
        steps = materialise(steps.join(ahead, ["conv_id", "next"], "left").select("conv_id", "turn", F.col("_n").alias("next"), (F.col("left") + F.coalesce("_l", F.lit(0))).alias("left")))
    last = steps.groupBy("conv_id").agg(F.max("left").alias("most"))
    return steps.join(last, "conv_id").select("conv_id", "turn", (F.col("most") - F.col("left")).alias("place"))


def ordered(answers: DataFrame) -> DataFrame:
    """(conv_id, turn, place, thread) of every turn. answers: (conv_id, turn, reply_to; materialised)."""
    sizes = materialise(answers.groupBy("conv_id").agg(F.count("*").alias("_n"), F.min("turn").alias("thread")))
    small = _order_local(answers.join(sizes.filter(F.col("_n") <= LOCAL_TURNS), "conv_id", "left_semi"))
    large = sizes.filter(F.col("_n") > LOCAL_TURNS).select("conv_id")
    if large.limit(1).count():
        small = small.unionByName(_order_by_joins(answers.join(large, "conv_id", "left_semi")))
    return small.join(sizes.drop("_n"), "conv_id")


def said(messages: DataFrame, linked: DataFrame) -> DataFrame:
    """messages with said: the role and the text without linked quotations."""
    gone = linked.groupBy("id").agg(F.collect_set("at").alias("gone"))  # passages of one message
    rows = messages.join(gone, "id", "left").select("conv_id", "turn", "role", "text", "gone")
    small_batches(messages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            columns = {c: batch.column(c) for c in ("conv_id", "turn", "role")}
            each = zip(columns["role"].to_pylist(), batch.column("text").to_pylist(), batch.column("gone").to_pylist())
            yield pa.RecordBatch.from_pydict({**columns, "said": pa.array([f"<|{r}|>\n{without_linked(t, set(g or ()))}" for r, t, g in each], pa.string())})

    return rows.mapInArrow(run, "conv_id long, turn long, role string, said string")


def numbered(rows: DataFrame) -> DataFrame:
    """rows with number: their place in the conversation from 0, by place, role and text. A long one is dealt out over tasks."""
    order = ["place", "role", "_start", "_hash"]  # a text's start, then its hash: range bounds are sampled to the driver
    rows = rows.withColumn("_start", F.substring("said", 1, 64)).withColumn("_hash", F.xxhash64("said"))
    rows = rows.repartitionByRange(shuffle_parts(rows.sparkSession), "conv_id", *order).withColumn("_part", F.spark_partition_id())
    rows = materialise(rows)
    counts = materialise(rows.groupBy("conv_id", "_part").agg(F.count("*").alias("n")))
    before = Window.partitionBy("conv_id").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row a task at most
    counts = counts.select("conv_id", "_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy("conv_id", "_part").orderBy(*order)) - 1
    return rows.withColumn("_at", place).join(counts, ["conv_id", "_part"]).withColumn("number", F.col("_before") + F.col("_at")).drop("_part", "_at", "_before", "_start", "_hash")


def conversations(chats: DataFrame) -> DataFrame:
    """conv_id, thread, block, n_messages, n_quoting and chat: the conversations in reply order, in blocks of messages."""
    messages = messages_of(chats)
    linked = materialise(links(messages))
    answers = materialise(replies(messages, linked))
    told = said(messages, linked)
    lone = F.col("conv_id").isNull() | F.col("turn").isNull()
    alone = told.filter(lone).select("conv_id", F.col("turn").alias("thread"), F.when(F.col("turn").isNotNull(), 0).cast("long").alias("block"), F.lit(1).cast("long").alias("n_messages"), F.lit(0).cast("long").alias("n_quoting"), F.col("said").alias("chat"))
    placed = ordered(answers).join(answers.select("conv_id", "turn", F.coalesce(F.col("by") == "quote", F.lit(False)).alias("quoting")), ["conv_id", "turn"])
    rows = numbered(told.filter(~lone).join(placed, ["conv_id", "turn"])).withColumn("block", F.expr(f"number div {BLOCK}"))
    parts = F.array_sort(F.collect_list(F.struct("number", "said")))  # BLOCK messages at most
    grouped = rows.groupBy("conv_id", "thread", "block").agg(F.count("*").alias("n_messages"), F.count_if("quoting").alias("n_quoting"), parts.alias("parts"))
    return grouped.select("conv_id", "thread", "block", "n_messages", "n_quoting", _chat(F.col("parts")).alias("chat")).unionByName(alone)


def _chat(parts: Column) -> Column:
    return F.array_join(F.transform(parts, lambda p: p["said"]), "\n")
