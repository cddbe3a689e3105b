"""Mixing overlapping sources to target weights as a min-cost flow over membership patterns.

Documents with the same set of sources form one pattern; only pattern totals reach the driver (a few numbers a pattern, of
which the flow takes time about in proportion). Words flow from a pattern
to its sources' quotas. The first copy of a pattern's words costs nothing and each further copy costs more than the one
before (convex), so words repeat only where quotas can't be met otherwise. What a pattern sends is then taken from its
documents in seeded order: whole rounds of all documents, and one partial round up to a cut in that order.

Defined results: null text has size 0; a null source is a source of its own, last in order; rows of equal doc_id and text
are taken together; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from quern.llm.common import fresh, materialise, sized_broadcast

BLANKS = r"[\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
SHARE = 1.5
COPIES = 2
#: The cut in seeded order is found in LEVELS histograms of 2 ** BITS bins for each pattern, then exactly.
BITS, LEVELS = 10, 2


def word_count(text: Column) -> Column:
    """Words of a text, 0 for null. Splitting is linear in the text; counting matches copies it at every match."""
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), BLANKS), "")).cast("long")


def seeded_order(seed: int) -> Column:
    """A place in [0, 2^62) from the row's id and text."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("doc_id"), F.xxhash64("text")), 2)


def source_targets(sizes: dict, weights: tuple = WEIGHTS, share: float = SHARE, cap: float = COPIES) -> dict:
    """The target of each source: share of all sizes by weight, at most cap times its size, the excess dealt out again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, free, target = share * sum(sizes.values()), set(order), {}
    while free:
        total = sum(weight[s] for s in free)
        give = {s: left * weight[s] / total for s in free}
        full = {s for s in free if give[s] > cap * sizes[s]}
        if not full:
            return target | give
        for s in full:
            target[s] = float(cap * sizes[s])
        left -= sum(target[s] for s in full)
        free -= full
    return target


def pattern_flows(patterns: dict[tuple, int], quotas: dict, copies: int = COPIES) -> dict[tuple, int]:
    """The words that each pattern sends: a maximum flow to the quotas of least repetition cost.

    A price stands on a pattern's copies only and rises with each, so the cheapest flow is a maximum flow of first copies,
    extended by second copies, and so on; an extension never takes back what a pattern sends. Each is found by blocking
    flows over the shortest paths from patterns with words left to sources with room.
    """
    names, at = list(patterns), {s: i for i, s in enumerate(quotas)}
    size = [int(n) for n in patterns.values()]
    out = [[at[s] for s in p] for p in names]  # sources of each pattern
    flow: list[dict[int, int]] = [{} for _ in names]  # words from each pattern to its sources
    users: list[set[int]] = [set() for _ in quotas]  # patterns that send words to each source
    room, left = [int(q) for q in quotas.values()], [0] * len(names)

    def send(p: int, s: int, n: int) -> None:
        if now := flow[p].get(s, 0) + n:
            flow[p][s] = now
            users[s].add(p)
        else:
            del flow[p][s]
            users[s].discard(p)

    def level_graph() -> tuple[list[int], list[int]] | None:
        """Steps from patterns with words left to each pattern and source, up to the nearest source with room."""
        far_p, far_s = [-1] * len(names), [-1] * len(room)
        front = [p for p, n in enumerate(left) if n]
        for p in front:
            far_p[p] = 0
        step = 0
        while front:
            reached = []
            for p in front:
                for s in out[p]:
                    if far_s[s] < 0:
                        far_s[s] = step
                        reached.append(s)
            if any(room[s] for s in reached):
                return far_p, far_s
            step, front = step + 1, []
            for s in reached:
                for p in users[s]:
                    if far_p[p] < 0:
                        far_p[p] = step
                        front.append(p)
        return None

    def push(start: int, far_p: list[int], far_s: list[int], next_s: list[int], next_p: list[list[int]]) -> bool:
        """One path from pattern start to a source with room, along rising steps; dead ends are not tried again."""
        path = [start]  # pattern, source, pattern, ..., source
        while path:
            p = path[-1]
            if next_s[p] < len(out[p]):
                s = out[p][next_s[p]]
                if far_s[s] != far_p[p]:
                    next_s[p] += 1
                    continue
                if room[s]:
                    n = min([left[start], room[s], *(flow[path[i + 1]].get(path[i], 0) for i in range(1, len(path), 2))])
                    left[start] -= n
                    room[s] -= n
                    for i in range(0, len(path), 2):
                        send(path[i], path[i + 1] if i + 1 < len(path) else s, n)
                        if i:
                            send(path[i], path[i - 1], -n)
                    return True
                if next_p[s] is None:
                    next_p[s] = [q for q in users[s] if far_p[q] == far_s[s] + 1]
                while next_p[s] and not flow[next_p[s][-1]].get(s):
                    next_p[s].pop()
                if next_p[s]:
                    path += [s, next_p[s][-1]]
                    continue
                next_s[p] += 1
            else:
                path.pop()
                if path:
                    next_p[path.pop()].pop()
        return False

    for _ in range(copies):
        left = [n + k for n, k in zip(left, size)]
        while found := level_graph():
            next_s, next_p = [0] * len(names), [None] * len(room)
            for p, n in enumerate(left):
                while left[p] and n and push(p, *found, next_s, next_p):
                    pass
    return {p: sum(f.values()) for p, f in zip(names, flow)}


def take_plan(rows: DataFrame, quotas_of, copies: int = COPIES) -> tuple[DataFrame, dict, dict]:
    """(plan, sizes, quotas) for rows (pattern array<string>, size long, place long; materialised).

    quotas_of maps the sources' sizes to their targets. plan has a row per pattern: rounds (times that all documents are
    taken) and cut (documents with a place up to it are taken once more).
    """
    spark = rows.sparkSession
    totals = rows.groupBy("pattern").agg(F.sum("size").alias("size")).collect()  # a row per pattern
    patterns = {tuple(r.pattern): r.size for r in sorted(totals, key=lambda r: [(s is None, s or "") for s in r.pattern])}
    sizes: dict = {}
    for p, n in patterns.items():
        for s in p:
            sizes[s] = sizes.get(s, 0) + n
    quotas = quotas_of(sizes)
    sent = pattern_flows(patterns, {s: round(q) for s, q in quotas.items()}, copies)
    rest = {p: (sent[p] // n, sent[p] % n) if n else (0, 0) for p, n in patterns.items()}
    schema = "pattern array<string>, rounds int, want long, low long, before long"
    state = {p: [r, want, 0, 0] for p, (r, want) in rest.items()}
    for level in range(LEVELS):
        cuts = sized_broadcast(spark.createDataFrame([(list(p), *v) for p, v in state.items()], schema))
        width = 1 << (62 - BITS * (level + 1))
        inside = rows.join(cuts, "pattern").filter((F.col("want") > 0) & (F.col("place") >= F.col("low")) & (F.col("place") < F.col("low") + width * (1 << BITS)))
        bins = inside.groupBy("pattern", "want", "before", "low", F.floor((F.col("place") - F.col("low")) / F.lit(width)).alias("bin")).agg(F.sum("size").alias("n"))
        upto = F.sum("n").over(Window.partitionBy("pattern").orderBy("bin")) + F.col("before")
        first = bins.withColumn("upto", upto).filter("upto >= want").groupBy("pattern").agg(F.min(F.struct("bin", "low", F.col("upto") - F.col("n"))).alias("x"))
        for p, (b, low, before) in ((tuple(r.pattern), tuple(r.x)) for r in first.collect()):
            state[p][2:] = [low + b * width, before]
    cuts = sized_broadcast(spark.createDataFrame([(list(p), *v) for p, v in state.items()], schema))
    last = rows.join(cuts, "pattern").filter((F.col("want") > 0) & (F.col("place") >= F.col("low")) & (F.col("place") < F.col("low") + width))
    each = last.groupBy("pattern", "want", "before", "place").agg(F.sum("size").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("pattern").orderBy("place")) + F.col("before")
    # The cut is where the sum comes nearest to what is wanted.
    near = each.withColumn("upto", upto).filter("upto - n / 2 <= want").groupBy("pattern").agg(F.max("place").alias("cut"))
    found = {tuple(r.pattern): r.cut for r in near.collect()}
    plan = [(list(p), r, found.get(p, low - 1) if want else -1) for p, (r, want, low, _) in state.items()]
    return spark.createDataFrame(plan, "pattern array<string>, rounds int, cut long"), sizes, quotas


def mixture(docs: DataFrame, sources: Column, seed: int = 0, weights: tuple = WEIGHTS, share: float = SHARE, copies: int = COPIES) -> tuple[DataFrame, DataFrame, dict, dict]:
    """(rows, plan, sizes, quotas): rows has doc_id, pattern, size, place of each document of docs (doc_id, text).

    sources: each document's array of sources; repeats in it count once.
    """
    pattern = F.array_sort(F.array_distinct(F.coalesce(sources, F.array(F.lit(None).cast("string")))))
    rows = materialise(docs.select("doc_id", pattern.alias("pattern"), word_count(F.col("text")).alias("size"), seeded_order(seed).alias("place")))
    return rows, *take_plan(rows, lambda sizes: source_targets(sizes, weights, share, copies), copies)


def mixed_documents(docs: DataFrame, seed: int = 0) -> DataFrame:
    """doc_id, size, source_size, target and taken of every row of docs (doc_id, text, source)."""
    rows, plan, sizes, quotas = mixture(docs, F.array(F.col("source").cast("string")), seed)
    of = docs.sparkSession.createDataFrame([([s], sizes[s], float(quotas[s])) for s in sizes], "pattern array<string>, source_size long, target double")
    times = F.col("rounds") + (F.col("place") <= F.col("cut")).cast("int")
    joined = rows.join(sized_broadcast(plan.join(of, "pattern")), "pattern")
    return joined.select("doc_id", "size", "source_size", "target", (times * F.col("size")).cast("long").alias("taken"))


def mix(docs: DataFrame, seed: int = 0) -> DataFrame:
    """The rows of docs as often as the mix takes them: none, once or COPIES times."""
    _, plan, _, _ = mixture(docs, F.array(F.col("source").cast("string")), seed)
    p, o, r, c, n = fresh(docs, "_pattern", "_place", "_rounds", "_cut", "_copy")
    keyed = docs.withColumns({p: F.array(F.col("source").cast("string")), o: seeded_order(seed)})
    joined = keyed.join(sized_broadcast(plan.withColumnsRenamed({"pattern": p, "rounds": r, "cut": c})), p)
    times = F.col(r) + (F.col(o) <= F.col(c)).cast("int")
    return joined.withColumn(n, F.explode(F.array_repeat(F.lit(0), times))).select(*docs.columns)
