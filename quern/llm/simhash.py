"""SimHash fingerprints and their links within a Hamming budget, by a binary-trie self-join.

Distribution: two 64-bit values that differ in at most d bits agree on one of d + 1 segments, so each distinct value goes
to d + 1 tries, one for each segment's value, and every trie is joined with itself in some task. A trie of more than
TRIE_LEAVES values is cut into pieces, and each pair of pieces is a task of its own: no group grows with the data.

Inside a task all tries are traversed together, level by level: a pair of nodes carries the bits that differ so far and
is dropped once they exceed the budget. Links become a forest in the task, so a dense group of m values gives m - 1 edges.

Near copies (keep_one_of_each) need a wide budget, for which segments are too short to deal rows out by. There, rows that
share one of KEYS min-hashes of their shingles meet in a trie (a pair of similarity 0.8 shares none of 4 in one case of
600); the trie's pairs within COPY_BITS are candidates, and the shingle sets of both sides decide exactly. Rows of a min-hash
that many rows have (a passage in many texts, thousands of near copies) meet by BANDS pairs of further min-hashes instead, of
which such a pair shares none in one case of 1,200; what is crowded even then is cut into pieces, every pair of which is a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import chunks, fresh, materialise, shuffle_parts, sized_broadcast, small_batches, small_enough, utf8
from quern.llm.components import components

#: Leaves of a trie, or of a pair of its pieces, that one task joins at once.
TRIE_LEAVES = 2048
#: Pairs of nodes that a traversal expands to at a time; more are taken in turns. Every level of the trie may hold as many
#: (18 bytes each), and a Python worker shares its executor's memory.
PAIRS = 1 << 15
#: Bits by which the traversal descends at a time.
STEP = 4
#: Min-hashes that deal rows of similar texts out, and differing bits of 64 up to which a pair is compared by its shingles:
#: at a similarity of 0.8, 9.7 bits are expected and one pair of 300 has over 18.
KEYS, COPY_BITS = 4, 18
#: Pairs of further min-hashes for rows with a crowded one: at a similarity of 0.8 one pair of 1,200 shares none of 7.
BANDS = 7
#: Shingles of the rows of one group, or of a pair of its pieces, that a task may hold (8 bytes each; a longer text is alone).
GROUP_SHINGLES = 4_000_000
#: Tasks of all rows together up to which rows, with keys and tasks (some 250 bytes, and 12 for each task), are broadcast to
#: find their texts. Rows of a group that is cut have many tasks, so counting rows alone would bound nothing.
WIDE_TASKS = 100_000
#: Bytes of shingle sets that a task gathers before it compares them.
SET_BYTES = 16_000_000


def _majority(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Per document the 64 bits that are set in over half its hashes. counts: hashes of each document, none 0."""
    first = np.cumsum(counts) - counts
    # Sums in 8 byte lanes of a 64-bit word hold up to 255 hashes, so documents are cut into runs of 255.
    runs = (counts + 254) // 255
    run_first = np.repeat(first, runs) + 255 * (np.arange(runs.sum()) - np.repeat(np.cumsum(runs) - runs, runs))
    doc_run = np.cumsum(runs) - runs
    out = np.zeros(len(counts), dtype=np.uint64)
    for shift in range(8):
        lanes = np.add.reduceat((hashes >> np.uint64(shift)) & np.uint64(0x0101010101010101), run_first)
        per_byte = np.add.reduceat(lanes.astype("<u8").view(np.uint8).reshape(-1, 8).astype(np.int64), doc_run, axis=0)
        for byte in range(8):
            out |= (per_byte[:, byte] * 2 > counts).astype(np.uint64) << np.uint64(8 * byte + shift)
    return out


def _mixed(h: np.ndarray) -> np.ndarray:
    """Another, independent hash from the first (the splitmix64 finaliser)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles_of(text: bytes, size: int) -> list[bytes]:
    """Runs of size words, or the whole sequence if it is shorter. ASCII capitals are lowered; words are ASCII-space separated."""
    words = text.lower().split()
    if len(words) < size:
        return [b" ".join(words)] if words else []
    return list(map(b" ".join, zip(*(words[k:] for k in range(size)))))


def _hashes(texts: list[bytes], size: int, once: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all texts' shingles one after the other, how many of each text); once: repeats in a text count once."""
    hashes, counts, digest = [], np.zeros(len(texts), dtype=np.int64), xxhash.xxh64_intdigest
    for i, text in enumerate(texts):
        shingles = set(shingles_of(text, size)) if once else shingles_of(text, size)
        counts[i] = len(shingles)
        hashes += [digest(s, 42) for s in shingles]
    return np.array(hashes, dtype=np.uint64), counts


def _per_text(values: np.ndarray, counts: np.ndarray, reduce) -> np.ndarray:
    """reduce(values, first place) for each text with values, 0 for the others."""
    out, some = np.zeros(len(counts), dtype=np.uint64), counts > 0
    if some.any():
        out[some] = reduce(values, (np.cumsum(counts) - counts)[some])
    return out


def text_fingerprints(texts: list[bytes], size: int) -> np.ndarray:
    """The SimHash fingerprint of each text, repeated shingles included."""
    hashes, counts = _hashes(texts, size)
    return _per_text(hashes, counts, lambda h, _: _majority(h, counts[counts > 0]))


def fingerprints(docs: DataFrame, size: int = 4) -> DataFrame:
    """doc_id and fp (both long) of every row. Null text counts as empty; no words give fingerprint 0."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "fp": text_fingerprints(utf8(batch.column("text")), size).view(np.int64)})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


def copy_prints(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, _h (hash of the text), and of the text's shingle set: fp, n, same (hash of the set) and keys (KEYS min-hashes, then two for each band)."""
    small_batches(docs.sparkSession)
    width = KEYS + 2 * BANDS
    turns = _mixed(np.arange(1, width + 1, dtype=np.uint64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            h, n = _hashes(utf8(batch.column("text")), size, True)
            fp = _per_text(h, n, lambda x, _: _majority(x, n[n > 0]))
            same = _per_text(_mixed(h), n, np.add.reduceat)
            keys = np.stack([_per_text(_mixed(h ^ t), n, np.minimum.reduceat) for t in turns], axis=1)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, width * len(n) + 1, width, dtype=np.int32)), pa.array(keys.reshape(-1).view(np.int64)))
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "_h": batch.column("_h"), "fp": fp.view(np.int64), "n": n, "same": same.view(np.int64), "keys": lists})

    return docs.select("doc_id", "text", "_h").mapInArrow(run, "doc_id long, _h long, fp long, n long, same long, keys array<long>")


def _pairs(groups: np.ndarray, values: np.ndarray, budget: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs i < j with equal group whose values differ in at most budget bits. Sorted by (group, value).

    Node ids at a level number the distinct (group, value prefix); a pair of nodes starts at each trie's root. Below the
    last bits every row is a node of its own, so rows of equal value are paired too.
    """
    n = len(values)
    if n < 2:
        return
    fresh = np.concatenate([[True], groups[1:] != groups[:-1]])
    node, levels = np.cumsum(fresh) - 1, []
    roots = np.arange(node[-1] + 1)
    for shift in [*range(64 - STEP, -1, -STEP), None]:
        if shift is None:
            nibble, fresh = np.zeros(n, dtype=np.uint8), np.ones(n, dtype=bool)
        else:
            nibble = ((values >> np.uint64(shift)) & np.uint64((1 << STEP) - 1)).astype(np.uint8)
            fresh = fresh | np.concatenate([[True], nibble[1:] != nibble[:-1]])
        starts, own = np.flatnonzero(fresh), node[-1] + 1
        first = np.searchsorted(node[starts], np.arange(own + 1)).astype(np.int32)  # of each node's children
        levels.append((first, nibble[starts]))
        node = np.cumsum(fresh) - 1
    todo = [(0, roots, roots, np.zeros(len(roots), dtype=np.int16))]
    while todo:
        level, a, b, err = todo.pop()
        if level == len(levels):
            off = a < b
            yield a[off], b[off]
            continue
        first, label = levels[level]
        many = (first[a + 1] - first[a]).astype(np.int64) * (first[b + 1] - first[b])
        upto = np.cumsum(many)
        if len(a) > 1 and upto[-1] > PAIRS:
            cut = int(np.clip(np.searchsorted(upto, PAIRS), 1, len(a) - 1))
            todo += [(level, a[cut:], b[cut:], err[cut:]), (level, a[:cut], b[:cut], err[:cut])]
            continue
        who = np.repeat(np.arange(len(a)), many)
        at, nb = np.arange(len(who)) - np.repeat(upto - many, many), (first[b + 1] - first[b])[who]
        ca, cb = first[a][who] + at // nb, first[b][who] + at % nb
        e = err[who] + np.bitwise_count(label[ca] ^ label[cb])
        ok = (ca <= cb) & (e <= budget)
        if ok.any():
            todo.append((level + 1, ca[ok], cb[ok], e[ok]))


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (root, node) with the same components as the edges (a, b)."""
    if not len(a):
        return a, b
    nodes, back = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y, root = back[: len(a)], back[len(a) :], np.arange(len(nodes))
    while True:
        rx, ry = root[x], root[y]
        apart = rx != ry
        if not apart.any():
            break
        np.minimum.at(root, np.maximum(rx, ry)[apart], np.minimum(rx, ry)[apart])
        while (root[root] != root).any():
            root = root[root]
        x, y = x[apart], y[apart]
    own = root != np.arange(len(nodes))
    return nodes[root[own]], nodes[own]


def _segments(count: int) -> list[tuple[int, int]]:
    """(shift, bits) of count segments that make up 64 bits."""
    edges = [round(64 * i / count) for i in range(count + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def _dealt(rows: DataFrame, key: list[str], too_many: Column, pieces: Column, tell: list[str]) -> DataFrame:
    """rows with task: the hash of key, and for keys with too_many rows (an aggregate) of each pair of their pieces.

    Pieces are ranges of a hash of the columns tell; a row goes to every pair that its piece is in.
    """
    big = rows.groupBy(*key).agg(too_many.alias("_big"), pieces.cast("int").alias("_pieces")).filter("_big").drop("_big")
    rows = rows.join(sized_broadcast(materialise(big)), key, "left").withColumn("_pieces", F.coalesce("_pieces", F.lit(1)))
    rows = rows.withColumn("_piece", F.pmod(F.xxhash64(*tell), F.col("_pieces")).cast("int")).withColumn("_other", F.explode(F.expr("sequence(0, _pieces - 1)")))
    return rows.withColumn("task", F.xxhash64(*key, F.least("_piece", "_other"), F.greatest("_piece", "_other"))).drop("_pieces", "_piece", "_other")


def _columns(t: pa.Table) -> dict[str, np.ndarray]:
    return {c: t.column(c).to_numpy() for c in t.column_names}


def _by_task(batches: Iterator[pa.RecordBatch], most: int, most_bytes: int = 1 << 62) -> Iterator[dict[str, np.ndarray]]:
    """The columns of runs of whole tasks: about most rows or most_bytes at a time, or one larger task. Sorted by task and node.

    Of rows with equal task and node, only the first counts.
    """
    held, rows, size, last = [], 0, 0, (None, None)
    for batch in batches:
        if not batch.num_rows:
            continue
        task, node = (batch.column(c).to_numpy() for c in ("task", "node"))
        new = np.concatenate([[(task[0], node[0]) != last], (task[1:] != task[:-1]) | (node[1:] != node[:-1])])
        last = task[-1], node[-1]
        batch = batch if new.all() else batch.filter(pa.array(new))
        held.append(batch)
        rows, size = rows + batch.num_rows, size + batch.nbytes
        if rows < most and size < most_bytes:
            continue
        t = pa.Table.from_batches(held)
        task = t.column("task").to_numpy()
        end = int(np.searchsorted(task, task[-1]))  # the last task may go on
        if end:
            yield _columns(t.slice(0, end))
            rest = t.slice(end)
            held, rows, size = rest.to_batches(), rest.num_rows, rest.nbytes
    if held:
        yield _columns(pa.Table.from_batches(held))


def links(values: DataFrame, max_bits: int) -> DataFrame:
    """Edges (a, b) that connect the nodes of values (node long, fp long; materialised, each fp once) just as all links do.

    A link joins nodes whose fp differ in at most max_bits.
    """
    spark, segments = values.sparkSession, _segments(max_bits + 1)
    tries = F.array(*(F.struct(F.lit(i).alias("segment"), F.shiftrightunsigned("fp", s).bitwiseAND((1 << n) - 1).alias("value")) for i, (s, n) in enumerate(segments)))
    rows = values.withColumn("_t", F.explode(tries)).select("node", "fp", "_t.segment", "_t.value")
    rows = _dealt(rows, ["segment", "value"], F.count("*") > TRIE_LEAVES, F.ceil(F.count("*") * 2 / TRIE_LEAVES), ["fp"])
    turns = np.array([s for s, _ in segments], dtype=np.uint64), np.array([n for _, n in segments], dtype=np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in _by_task(batches, 4 * TRIE_LEAVES):
            task, node, fp = c["task"], c["node"], c["fp"].view(np.uint64)
            # The segment's bits are equal in a trie: rotate them to the end, where they cost one level.
            turn = (turns[0] + turns[1])[c["segment"]] % np.uint64(64)
            turned = np.where(turn > 0, (fp >> turn) | (fp << ((np.uint64(64) - turn) % np.uint64(64))), fp)
            order = np.lexsort((turned, task))
            for i, j in _pairs(task[order], turned[order], max_bits):
                a, b = _forest(node[order[i]], node[order[j]])
                yield pa.RecordBatch.from_pydict({"a": a, "b": b})

    # `task` must ascend for searchsorted; hashes compare as signed longs in Spark and NumPy alike.
    dealt = rows.select("task", "segment", "node", "fp").repartition(shuffle_parts(spark), "task").sortWithinPartitions("task", "node")
    return dealt.mapInArrow(run, "a long, b long").distinct()


def simhash_components(docs: DataFrame, size: int = 4, max_bits: int = 4) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row of docs (doc_id, text).

    Null and empty texts have fingerprint 0 and link like any other; repeated rows each keep their row. Any long is an id;
    null doc_ids link too, but name no component: a component without any other id has a null component_id.
    """
    prints = materialise(fingerprints(docs, size))
    # Nodes are numbers given in a written table, so that ids of any size, shared and null ones don't meet.
    values = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("id")).withColumn("node", F.monotonically_increasing_id()))
    found = materialise(components(links(values.select("node", "fp"), max_bits)))
    linked = materialise(values.join(sized_broadcast(found), "node").select("fp", "id", "component"))
    least = materialise(linked.groupBy("component").agg(F.min("id").alias("_least")))
    named = linked.join(sized_broadcast(least), "component").select("fp", "_least")
    groups = values.join(sized_broadcast(materialise(named)), "fp", "left").select("fp", F.coalesce("_least", "id").alias("component_id"))
    return prints.join(groups, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def row_hash() -> Column:
    return F.xxhash64("text")


def _candidates(c: dict[str, np.ndarray], similarity: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row pairs of a run of tasks that the tries find, that similar sizes allow, and that no earlier min-hash or band brings together.

    turn: the min-hash that a row is dealt by, or KEYS and the number of its band.
    """
    order = np.lexsort((c["node"], c["fp"].view(np.uint64), c["task"]))
    keys, turn, n = np.stack(c["keys"]), c["turn"], c["n"]
    for i, j in _pairs(c["task"][order], c["fp"].view(np.uint64)[order], COPY_BITS):
        i, j = order[i], order[j]
        ok = (np.minimum(n[i], n[j]) >= similarity * np.maximum(n[i], n[j])) & (c["node"][i] != c["node"][j])
        i, j = i[ok], j[ok]
        same, ok = keys[i] == keys[j], np.ones(len(i), dtype=bool)
        for k in range(KEYS - 1):
            ok &= (turn[i] <= k) | (turn[i] >= KEYS) | ~same[:, k]
        for b in range(BANDS - 1):
            ok &= (turn[i] <= KEYS + b) | ~(same[:, KEYS + 2 * b] & same[:, KEYS + 2 * b + 1])
        yield i[ok], j[ok]


def _similar(i: list[int], j: list[int], sets: list[np.ndarray], root: dict[int, int], similarity: float) -> Iterator[tuple[int, int]]:
    """The pairs that link parts not linked yet and whose sets are similar enough; root is a forest and grows with them."""

    def top(x: int) -> int:
        while (y := root.setdefault(x, x)) != x:
            root[x] = root[y]
            x = root[x]
        return x

    for a, b in zip(i, j):
        x, y = top(a), top(b)
        if x != y:
            both = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
            if both >= similarity * (len(sets[a]) + len(sets[b]) - both) - 1e-9:
                root[max(x, y)] = min(x, y)
                yield a, b


def copy_links(values: DataFrame, texts: DataFrame, size: int, similarity: float) -> DataFrame:
    """Edges (a, b) that connect nodes of values just as all pairs with similar shingle sets do.

    values: node, doc_id, _h, fp, n, keys; materialised, a row for each set. texts: doc_id, text, _h.
    """
    spark, kept = values.sparkSession, ["task", "turn", "node", "fp", "n", "keys"]
    rows = values.select("node", "fp", "n", "keys", F.posexplode(F.slice("keys", 1, KEYS)).alias("turn", "key"))
    # Rows with a frequent min-hash meet by bands; what is still too large is cut into pieces.
    crowded = (F.count("*") > TRIE_LEAVES) | (F.sum("n") > GROUP_SHINGLES)
    hot = sized_broadcast(materialise(rows.groupBy("turn", "key").agg(crowded.alias("_big")).filter("_big").drop("_big")))
    alone = rows.join(hot, ["turn", "key"], "left_anti").withColumn("task", F.xxhash64("turn", "key")).select(*kept)
    crowd = rows.join(hot, ["turn", "key"], "left_semi").select("node", "fp", "n", "keys").dropDuplicates(["node"])
    bands = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.struct((b + KEYS).alias("turn"), F.xxhash64(b + KEYS, F.get("keys", b * 2 + KEYS), F.get("keys", b * 2 + KEYS + 1)).alias("group")))
    pairs = crowd.withColumn("_b", F.explode(bands)).select("node", "fp", "n", "keys", "_b.turn", "_b.group")
    pieces = F.ceil(F.greatest(F.count("*") / TRIE_LEAVES, F.sum("n") / GROUP_SHINGLES) * 2)
    dealt = alone.unionByName(_dealt(pairs, ["group"], crowded, pieces, ["node"]).select(*kept))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in _by_task(batches, 4 * TRIE_LEAVES):
            some = np.zeros(len(c["task"]), dtype=bool)
            for i, j in _candidates(c, similarity):
                some[i] = some[j] = True
            yield pa.RecordBatch.from_pydict({k: c[k][some] for k in ("task", "turn", "node")})

    tasks = dealt.repartition(shuffle_parts(spark), "task").sortWithinPartitions("task", "node").mapInArrow(meet, "task long, turn int, node long")
    # A node's tasks are as many as min-hashes and bands, or as pairs of pieces of a frequent one.
    met = tasks.groupBy("node").agg(F.collect_set(F.struct("task", "turn")).alias("tasks"))
    met = materialise(met.join(values, "node").withColumnsRenamed({"doc_id": "_d", "_h": "_k"}))
    same = F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_h") == F.col("_k"))
    small_batches(spark)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in chunks(batches):
            new = [x not in seen and not seen.add(x) for x in batch.column("node").to_pylist()]  # rows may repeat
            batch = batch.filter(pa.array(new, pa.bool_()))
            if not batch.num_rows:
                continue
            h, n = _hashes(utf8(batch.column("text")), size, True)
            each = [np.sort(x).tobytes() for x in np.split(h, np.cumsum(n)[:-1])]
            columns = {c: batch.column(c) for c in ("tasks", "node", "fp", "n", "keys")}
            yield pa.RecordBatch.from_pydict({**columns, "shingles": pa.array(each, pa.binary())})

    few = small_enough(met.select(F.explode("tasks")), WIDE_TASKS)
    found = texts.join(F.broadcast(met) if few else met, same).select("text", "tasks", "node", "fp", "n", "keys")
    found = found.mapInArrow(sets, "tasks array<struct<task long, turn int>>, node long, fp long, n long, keys array<long>, shingles binary")
    found = found.withColumn("_t", F.explode("tasks")).select("_t.*", "node", "fp", "n", "keys", "shingles")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in _by_task(batches, 4 * TRIE_LEAVES, SET_BYTES):
            each = [np.frombuffer(x, dtype=np.uint64) for x in c["shingles"]]
            root: dict[int, int] = {}
            for i, j in _candidates(c, similarity):
                good = list(_similar(i.tolist(), j.tolist(), each, root, similarity))
                if good:
                    a, b = np.array(good).T
                    yield pa.RecordBatch.from_pydict({"a": c["node"][a], "b": c["node"][b]})

    found = found.repartition(shuffle_parts(spark), "task").sortWithinPartitions("task", "node")
    return found.mapInArrow(check, "a long, b long").distinct()


def keep_one_of_each(docs: DataFrame, size: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of docs without near copies: of each group the row with the smallest doc_id stays (null ids come last).

    Rows link when the Jaccard similarity of their sets of size-word shingles is at least similarity; groups are what links
    connect. Every link found is exact; a pair at the very threshold is missed in about one case of 200, however many rows
    share a min-hash (see KEYS, BANDS and COPY_BITS). Equal rows are copies, of which one stays; texts without words, null included, are copies of each other;
    texts of fewer than size words have one shingle, all of their words. An empty table stays empty.
    """
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", row_hash().alias("_h"))
    prints = materialise(copy_prints(named, size))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "_h")).alias("first")
    values = prints.groupBy("n", "same").agg(first, F.count("*").alias("rows"), F.first("fp").alias("fp"), F.first("keys").alias("keys"))
    values = materialise(values.withColumn("node", F.monotonically_increasing_id()))
    asked = values.select("node", "first.doc_id", "first._h", "fp", "n", "keys")
    found = materialise(components(copy_links(asked, named, size, similarity)))
    placed = values.join(sized_broadcast(found), "node", "left").select("n", "same", "first", "rows", F.coalesce("component", "node").alias("_g"))
    # Groups of one row, nearly all, need no more; a group's first row is an aggregate, not a window over the group.
    whole = materialise(placed.groupBy("_g").agg(F.min("first").alias("_keep"), F.sum("rows").alias("_n")).filter("_n > 1").drop("_n"))
    kept = materialise(placed.join(sized_broadcast(whole), "_g").select("n", "same", "_keep"))
    stays = F.col("doc_id").eqNullSafe(F.col("_keep.doc_id")) & (F.col("_h") == F.col("_keep._h"))
    rows = prints.join(sized_broadcast(kept), ["n", "same"]).groupBy("doc_id", "_h").agg(F.first(stays).alias("stays"), F.count("*").alias("n"))
    return drop_rows(docs, materialise(rows))


def drop_rows(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """docs without the rows that rows (doc_id, _h, stays, n; materialised) rejects; of n equal rows that stay, one is kept."""
    d, h = fresh(docs, "_d", "_dh")
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(d)) & (row_hash() == F.col(h))
    ids = [F.col("doc_id").alias(d), F.col("_h").alias(h)]
    kept = docs.join(sized_broadcast(rows.filter("not stays or n > 1").select(*ids)), same, "left_anti")
    again = rows.filter("stays and n > 1").select(*ids)
    if again.limit(1).count():
        kept = kept.unionByName(docs.join(sized_broadcast(again), same, "left_semi").dropDuplicates(["doc_id", "text"]))
    return kept
