"""Queries over the driver's tables, each with the SQL that DuckDB runs for comparison."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from quern.functions import geometry, scoring, text
from quern.operators import components, extraction, gaps, jobs, ranking, raster, uploads

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
C = F.col


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def r6(c):
    return F.round(c, 6)


TRAPEZOID = "CASE WHEN {v} <= {a} OR {v} >= {d} THEN 0.0::double WHEN {v} < {b} THEN ({v} - {a})::double / ({b} - {a}) WHEN {v} > {c} THEN ({d} - {v})::double / ({d} - {c}) ELSE 1.0::double END"
RAMP = "CASE WHEN {v} <= {a} THEN 0.0::double WHEN {v} >= {b} THEN 1.0::double ELSE ({v} - {a})::double / ({b} - {a}) END"


@query(f"SELECT p_partkey, round({TRAPEZOID.format(v='p_size', a=2, b=10, c=35, d=48)}, 6) AS score FROM part")
def score_trapezoid(spark, d):
    return read(spark, d, "part").select("p_partkey", r6(scoring.trapezoid(C("p_size"), 2, 10, 35, 48)).alias("score"))


@query(f"SELECT l_orderkey, l_linenumber, l_partkey, round({RAMP.format(v='l_quantity', a=6, b=14)}, 6) AS score FROM lineitem")
def score_ramp(spark, d):
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", r6(scoring.ramp(C("l_quantity"), 6, 14)).alias("score"))


def _checked(df: DataFrame) -> DataFrame:
    """Each part as a crop: its size as share of 100, its sides, whether it touches a border, and its strokes."""
    ratio, strokes = C("p_size") / 100, C("p_partkey") % 4
    checks = [scoring.ink_ratio_check(ratio), scoring.size_check(C("p_size"), C("p_size") + 2), scoring.boundary_check(C("p_partkey") % 7 == 0), scoring.stroke_check(strokes, F.lit(1), F.lit(2))]
    confidence, warnings, valid = scoring.combined(checks)
    return df.select("p_partkey", confidence.alias("confidence"), warnings.alias("warnings"), valid.alias("valid"))


CHECKED = f"""s AS (SELECT p_partkey, {TRAPEZOID.format(v='(p_size / 100.0::double)', a=0.005, b=0.02, c=0.35, d=0.6)} AS s1, {RAMP.format(v='p_size', a=6, b=14)} AS s2,
  CASE WHEN p_partkey % 7 = 0 THEN 0.5::double ELSE 1.0::double END AS s3,
  CASE WHEN p_partkey % 4 = 0 OR p_partkey % 4 = 3 THEN 0.65::double ELSE 1.0::double END AS s4,
  CASE WHEN p_size / 100.0::double < 0.02 THEN 'Insufficient foreground pixels' ELSE 'Excessive noise' END AS w1,
  CASE WHEN p_partkey % 4 = 0 THEN 'Empty glyph' ELSE 'Unexpected number of disconnected strokes' END AS w4 FROM part),
w AS (SELECT p_partkey, round(s1 * s2 * s3 * s4, 4) AS confidence, list_filter([CASE WHEN s1 < 0.85 THEN w1 END, CASE WHEN s2 < 0.85 THEN 'Glyph is extremely small' END,
  CASE WHEN s3 < 0.85 THEN 'Glyph touches the crop boundary and may be cut off' END, CASE WHEN s4 < 0.85 THEN w4 END], lambda x: x IS NOT NULL) AS ws FROM s),
v AS (SELECT p_partkey, confidence, confidence >= 0.5 AND len(ws) = 0 AS valid,
  CASE WHEN len(ws) = 0 AND confidence < 0.5 THEN ['Overall confidence too low (' || printf('%.2f', confidence) || ')'] ELSE ws END AS ws FROM w)"""


@query(f"WITH {CHECKED} SELECT p_partkey, confidence, array_to_string(ws, '; ') AS warnings, valid FROM v")
def score_combine_validate(spark, d):
    return _checked(read(spark, d, "part")).withColumn("warnings", F.array_join("warnings", "; "))


@query(f"WITH {CHECKED}, c AS (SELECT CASE WHEN valid THEN 'valid' WHEN len(list_filter(ws, lambda x: starts_with(lower(x), 'empty glyph'))) > 0 THEN 'missing' ELSE 'warning' END AS status FROM v) SELECT status, count(*) AS n FROM c GROUP BY status")
def review_class_counts(spark, d):
    return _checked(read(spark, d, "part")).groupBy(scoring.review_class(C("valid"), C("warnings")).alias("status")).agg(F.count("*").alias("n"))


@query(f"WITH {CHECKED} SELECT p_partkey, coalesce(nullif(array_to_string(ws, '; '), ''), 'Confidence ' || printf('%.2f', confidence)) AS detail FROM v")
def warnings_join(spark, d):
    return _checked(read(spark, d, "part")).select("p_partkey", scoring.review_detail(C("warnings"), C("confidence")).alias("detail"))


@query("WITH l AS (SELECT l_orderkey, count(*) AS m, avg(l_discount) * 50 AS e FROM lineitem GROUP BY 1) SELECT o_orderkey, round(least(1.0::double, coalesce(m, 0) / 4.0::double) * greatest(0.0::double, 1 - coalesce(e, 0) / 8), 4) AS confidence FROM orders LEFT JOIN l ON l_orderkey = o_orderkey")
def confidence_coverage_accuracy(spark, d):
    lines = read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("m"), (F.avg("l_discount") * 50).alias("e"))
    both = read(spark, d, "orders").join(lines, C("o_orderkey") == C("l_orderkey"), "left")
    return both.select("o_orderkey", scoring.alignment_confidence(F.coalesce("m", F.lit(0)), F.lit(4.0), F.coalesce("e", F.lit(0.0))).alias("confidence"))


@query("SELECT user_id, value, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) = 1")
def dedup_keep_best(spark, d):
    return ranking.keep_best(read(spark, d, "events").select("user_id", "value", "event_id"), ["user_id"], "value", "event_id")


@query("""WITH r AS (SELECT user_id, event_id, value, arg_max(event_id, {v: value, s: -event_id}) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS now,
  arg_max(event_id, {v: value, s: -event_id}) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS was FROM events)
SELECT user_id, CASE WHEN now = event_id THEN was ELSE event_id END AS discarded_seq, now AS kept_seq FROM r WHERE was IS NOT NULL""")
def dedup_discard_log(spark, d):
    return ranking.discarded(read(spark, d, "events"), ["user_id"], "value", "event_id")


@query("WITH c AS (SELECT p_brand, p_type AS value, count(*) AS votes, min(p_partkey) AS f FROM part GROUP BY ALL) SELECT p_brand, value, votes FROM c QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY votes DESC, f) = 1")
def vote_mode_first_wins(spark, d):
    return ranking.vote(read(spark, d, "part"), ["p_brand"], C("p_type"), "p_partkey")


@query("WITH c AS (SELECT o_custkey, o_orderkey // 4 AS value, count(*) AS votes, min(o_orderkey) AS f FROM orders GROUP BY ALL) SELECT o_custkey, value, votes FROM c QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY votes DESC, f) = 1")
def vote_integer_bucket(spark, d):
    return ranking.vote(read(spark, d, "orders"), ["o_custkey"], F.expr("o_orderkey div 4"), "o_orderkey")


@query("""WITH m AS (SELECT user_id, median(value) AS m FROM events GROUP BY 1), e AS (SELECT e.user_id, event_id, value, m, lag(value) OVER (PARTITION BY e.user_id ORDER BY value, event_id) AS p FROM events e JOIN m USING (user_id)),
r AS (SELECT user_id, event_id, value, sum(CASE WHEN value - p > 0.02 * m THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY value, event_id ROWS UNBOUNDED PRECEDING) AS row_id FROM e)
SELECT user_id, event_id, row_id::bigint AS row_id, row_number() OVER (PARTITION BY user_id ORDER BY row_id, event_id, value) AS reading_order FROM r""")
def row_cluster_reading_order(spark, d):
    events = read(spark, d, "events").select("user_id", "event_id", "value")
    rows = events.join(events.groupBy("user_id").agg(F.median("value").alias("m")), "user_id")
    return ranking.clustered_rows(rows, ["user_id"], "value", "event_id", 0.02 * C("m"), "event_id").select("user_id", "event_id", "row_id", "reading_order")


MATCH = """WITH s AS (SELECT o_orderkey, o_custkey AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) AS i, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders),
c AS (SELECT l_partkey, l_orderkey AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS i, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem)"""


def _sides(spark, d):
    left = read(spark, d, "orders").select("o_orderkey", C("o_custkey").alias("k"), "o_totalprice")
    return left, read(spark, d, "lineitem").select("l_partkey", "l_linenumber", "l_suppkey", C("l_orderkey").alias("k"))


@query(MATCH + " SELECT k, i AS position, o_orderkey, l_partkey FROM s JOIN c USING (k, i, n)")
def positional_match(spark, d):
    """A customer's orders against the lines of the order of that number, where there are as many."""
    matched = ranking.matched_by_position(*_sides(spark, d), ["k"], ["o_totalprice", "o_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey"])
    return matched.select("k", "position", "o_orderkey", "l_partkey")


@query("WITH s AS (SELECT o_custkey AS k, count(*) AS found FROM orders GROUP BY 1), c AS (SELECT l_orderkey AS k, count(*) AS expected FROM lineitem GROUP BY 1) SELECT k, coalesce(found, 0) AS found, coalesce(expected, 0) AS expected, coalesce(found, 0) = coalesce(expected, 0) AS matches FROM s FULL JOIN c USING (k)")
def positional_match_guard(spark, d):
    return ranking.position_counts(*_sides(spark, d), ["k"])


@query("SELECT p_partkey, p_name FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 50)")
def semi_valid_only(spark, d):
    parts = read(spark, d, "part").select(F.lit(0).alias("job_id"), C("p_partkey").alias("character_id"), "p_name")
    verdicts = read(spark, d, "lineitem").select(F.lit(0).alias("job_id"), C("l_partkey").alias("character_id"), (C("l_quantity") >= 50).alias("valid"))
    return jobs.only_valid(parts, verdicts).select(C("character_id").alias("p_partkey"), "p_name")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 450000)")
def anti_unknown_ids(spark, d):
    known = read(spark, d, "orders").filter("o_totalprice > 450000").select(C("o_custkey").alias("character_id"))
    return jobs.unknown_ids(read(spark, d, "customer").select(C("c_custkey").alias("character_id")), known).select(C("character_id").alias("c_custkey"))


@query("""SELECT c_custkey, CASE WHEN substr(c_name, 1 + (c_custkey % 10)::int, 1) IN ('i', 'j', ':', ';', '"') THEN 2 ELSE 1 END AS most FROM customer""")
def lookup_with_default(spark, d):
    _, most = scoring.expected_strokes(F.substr("c_name", (1 + C("c_custkey") % 10).cast("int"), F.lit(1)))
    return read(spark, d, "customer").select("c_custkey", most.alias("most"))


@query("SELECT l.doc_id, CASE WHEN x.doc_id IS NOT NULL THEN 0 ELSE quality END AS quality FROM labels l LEFT JOIN (SELECT DISTINCT doc_id FROM documents WHERE n_chars < 500) x USING (doc_id)")
def force_override(spark, d):
    verdicts = read(spark, d, "labels").select(F.lit(0).alias("job_id"), C("doc_id").alias("character_id"), (C("quality") == 1).alias("valid"), F.array().cast("array<string>").alias("warnings"))
    out = read(spark, d, "documents").filter("n_chars < 500").select(F.lit(0).alias("job_id"), C("doc_id").alias("character_id"))
    return jobs.excluded(verdicts, out).select(C("character_id").alias("doc_id"), C("valid").cast("int").alias("quality"))


@query("SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) = 1")
def upsert_latest(spark, d):
    e = read(spark, d, "events").select("user_id", "event_type", "event_id", "value")
    return ranking.upserted(e.filter("event_id % 2 = 0"), e.filter("event_id % 2 = 1"), ["user_id", "event_type"], "event_id")


@query("SELECT user_id, event_type AS state, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) = 1")
def latest_status(spark, d):
    e = read(spark, d, "events").select("user_id", C("event_type").alias("state"), "event_id", "ts")
    return ranking.keep_best(e, ["user_id"], "ts", "event_id").drop("ts")


@query("SELECT o_custkey, o_orderkey FROM orders QUALIFY o_totalprice >= 0.40::double * max(o_totalprice) OVER (PARTITION BY o_custkey)")
def relative_max_filter(spark, d):
    return ranking.near_largest(read(spark, d, "orders"), ["o_custkey"], "o_totalprice", 0.40).select("o_custkey", "o_orderkey")


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE NOT (l_quantity * 20 <= 10 OR l_extendedprice / 100 <= 10 OR l_quantity * 20 + 15 >= 1000 - 10 OR l_extendedprice / 100 + 15 >= 1000 - 10)")
def border_filter(spark, d):
    boxes = read(spark, d, "lineitem").withColumns({"x": C("l_quantity") * 20, "y": C("l_extendedprice") / 100, "w": F.lit(15), "h": F.lit(15), "width": F.lit(1000), "height": F.lit(1000)})
    return raster.away_from_border(boxes).select("l_orderkey", "l_linenumber", "l_partkey")


@query("SELECT l_partkey, min(l_quantity) AS x0, min(l_extendedprice) AS y0, max(l_quantity) + 1 AS x1, max(l_extendedprice) + 1 AS y1, count(*) AS area FROM lineitem GROUP BY 1")
def bbox_aggregate(spark, d):
    runs = read(spark, d, "lineitem").select(C("l_partkey").alias("image"), C("l_extendedprice").alias("y"), C("l_quantity").alias("x0"), (C("l_quantity") + 1).alias("x1"))
    return raster.measures(runs).select(C("image").alias("l_partkey"), "x0", "y0", "x1", "y1", C("ink").cast("long").alias("area"))


@query("""WITH b AS (SELECT l_orderkey, l_linenumber, l_partkey % 200 AS x, l_suppkey % 300 AS y, l_quantity AS w, 10 + l_linenumber AS h FROM lineitem),
p AS (SELECT *, lag(x) OVER o AS px, lag(y) OVER o AS py, lag(w) OVER o AS pw, lag(h) OVER o AS ph FROM b WINDOW o AS (PARTITION BY l_orderkey ORDER BY l_linenumber, x, y, w))
SELECT l_orderkey, l_linenumber, x, y, round(sqrt(greatest(px - (x + w), x - (px + pw), 0) ** 2 + greatest(py - (y + h), y - (py + ph), 0) ** 2), 4) AS gap FROM p WHERE px IS NOT NULL""")
def box_edge_gaps(spark, d):
    """Every line of an order as a box: how far its edges are from those of the line before."""
    size = {"x": C("l_partkey") % 200, "y": C("l_suppkey") % 300, "w": C("l_quantity"), "h": 10 + C("l_linenumber")}
    boxes = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", *(c.alias(n) for n, c in size.items()))
    by = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "x", "y", "w")
    pairs = boxes.withColumns({f"_{n}": F.lag(n).over(by) for n in size}).filter("_x is not null")
    gap = geometry.edge_gap(*(C(n) for n in size), *(C(f"_{n}") for n in size))
    return pairs.select("l_orderkey", "l_linenumber", "x", "y", F.round(gap, 4).alias("gap"))


@query("SELECT a.s_suppkey AS a, b.s_suppkey AS b, round(abs(a.s_acctbal - b.s_acctbal), 2) AS distance FROM supplier a JOIN supplier b ON a.s_suppkey < b.s_suppkey AND abs(a.s_acctbal - b.s_acctbal) < 50")
def range_self_join_gap(spark, d):
    return gaps.near_pairs(read(spark, d, "supplier"), [], "s_suppkey", "s_acctbal", 50).withColumn("distance", F.round("distance", 2))


@query("""WITH o AS (SELECT s_nationkey, s_suppkey, s_acctbal, lag(s_acctbal) OVER w AS p FROM supplier WINDOW w AS (PARTITION BY s_nationkey ORDER BY s_acctbal, s_suppkey)),
r AS (SELECT *, sum(CASE WHEN s_acctbal - p >= 800 THEN 1 ELSE 0 END) OVER (PARTITION BY s_nationkey ORDER BY s_acctbal, s_suppkey ROWS UNBOUNDED PRECEDING) AS run FROM o)
SELECT s_nationkey, min(s_suppkey) AS "group", count(*) AS n, min(s_acctbal) AS low, max(s_acctbal) AS high FROM r GROUP BY s_nationkey, run""")
def connected_components_merge(spark, d):
    """Suppliers of a nation that chain within 800 of one another, as connected components."""
    rows = read(spark, d, "supplier").select("s_nationkey", "s_suppkey", "s_acctbal")
    near = gaps.chain(rows, ["s_nationkey"], "s_suppkey", "s_acctbal", 800)
    found = components.components(rows, near, ["s_nationkey"], "s_suppkey")
    each = rows.join(found, ["s_nationkey", "s_suppkey"])
    return each.groupBy("s_nationkey", C("component").alias("group")).agg(F.count("*").alias("n"), F.min("s_acctbal").alias("low"), F.max("s_acctbal").alias("high"))


OTSU = """h AS (SELECT p_brand, p_size AS v, count(*)::double AS n FROM part GROUP BY ALL),
c AS (SELECT p_brand, v, sum(n) OVER u AS w, sum(n * v) OVER u AS s, sum(n) OVER (PARTITION BY p_brand) AS tw, sum(n * v) OVER (PARTITION BY p_brand) AS ts FROM h WINDOW u AS (PARTITION BY p_brand ORDER BY v)),
b AS (SELECT p_brand, v, CASE WHEN w < tw THEN round(w * (tw - w) * (s / w - (ts - s) / (tw - w)) * (s / w - (ts - s) / (tw - w)), 3) ELSE 0 END AS b FROM c),
t AS (SELECT p_brand, v AS threshold FROM b QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY b DESC, v) = 1)"""


@query(f"WITH {OTSU} SELECT p_brand, threshold FROM t")
def otsu_threshold(spark, d):
    return ranking.otsu(read(spark, d, "part"), ["p_brand"], "p_size")


@query(f"WITH {OTSU} SELECT p_partkey, CASE WHEN p_size <= threshold THEN 255 ELSE 0 END AS ink FROM part JOIN t USING (p_brand)")
def otsu_binarize(spark, d):
    parts = read(spark, d, "part")
    return parts.join(ranking.otsu(parts, ["p_brand"], "p_size"), "p_brand").select("p_partkey", F.when(C("p_size") <= C("threshold"), 255).otherwise(0).alias("ink"))


@query("SELECT event_type, round(1.4::double * median(value), 6) AS gap FROM events GROUP BY 1")
def median_threshold(spark, d):
    return ranking.row_gaps(read(spark, d, "events"), ["event_type"], "value", 1.4).withColumn("gap", r6(C("gap")))


@query("SELECT l_orderkey, round(CASE WHEN count(*) FILTER (l_discount <= 0.05) >= greatest(4, round_even(count(*) * 0.5::double, 0)) THEN avg(l_quantity) FILTER (l_discount <= 0.05) ELSE avg(l_quantity) END, 6) AS error FROM lineitem GROUP BY 1")
def inlier_mean_with_fallback(spark, d):
    return read(spark, d, "lineitem").groupBy("l_orderkey").agg(r6(scoring.inlier_mean(C("l_quantity"), C("l_discount") <= 0.05, 4, 0.5)).alias("error"))


@query("SELECT s_nationkey, arg_min(s_suppkey, {v: round(s_acctbal + s_suppkey, 2), k: s_suppkey}) AS tl, arg_max(s_suppkey, {v: round(s_acctbal + s_suppkey, 2), k: -s_suppkey}) AS br, arg_min(s_suppkey, {v: round(s_acctbal - s_suppkey, 2), k: s_suppkey}) AS tr, arg_max(s_suppkey, {v: round(s_acctbal - s_suppkey, 2), k: -s_suppkey}) AS bl FROM supplier GROUP BY 1")
def order_points_extremes(spark, d):
    return extraction.ordered_corners(read(spark, d, "supplier"), ["s_nationkey"], C("s_suppkey"), C("s_acctbal"), C("s_suppkey"))


@query("SELECT p_partkey, (p_partkey // 56 + 1)::int AS page, (p_partkey % 56 // 7)::int AS row, (p_partkey % 7)::int AS col, 42.0::double + (p_partkey % 7) * 62 AS x, 725.0::double - (p_partkey % 56 // 7) * 72 AS y FROM part")
def grid_layout(spark, d):
    page, row, col = geometry.grid_cell(C("p_partkey"), 7, 8)
    return read(spark, d, "part").select("p_partkey", page.alias("page"), row.alias("row"), col.alias("col"), (42.0 + col * 62).alias("x"), (725.0 - row * 72).alias("y"))


@query("SELECT r_regionkey AS page, c AS corner, r_regionkey * 4 + c AS marker_id FROM region, range(0, 4) t(c)")
def marker_cross(spark, d):
    # Four corners a page, fixed: an explode, not a join.
    return read(spark, d, "region").select(C("r_regionkey").alias("page"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(3).cast("bigint"))).alias("corner")).withColumn("marker_id", C("page") * 4 + C("corner"))


@query("""WITH b AS (SELECT p_partkey, p_size * 8.0::double * 200 / 72 AS x, (842 - (p_retailprice / 4 + 62)) * 200 / 72 AS y FROM part)
SELECT p_partkey, greatest(0, round_even(x, 0)::int - 6) AS x0, least(1654, round_even(x + 144, 0)::int + 6) AS x1, greatest(0, round_even(y, 0)::int - 6) AS y0, least(2339, round_even(y + 172, 0)::int + 6) AS y1 FROM b""")
def box_transform_clamp(spark, d):
    x, y = geometry.pixels(C("p_size") * 8.0, 200), geometry.flipped_y(C("p_retailprice") / 4, F.lit(62), F.lit(842), 200)
    (x0, x1), (y0, y1) = geometry.clamped(x, F.lit(144), 6, F.lit(1654)), geometry.clamped(y, F.lit(172), 6, F.lit(2339))
    return read(spark, d, "part").select("p_partkey", x0.alias("x0"), x1.alias("x1"), y0.alias("y0"), y1.alias("y1"))


@query("SELECT p_partkey, round(least((CASE WHEN p_size % 2 = 0 THEN 300.0::double ELSE 200.0::double END) / (p_retailprice / 10), 400.0::double / p_size), 6) AS scale FROM part")
def fit_scale_place(spark, d):
    return read(spark, d, "part").select("p_partkey", r6(geometry.fit_scale(C("p_size"), C("p_retailprice") / 10, F.when(C("p_size") % 2 == 0, 300.0).otherwise(200.0), 400)).alias("scale"))


@query("SELECT l_partkey, round_even(max(l_quantity) - min(l_quantity) + 80, 0)::int AS advance, 40 - min(l_quantity) AS shift FROM lineitem GROUP BY 1")
def advance_width(spark, d):
    wide, shift = geometry.advance(C("x0"), C("x1"), 40)
    bounds = read(spark, d, "lineitem").groupBy("l_partkey").agg(F.min("l_quantity").alias("x0"), F.max("l_quantity").alias("x1"))
    return bounds.select("l_partkey", wide.alias("advance"), shift.alias("shift"))


@query("""WITH c AS (SELECT p_partkey, p_name[1:1] AS c FROM part), k AS (SELECT *, CASE WHEN regexp_matches(c, '^[A-Z]$') THEN 'uppercase' WHEN regexp_matches(c, '^[a-z]$') THEN 'lowercase' WHEN regexp_matches(c, '^[0-9]$') THEN 'digit' ELSE 'punctuation' END AS kind FROM c)
SELECT p_partkey, kind, kind IN ('uppercase', 'digit') OR (kind = 'lowercase' AND contains('bdfhijklt', c)) OR (kind = 'punctuation' AND contains('()[]"''', c)) AS tall, contains('gjpqy,', c) AS descender FROM k""")
def glyph_class(spark, d):
    c = F.substring("p_name", 1, 1)
    return read(spark, d, "part").select("p_partkey", text.category(c).alias("kind"), text.is_tall(c, text.category(c)).alias("tall"), text.is_descender(c).alias("descender"))


@query("SELECT c_custkey, printf('U+%04X', unicode(c_mktsegment[1:1])) AS codepoint FROM customer")
def codepoint_format(spark, d):
    return read(spark, d, "customer").select("c_custkey", text.codepoint(F.substring("c_mktsegment", 1, 1)).alias("codepoint"))


@query("SELECT p_partkey, CASE WHEN starts_with(p_brand, 'Brand#') AND length(p_brand) > 6 THEN p_brand[7:] ELSE p_brand END AS caption FROM part")
def caption_prefix_strip(spark, d):
    return read(spark, d, "part").select("p_partkey", text.without_prefix(C("p_brand"), "Brand#").alias("caption"))


@query("SELECT s_suppkey, coalesce(nullif(regexp_replace(s_name, '[^\\p{L}\\p{N}]', '', 'g'), ''), 'Font') || '-Regular' AS name FROM supplier")
def postscript_name(spark, d):
    return read(spark, d, "supplier").select("s_suppkey", text.postscript_name(C("s_name"), F.lit("Regular")).alias("name"))


@query("SELECT c_custkey, regexp_full_match(md5(c_name), '[0-9a-f]{32}') AS job, regexp_full_match(c_name, '[A-Za-z0-9_]+') AS template FROM customer")
def id_regex_gate(spark, d):
    return read(spark, d, "customer").select("c_custkey", text.is_job_id(F.md5("c_name")).alias("job"), text.is_template_id(C("c_name")).alias("template"))


@query("SELECT doc_id, CASE WHEN n_chars > 15000 THEN 'too large (' || printf('%.1f', n_chars / 1048576.0::double) || ' MB of 0 MB)' WHEN coalesce(n_chars, 0) = 0 THEN 'empty' WHEN source NOT IN ('src0', 'src1', 'src2') THEN 'type' END AS rejected FROM documents")
def mime_size_gate(spark, d):
    return read(spark, d, "documents").select("doc_id", uploads.rejection(C("n_chars"), C("source").isin("src0", "src1", "src2"), 15000).alias("rejected"))


@query("SELECT o_custkey, array_to_string(list_sort(list(o_orderkey)), ',') AS orders, count(*) AS n FROM orders GROUP BY 1")
def nested_document_build(spark, d):
    """Customers with all their orders nested, a row each."""
    ids = F.array_join(F.array_sort(F.collect_list("o_orderkey")).cast("array<string>"), ",")
    return read(spark, d, "orders").groupBy("o_custkey").agg(F.nullif(ids, F.lit("")).alias("orders"), F.count("*").alias("n"))


#: Orders that are nested together before they are taken apart again: a range of ids.
RANGE = 65536


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM orders")
def nested_document_explode(spark, d):
    nested = read(spark, d, "orders").groupBy("o_custkey", F.expr(f"o_orderkey div {RANGE}").alias("block")).agg(F.collect_list(F.struct("o_orderkey", "o_totalprice")).alias("elements"))
    return nested.select("o_custkey", F.inline("elements"))


@query("SELECT toxic, doc_id // 4096 AS block, coalesce(array_to_string(list_sort(list(doc_id) FILTER (quality = 1)), ','), '') AS valid_ids, coalesce(array_to_string(list_sort(list(doc_id) FILTER (quality = 0)), ','), '') AS invalid_ids FROM labels GROUP BY 1, 2")
def sorted_id_lists(spark, d):
    def ids(q):
        return F.array_join(F.array_sort(F.collect_list(F.when(C("quality") == q, C("doc_id")))).cast("array<string>"), ",")

    # A list holds a range of ids, so that none grows with the table.
    return read(spark, d, "labels").groupBy("toxic", F.expr("doc_id div 4096").alias("block")).agg(ids(1).alias("valid_ids"), ids(0).alias("invalid_ids"))


@query("SELECT event_id, coalesce(json_extract_string(props, '$.k'), 'none') AS k, coalesce(json_extract_string(props, '$.family'), 'Default') AS family FROM events")
def json_extract_default(spark, d):
    return read(spark, d, "events").select("event_id", text.json_field(C("props"), "k", "none").alias("k"), text.json_field(C("props"), "family", "Default").alias("family"))


@query("SELECT toxic, (count(*) FILTER (quality = 1)) || ' of ' || count(*) || ' requested characters' AS coverage, CASE WHEN count(*) FILTER (quality = 0) > 0 THEN (count(*) FILTER (quality = 0)) || ' character(s) need a clearer rewrite and were left out of this font.' ELSE 'Every requested character was included.' END AS note FROM labels GROUP BY 1")
def readme_coverage_text(spark, d):
    good, bad = F.count_if(C("quality") == 1), F.count_if(C("quality") == 0)
    return read(spark, d, "labels").groupBy("toxic").agg(text.coverage(good, F.count("*")).alias("coverage"), text.coverage_note(bad).alias("note"))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' ORDER BY o_totalprice DESC, o_orderkey LIMIT 1")
def early_top1(spark, d):
    return read(spark, d, "orders").filter("o_orderstatus = 'F'").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(1).select("o_orderkey", "o_totalprice")


@query("WITH a AS (SELECT DISTINCT toxic, doc_id FROM labels), b AS (SELECT DISTINCT 0 AS toxic, doc_id FROM documents WHERE lang = 'de') (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL (SELECT * FROM b EXCEPT SELECT * FROM a)")
def set_toggle(spark, d):
    marks = read(spark, d, "documents").filter("lang = 'de'").select(F.lit(0).alias("toxic"), "doc_id")
    return jobs.toggled(read(spark, d, "labels"), marks, ["toxic", "doc_id"])
