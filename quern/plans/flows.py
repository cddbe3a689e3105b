"""Queries that run whole jobs: every vector is a plain page of 40 x 40 pixels whose marks are to be the first letters of the set."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators import delivery, flow, template
from quern.operators.components import shuffled
from quern.plans.catalogue import read
from quern.plans.rasters import PX, _runs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
C = F.col
#: A vector's pixel is ZOOM page pixels wide, and the page has a margin.
ZOOM, EDGE = 4, 4
PAGE = 8 * ZOOM + 2 * EDGE


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


def _done(spark: SparkSession, d: str) -> flow.Result:
    """A job for every vector: one page, on which label % 4 + 1 marks are expected."""
    vectors = read(spark, d, "embeddings").select(C("vec_id").alias("image"), "label")
    images = vectors.select(C("image").alias("job_id"), "image", F.lit(PAGE).alias("width"), F.lit(PAGE).alias("height"))
    runs = _runs(spark, d).withColumn("_dy", F.explode(F.sequence(F.lit(0), F.lit(ZOOM - 1))))
    runs = runs.select("image", (C("y") * ZOOM + EDGE + C("_dy")).cast("int").alias("y"), (C("x0") * ZOOM + EDGE).cast("int").alias("x0"), (C("x1") * ZOOM + EDGE).cast("int").alias("x1"))
    specs = template.characters(spark)
    wanted = vectors.select("image", F.explode(F.sequence(F.lit(1), (C("label") % 4 + 1).cast("int"))).alias("position"))
    expected = wanted.join(F.broadcast(specs.select((C("ord") + 1).alias("position"), "character_id")), "position")  # the character set
    return flow.plain_jobs(images, runs, expected, specs)


def _labelled(p: str, runs: str) -> str:
    """Components of runs (image, y, x0, x1), as parts and boxes."""
    return f"""{p}n AS (SELECT image, y, x0, x1, y * 1048576 + x0 AS id FROM {runs}),
{p}e AS (SELECT a.image, a.id AS a, b.id AS b FROM {p}n a JOIN {p}n b ON a.image = b.image AND abs(a.y - b.y) = 1 AND a.x0 <= b.x1 AND b.x0 <= a.x1),
{p}r AS (SELECT image, id, id AS root FROM {p}n UNION SELECT {p}r.image, {p}e.b, {p}r.root FROM {p}r JOIN {p}e ON {p}e.image = {p}r.image AND {p}e.a = {p}r.id),
{p}l AS (SELECT image, id, min(root) AS component FROM {p}r GROUP BY image, id),
{p}parts AS (SELECT n.image, n.y, n.x0, n.x1, l.component FROM {p}n n JOIN {p}l l USING (image, id)),
{p}box AS (SELECT image, component, min(x0) AS x, min(y) AS y, max(x1) - min(x0) AS w, max(y) + 1 - min(y) AS h, sum(x1 - x0)::bigint AS area FROM {p}parts GROUP BY image, component)"""


#: Marks: boxes that overlap or adjoin are one; rows are read by their centres.
MARKS = f"""{PX.replace("px AS", "RECURSIVE px AS", 1)}, z AS (SELECT image, y * {ZOOM} + {EDGE} + dy AS y, x0 * {ZOOM} + {EDGE} AS x0, x1 * {ZOOM} + {EDGE} AS x1 FROM runs, range({ZOOM}) t(dy)), {_labelled("a", "z")},
g2 AS (SELECT a.image, a.component AS a, b.component AS b FROM abox a JOIN abox b ON a.image = b.image AND a.component <> b.component AND sqrt(greatest(a.x - b.x - b.w, b.x - a.x - a.w, 0) ** 2 + greatest(a.y - b.y - b.h, b.y - a.y - a.h, 0) ** 2) < 0.018::double * {PAGE}),
rr AS (SELECT image, component AS id, component AS root FROM abox UNION SELECT rr.image, g2.b, rr.root FROM rr JOIN g2 ON g2.image = rr.image AND g2.a = rr.id),
ll AS (SELECT image, id, min(root) AS root FROM rr GROUP BY image, id),
mb AS (SELECT ll.image, ll.root AS component, min(x) AS x, min(y) AS y, max(x + w) - min(x) AS w, max(y + h) - min(y) AS h, min(y) + (max(y + h) - min(y)) / 2.0 AS yc FROM ll JOIN abox b ON b.image = ll.image AND b.component = ll.id GROUP BY 1, 2),
tall AS (SELECT image, 1.4::double * median(h) AS gap, count(*) AS found FROM mb GROUP BY 1),
rw AS (SELECT mb.*, gap, found, CASE WHEN yc - lag(yc) OVER (PARTITION BY image ORDER BY yc, component) > gap THEN 1 ELSE 0 END AS new FROM mb JOIN tall USING (image)),
rs AS (SELECT *, sum(new) OVER (PARTITION BY image ORDER BY yc, component ROWS UNBOUNDED PRECEDING) AS line FROM rw),
mk AS (SELECT image, x, y, w, h, row_number() OVER (PARTITION BY image ORDER BY line, x, yc, component) AS position FROM rs),
pg AS (SELECT vec_id AS image, label % 4 + 1 AS k, coalesce(found, 0) AS found FROM embeddings LEFT JOIN tall ON image = vec_id),
pages AS (SELECT image AS job_id, image AS source_image, found = k AS succeeded, CASE WHEN found = 0 THEN 'no handwriting found' WHEN found <> k THEN 'found ' || found || ' characters, expected ' || k END AS error, CASE WHEN found = k THEN found ELSE 0 END AS glyphs_extracted FROM pg)"""


@query(f"WITH {MARKS} SELECT * FROM pages")
def flow_plain_pages(spark, d):
    """Outcomes of all pages."""
    return _done(spark, d).pages


CHECK = "CASE WHEN {v} <= 0.005 OR {v} >= 0.6 THEN 0.0::double WHEN {v} < 0.02 THEN ({v} - 0.005::double) / (0.02::double - 0.005::double) WHEN {v} > 0.35 THEN (0.6::double - {v}) / (0.6::double - 0.35::double) ELSE 1.0::double END".format(v="(ink / (width * height)::double)")
JUDGED = f"""{MARKS}, win AS (SELECT image * 100 + position AS glyph, image, position, greatest(0, x - 10) AS x, greatest(0, y - 10) AS y, least({PAGE}, x + w + 10) - greatest(0, x - 10) AS width, least({PAGE}, y + h + 10) - greatest(0, y - 10) AS height FROM mk JOIN pages ON image = job_id WHERE succeeded),
cut AS (SELECT glyph AS image, z.y - win.y AS y, greatest(0, x0 - win.x) AS x0, least(width, x1 - win.x) AS x1 FROM win JOIN z ON z.image = win.image AND z.y >= win.y AND z.y < win.y + height AND x1 > win.x AND x0 < win.x + width), {_labelled("b", "cut")},
top AS (SELECT image, max(area) AS top FROM bbox GROUP BY 1), cl AS (SELECT p.* FROM bparts p JOIN bbox USING (image, component) JOIN top USING (image) WHERE area >= 0.40::double * top),
m AS (SELECT image AS glyph, sum(x1 - x0)::bigint AS ink, min(x0) AS x0, min(y) AS y0, max(x1) AS x1, max(y) + 1 AS y1, count(DISTINCT component) AS n FROM cl GROUP BY 1),
k AS (SELECT win.image AS job_id, position, {CHECK} AS s1, least(x1 - x0, y1 - y0) AS side, ink / (width * height)::double AS share, x0 <= 2 OR y0 <= 2 OR x1 >= width - 2 OR y1 >= height - 2 AS touch, n FROM win JOIN m USING (glyph)),
t AS (SELECT *, CASE WHEN side <= 6 THEN 0.0::double WHEN side >= 14 THEN 1.0::double ELSE (side - 6) / 8.0::double END AS s2, CASE WHEN touch THEN 0.5::double ELSE 1.0::double END AS s3, greatest(0, 1 - 0.35::double * (n - 1)) AS s4 FROM k),
w AS (SELECT job_id, position, round(s1 * s2 * s3 * s4, 4) AS confidence, list_filter([CASE WHEN s1 < 0.85 THEN CASE WHEN share < 0.02 THEN 'Insufficient foreground pixels' ELSE 'Excessive noise' END END, CASE WHEN s2 < 0.85 THEN 'Glyph is extremely small' END,
  CASE WHEN s3 < 0.85 THEN 'Glyph touches the crop boundary and may be cut off' END, CASE WHEN s4 < 0.85 THEN 'Unexpected number of disconnected strokes' END], lambda x: x IS NOT NULL) AS ws FROM t),
verdicts AS (SELECT job_id, 'uppercase_' || substr('ABCD', position::int, 1) AS character_id, confidence, confidence >= 0.5 AND len(ws) = 0 AS valid, CASE WHEN len(ws) = 0 AND confidence < 0.5 THEN 'Overall confidence too low (' || printf('%.2f', confidence) || ')' ELSE array_to_string(ws, '; ') END AS warnings FROM w),
counts AS (SELECT job_id, count(*) FILTER (valid) AS valid, count(*) FILTER (NOT valid) AS invalid FROM verdicts GROUP BY 1),
jobs AS (SELECT job_id, CASE WHEN coalesce(valid, 0) = 0 THEN 'failed' ELSE 'completed' END AS state, 1 AS pages, CASE WHEN succeeded THEN 0 ELSE 1 END AS failed_pages, coalesce(valid, 0) AS valid, coalesce(invalid, 0) AS invalid,
  CASE WHEN valid IS NULL THEN 'no pages processed' WHEN valid = 0 THEN 'no valid glyphs' END AS error FROM pages LEFT JOIN counts USING (job_id))"""


@query(f"WITH {JUDGED} SELECT job_id, character_id, confidence, valid, warnings FROM verdicts")
def flow_plain_verdicts(spark, d):
    """Every glyph of every page whose marks are as many as expected: cut out, cleaned and judged."""
    return _done(spark, d).validations.select("job_id", "character_id", "confidence", "valid", F.array_join("warnings", "; ").alias("warnings"))


@query(f"WITH {JUDGED} SELECT * FROM jobs")
def flow_plain_jobs(spark, d):
    """State and counts of all jobs."""
    return _done(spark, d).jobs


@query(f"""WITH {JUDGED}, o AS (SELECT job_id, state, CASE WHEN state = 'completed' AND job_id % 3 = 0 THEN 'missing: pdf' ELSE error END AS error, valid FROM jobs)
SELECT job_id, CASE WHEN error IS NULL THEN 'completed' ELSE 'failed' END AS state, error, CASE WHEN state = 'completed' THEN valid ELSE 0 END AS drawings, CASE WHEN error IS NULL THEN 8 + valid ELSE 0 END AS files,
  CASE WHEN error IS NULL THEN 'FONT_GENERATED,JOB_COMPLETED,PACKAGE_CREATED,PREVIEW_GENERATED' WHEN error LIKE 'missing%' THEN 'FONT_GENERATED,JOB_FAILED' ELSE 'JOB_FAILED' END AS events FROM o""")
def flow_deliveries(spark, d):
    """The tail of all jobs: drawings, packages, files and what is logged. Every third job has no PDF preview."""
    done = _done(spark, d)
    jobs = read(spark, d, "embeddings").select(C("vec_id").alias("job_id"))
    names = jobs.select("job_id", *(F.lit(v).alias(k) for k, v in (("family_name", "Hand"), ("style_name", "Regular"), ("version", "1.0"), ("template_id", "template_v1"))))
    kinds = F.when(C("job_id") % 3 == 0, F.array(*map(F.lit, ("ttf", "otf", "png")))).otherwise(F.array(*map(F.lit, ("ttf", "otf", "png", "pdf"))))
    fonts = jobs.select("job_id", F.explode(kinds).alias("kind")).withColumn("content", F.col("kind").cast("binary"))
    made = delivery.delivered(done, template.characters(spark), names, fonts)
    tail = F.col("event").isin("FONT_GENERATED", "PREVIEW_GENERATED", "PACKAGE_CREATED", "JOB_COMPLETED", "JOB_FAILED")
    out = made.jobs.select("job_id", "state", "error")
    for rows, found in (
        (made.svgs.filter("svg is not null"), F.count("*").alias("drawings")),
        (made.files, F.count("*").alias("files")),
        (made.events.filter(tail), F.array_join(F.array_sort(F.collect_set("event")), ",").alias("events")),
    ):
        out = out.join(shuffled(rows.groupBy("job_id").agg(found)), "job_id", "left")
    return out.fillna(0, ["drawings", "files"])
