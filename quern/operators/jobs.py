"""Jobs as append-only tables: outcomes of pages, events, states, rewrites and exclusions.

Nothing is updated in place: the present state is the newest row of each key, so retried tasks and late rows do no harm.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from quern.operators.components import shuffled
from quern.operators.ranking import keep_best, upserted

#: Fixed states, and the states that each may follow.
FOLLOWS = {"created": [], "uploading": ["created", "uploading"], "processing": ["uploading", "completed", "failed"], "completed": ["processing"], "failed": ["processing"]}
EXCLUDED = "Manually excluded"


def transitions(changes: DataFrame, key: str, state: str, order: list[str]) -> DataFrame:
    """changes with before (the state of the row before) and allowed. An unknown state is never allowed; the first must be created."""
    before = F.lag(state).over(Window.partitionBy(key).orderBy(*order))
    rows = changes.withColumn("before", before)
    allowed = F.when(F.col("before").isNull(), F.col(state) == "created")
    for s, earlier in FOLLOWS.items():
        allowed = allowed.when(F.col(state) == s, F.col("before").isin(*earlier) if earlier else F.lit(False))
    return rows.withColumn("allowed", F.coalesce(allowed.otherwise(False), F.lit(False)))


def latest(changes: DataFrame, key: str, columns: list[str], order: str) -> DataFrame:
    """key and the newest non-null value of each column: partial changes merge without reading and rewriting a record."""
    newest = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in columns]
    return changes.groupBy(key).agg(*newest, F.min(order).alias("created_at"), F.max(order).alias("updated_at"))


def outcomes(pages: DataFrame, glyphs: DataFrame | None = None) -> DataFrame:
    """job_id, source_image, succeeded, error, glyphs_extracted. pages: job_id, source_image, error; a failed page counts no glyphs.

    Without glyphs, pages has a row for every glyph, all of a page with one error: one aggregation finds pages and counts.
    """
    if glyphs is None:
        rows = pages.groupBy("job_id", "source_image", "error").agg(F.count("*").alias("n"))
    else:
        counts = glyphs.groupBy("job_id", "source_image").agg(F.count("*").alias("n"))
        rows = pages.join(shuffled(counts), ["job_id", "source_image"], "left")
    good = F.col("error").isNull()
    return rows.select("job_id", "source_image", good.alias("succeeded"), "error", F.when(good, F.coalesce("n", F.lit(0))).otherwise(0).cast("long").alias("glyphs_extracted"))


def job_results(pages: DataFrame, validations: DataFrame) -> DataFrame:
    """job_id, state, pages, failed_pages, valid, invalid, error: a job fails without pages' glyphs or without a valid one."""
    p = pages.groupBy("job_id").agg(F.count("*").alias("pages"), F.count_if(~F.col("succeeded")).alias("failed_pages"))
    v = validations.groupBy("job_id").agg(F.count_if("valid").alias("valid"), F.count_if(~F.col("valid")).alias("invalid"))
    rows = p.join(shuffled(v), "job_id", "left").fillna(0, ["valid", "invalid"])
    error = F.when(F.col("valid") + F.col("invalid") == 0, "no pages processed").when(F.col("valid") == 0, "no valid glyphs")
    return rows.select("job_id", F.when(error.isNull(), "completed").otherwise("failed").alias("state"), "pages", "failed_pages", "valid", "invalid", error.alias("error"))


def best_glyphs(glyphs: DataFrame, seq: str) -> DataFrame:
    """The surest glyph of each job and character, the first among equals."""
    return keep_best(glyphs, ["job_id", "character_id"], "extraction_confidence", seq)


def rewritten(old: DataFrame, new: DataFrame, version: str) -> DataFrame:
    """Old glyphs with the rewritten ones in place of theirs."""
    return upserted(old, new, ["job_id", "character_id"], version)


def to_rewrite(specs: DataFrame, validations: DataFrame) -> DataFrame:
    """job_id, ord, character_id: the job's invalid characters in canonical order."""
    bad = validations.filter("not valid").select("job_id", "character_id").distinct()
    return bad.join(specs.select("ord", "character_id"), "character_id").select("job_id", "ord", "character_id")


def excluded(validations: DataFrame, out: DataFrame) -> DataFrame:
    """validations with the rows of out (job_id, character_id) made invalid."""
    marked = validations.join(out.select("job_id", "character_id").distinct().withColumn("_out", F.lit(True)), ["job_id", "character_id"], "left")
    gone = F.coalesce("_out", F.lit(False))
    return marked.withColumns({"valid": F.col("valid") & ~gone, "warnings": F.when(gone, F.array(F.lit(EXCLUDED))).otherwise(F.col("warnings"))}).drop("_out").select(*validations.columns)


def only_valid(glyphs: DataFrame, validations: DataFrame) -> DataFrame:
    """The glyphs (job_id, character_id, ...) that are valid in their job."""
    return glyphs.join(shuffled(validations.filter("valid").select("job_id", "character_id")), ["job_id", "character_id"], "left_semi").select(*glyphs.columns)


def toggled(rows: DataFrame, marks: DataFrame, key: list[str]) -> DataFrame:
    """The keys of rows without those that marks also holds, and with those that only marks holds: a set toggle for any number of sets."""
    both = rows.select(*key, F.lit(1).alias("_a"), F.lit(0).alias("_b")).unionByName(marks.select(*key, F.lit(0).alias("_a"), F.lit(1).alias("_b")))
    return both.groupBy(*key).agg(F.max("_a").alias("_a"), F.max("_b").alias("_b")).filter("_a <> _b").select(*key)


def unknown_ids(out: DataFrame, specs: DataFrame) -> DataFrame:
    """Rows of out whose character isn't in the set: a request with any of them must be turned down whole."""
    return out.join(specs.select("character_id"), "character_id", "left_anti")


def event_log(rows: DataFrame, event: str, ts: str, fields: list[str]) -> DataFrame:
    """event, timestamp, fields (JSON): rows as log events."""
    return rows.select(F.lit(event).alias("event"), F.col(ts).alias("timestamp"), F.to_json(F.struct(*fields)).alias("fields"))
