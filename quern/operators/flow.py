"""Jobs from photos to results: template pages, plain pages, rewrites and exclusions, for any number of jobs at once.

Each step is a table of all jobs' rows; a page, glyph or job that fails is a row with its reason. Results: glyphs (kept),
runs, pages (outcomes), validations, jobs (state and counts) and events.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.operators import alignment, extraction, jobs, raster, template, validation
from quern.operators.components import shuffled, stored, stored_counted


@dataclass
class Result:
    """glyphs: glyph, job_id, image, character, character_id, width, height, extraction_confidence, seq. runs: glyph, y, x0, x1.

    pages: job_id, source_image, succeeded, error, glyphs_extracted. validations: job_id, character_id, character, valid,
    confidence, warnings. jobs: as jobs.job_results. events: job_id, event, fields (JSON). totals: pages, failed_pages, valid and
    invalid of all jobs together, counted while these tables were written.
    """

    glyphs: DataFrame
    runs: DataFrame
    pages: DataFrame
    validations: DataFrame
    jobs: DataFrame
    events: DataFrame
    totals: dict = field(default_factory=dict)


def _counted_pages(pages: DataFrame) -> tuple[DataFrame, dict]:
    return stored_counted(pages, pages=F.count(F.lit(1)), failed_pages=F.count_if(~F.col("succeeded")))


def events_of(rows: DataFrame, event: str, fields: list[str]) -> DataFrame:
    """job_id, event, fields (JSON): one event a row."""
    return rows.select("job_id", F.lit(event).alias("event"), F.to_json(F.struct(*fields)).alias("fields"))


def _finished(glyphs: DataFrame, runs: DataFrame, pages: DataFrame, totals: dict, out: DataFrame | None, before: list[DataFrame]) -> Result:
    """Validation, exclusion, the jobs' states, and the events of all of it. glyphs: one per job and character."""
    glyphs = stored(glyphs)
    runs = stored(runs.join(shuffled(glyphs.select("glyph")), "glyph", "left_semi"))
    verdicts = validation.validated(glyphs.withColumn("error", F.lit(None).cast("string")), runs, ("job_id", "character_id")).drop("glyph")
    if out is not None:
        verdicts = jobs.excluded(verdicts, out)
    verdicts, judged = stored_counted(verdicts, valid=F.count_if("valid"), invalid=F.count_if(~F.col("valid")))
    results = stored(jobs.job_results(pages, verdicts))
    done = results.filter("state = 'completed'")
    counts = results.withColumn("total", F.col("valid") + F.col("invalid"))
    events = [*before, events_of(counts, "VALIDATION_COMPLETED", ["total", "valid", "invalid"]), events_of(done, "JOB_COMPLETED", ["job_id"])]
    events.append(events_of(results.filter("state = 'failed'").withColumnRenamed("error", "reason"), "JOB_FAILED", ["reason"]))
    every = events[0]
    for e in events[1:]:
        every = every.unionByName(e)
    return Result(glyphs, runs, pages, verdicts, results, every, {**totals, **judged})


def preprocessing_events(images: DataFrame, pages: DataFrame) -> DataFrame:
    """PAGE_PREPROCESSED of every page without a failure, to add to a Result's events. images: job_id, image; pages: preprocess.Pages.pages."""
    good = images.join(pages.filter("failure is null"), "image")
    return events_of(good.withColumnsRenamed({"image": "source_image", "angle": "skew_angle_deg", "detected": "page_detected"}), "PAGE_PREPROCESSED", ["source_image", "skew_angle_deg", "page_detected"])


def _page_events(pages: DataFrame) -> list[DataFrame]:
    good = pages.filter("succeeded")
    return [events_of(good, "GLYPHS_EXTRACTED", ["source_image", "glyphs_extracted"]), events_of(pages.filter("not succeeded"), "PAGE_FAILED", ["source_image", "error"])]


def template_jobs(images: DataFrame, runs: DataFrame, detected: DataFrame, expected: DataFrame, elements: DataFrame, dpi: float, out: DataFrame | None = None) -> Result:
    """Jobs on template photos. images: job_id, image, width, height. runs: image, y, x0, x1.

    detected: image, marker_id, corner, seq, x, y; expected: marker_id, corner, u, v (template pixels). elements: as
    template.elements. out: job_id, character_id to leave out. A page fails that alignment.aligned turns down or that
    has an empty window; of a character found on several pages the surest crop stays, the others are logged.
    """
    voted = stored(alignment.pages_of(detected))
    fits = stored(alignment.homographies(alignment.point_pairs(detected, expected, voted)))
    placed = stored(alignment.aligned(images, voted, elements, fits, len(template.CORNERS)))
    good = placed.filter("failure is null").join(images.select("job_id", "image", "width", "height"), "image")
    found, cut, failures = extraction.template_glyphs(good.select("image", "page", "h"), elements, runs, (template.PAGE_WIDTH, template.PAGE_HEIGHT), dpi)
    order = F.xxhash64("image", "character_id")
    found = stored(found.join(good.select("image", "job_id", F.col("confidence").alias("extraction_confidence")), "image").withColumn("seq", order))
    reasons = placed.select("image", F.col("failure").alias("_f")).join(failures, "image", "left")
    pages = images.select("job_id", "image").join(reasons, "image").select("job_id", F.col("image").alias("source_image"), F.coalesce("_f", "error").alias("error"))
    pages, totals = _counted_pages(jobs.outcomes(pages, found.withColumnRenamed("image", "source_image")))
    created = events_of(images.select("job_id").distinct(), "JOB_CREATED", ["job_id"])
    aligned = good.select("job_id", "image", "page", "confidence")
    best = jobs.best_glyphs(found, "seq")
    lost = found.select("job_id", "image", "character_id", "seq").join(best.select("job_id", "character_id", "seq"), ["job_id", "character_id", "seq"], "left_anti")
    events = [created, events_of(aligned, "PAGE_ALIGNED", ["image", "page", "confidence"]), *_page_events(pages), events_of(lost, "DUPLICATE_GLYPH_DISCARDED", ["image", "character_id"])]
    return _finished(best, cut, pages, totals, out, events)


def plain_jobs(images: DataFrame, runs: DataFrame, expected: DataFrame, specs: DataFrame, out: DataFrame | None = None) -> Result:
    """Jobs on plain pages, one photo a job. images: job_id, image, width, height; expected: image, position, character_id.

    A page whose marks don't match the expected characters fails its job.
    """
    sizes = images.select("image", "width", "height")
    marks = stored(raster.padded(raster.freeform_marks(runs, sizes).join(shuffled(sizes), "image")))
    found, failures = extraction.matched_marks(marks, expected, specs)
    found = found.join(shuffled(images.select("job_id", "image")), "image").withColumns({"glyph": F.concat_ws("/", F.col("image").cast("string"), "character_id"), "extraction_confidence": F.lit(1.0), "seq": F.col("position").cast("long")})
    found = stored(found)
    pages = images.select("job_id", "image").join(shuffled(failures), "image", "left").select("job_id", F.col("image").alias("source_image"), "error")
    pages, totals = _counted_pages(jobs.outcomes(pages, found.withColumnRenamed("image", "source_image")))
    created = events_of(images.select("job_id").distinct(), "JOB_CREATED", ["job_id"])
    started = events_of(images, "FREEFORM_JOB_STARTED", ["image"])
    return _finished(jobs.best_glyphs(found, "seq"), raster.cut(runs, found), pages, totals, out, [created, started, *_page_events(pages)])


def from_files(photos: DataFrame, specs: DataFrame, pages: DataFrame, overrides: DataFrame | None = None) -> Result:
    """The jobs whose glyphs lie as PNGs in their folders, for rewritten() and without(): what they have, judged anew.

    photos: job_id, name, height, width, channels, data of stored crops (sources.images.stored_crops); files whose names aren't of
    the character set are skipped. Every glyph's source is "existing", or what overrides (job_id, character_id,
    source) says, and its confidence is 1. pages: as Result.pages.
    """
    named = photos.join(extraction.stored_glyphs(photos.select("name").distinct(), specs), "name").withColumn("glyph", F.concat_ws("/", F.col("job_id").cast("string"), "character_id"))
    if overrides is None:
        named = named.withColumn("source", F.lit(extraction.EXISTING))
    else:
        named = named.join(overrides.select("job_id", "character_id", "source"), ["job_id", "character_id"], "left").withColumn("source", F.coalesce("source", F.lit(extraction.EXISTING)))
    runs = stored(raster.bright_runs(named.withColumn("image", F.col("glyph")), 127)).withColumnRenamed("image", "glyph")
    glyphs = named.select("glyph", "job_id", F.col("source").alias("image"), "character", "character_id", "width", "height", F.lit(1.0).alias("extraction_confidence"), F.col("ord").cast("long").alias("seq"))
    pages, totals = _counted_pages(pages)
    return _finished(glyphs, runs, pages, totals, None, [events_of(glyphs.select("job_id").distinct(), "JOB_CREATED", ["job_id"])])


def rewritten(old: Result, new: Result) -> Result:
    """Jobs of old whose characters that new holds (from plain pages with the same job_id) take the place of theirs; all is judged again."""
    names = ["glyph", "job_id", "image", "character", "character_id", "width", "height", "extraction_confidence", "seq"]
    before = old.glyphs.select(*names).withColumns({"_run": F.lit(0), "glyph": F.concat(F.lit("0/"), "glyph")})
    after = new.glyphs.select(*names).withColumns({"_run": F.lit(1), "glyph": F.concat(F.lit("1/"), "glyph")})
    glyphs = jobs.rewritten(before, after, "_run").select(*names)
    runs = old.runs.withColumn("glyph", F.concat(F.lit("0/"), "glyph")).unionByName(new.runs.withColumn("glyph", F.concat(F.lit("1/"), "glyph")))
    tried = stored(new.pages.groupBy("job_id").agg(F.min(F.when(~F.col("succeeded"), F.coalesce("error", F.lit("no glyphs")))).alias("reason")))
    got = new.glyphs.groupBy("job_id").agg(F.count("*").alias("characters"))
    events = [
        events_of(tried, "REWRITE_STARTED", ["job_id"]),
        events_of(got, "REWRITE_EXTRACTED", ["characters"]),
        events_of(tried.filter("reason is not null"), "REWRITE_FAILED", ["reason"]),
    ]
    # A rewrite that fails leaves its job's pages as they were.
    pages, totals = _counted_pages(old.pages.unionByName(new.pages.filter("succeeded")))
    return _finished(glyphs, runs, pages, totals, None, events)


def without(done: Result, out: DataFrame) -> Result:
    """The jobs judged again with the characters of out (job_id, character_id) left out."""
    started = out.select("job_id").distinct()
    return _finished(done.glyphs, done.runs, done.pages, {k: done.totals[k] for k in ("pages", "failed_pages") if k in done.totals}, out, [events_of(started, "EXCLUDE_STARTED", ["job_id"])])
