"""The tail of a job: from validated glyphs to drawings, archives, a package and its files.

Valid glyphs are scaled onto the canvas, traced and written as SVG; what a job delivers are files with names, which
sources.file_table writes one a row. Fonts and previews are made elsewhere and come in as a table. A job that lacks a drawing or
a needed file fails with its reason; other jobs go on.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions import text
from quern.operators import jobs, outlines, packaging
from quern.operators.components import shuffled, stored
from quern.operators.flow import Result, events_of

#: Why a job fails here.
NO_CONTOUR = "no contours of "


@dataclass
class Delivery:
    """svgs: job_id, character_id, svg. packages: job_id, zip. jobs: as Result.jobs, with what failed here. events: as Result.

    files: job_id, name, content of everything that a finished job has, its package included.
    """

    svgs: DataFrame
    packages: DataFrame
    jobs: DataFrame
    events: DataFrame
    files: DataFrame


def drawings(glyphs: DataFrame, runs: DataFrame, specs: DataFrame) -> DataFrame:
    """job_id, character_id, d, svg (null for a glyph without a contour) of glyphs (glyph, job_id, character_id, ...)."""
    kinds = F.broadcast(specs.select("character_id", text.is_tall(F.col("character"), F.col("category")).alias("tall"), text.is_descender(F.col("character")).alias("descender")))
    placed = outlines.normalised(runs, glyphs.join(kinds, "character_id").select("glyph", "tall", "descender"))
    paths = outlines.outlines(placed).select("glyph", "d")
    return glyphs.select("glyph", "job_id", "character_id").join(shuffled(paths), "glyph", "left").select("job_id", "character_id", "d", outlines.svg(F.col("d")).alias("svg"))


def delivered(done: Result, specs: DataFrame, names: DataFrame, fonts: DataFrame) -> Delivery:
    """What the completed jobs of done deliver. specs: the character set (template.characters).

    names: job_id, family_name, style_name, version, template_id, and creator, description, generated_at if known. fonts:
    job_id, kind (ttf, otf, png, pdf), content. A job without a row in names, or without one of the four files, fails.
    """
    going = done.jobs.filter("state = 'completed'").select("job_id")
    good = jobs.only_valid(done.glyphs, done.validations).join(shuffled(going), "job_id", "left_semi")
    drawn = stored(drawings(good, done.runs, specs))
    broken = drawn.filter("svg is null").groupBy("job_id").agg(F.min(F.concat(F.lit(NO_CONTOUR), "character_id")).alias("error"))
    traced = stored(going.join(shuffled(broken), "job_id", "left_anti"))
    svgs = drawn.join(shuffled(traced), "job_id", "left_semi").select("job_id", "character_id", "svg")
    named = stored(names.join(shuffled(traced), "job_id", "left_semi"))

    def has_names(rows: DataFrame) -> DataFrame:
        return rows.join(shuffled(named), "job_id", "left_semi")

    members, missing = packaging.package_members(has_names(done.validations), named, has_names(svgs), has_names(fonts))
    unnamed = traced.join(shuffled(named), "job_id", "left_anti").select("job_id", F.lit("no names").alias("error"))
    failures = stored(broken.unionByName(missing).unionByName(unnamed))
    members = stored(members)
    packages = stored(outlines.packages(members))
    late = F.col("_late").isNotNull()
    results = done.jobs.join(shuffled(failures.withColumnRenamed("error", "_late")), "job_id", "left")
    results = stored(results.withColumns({"state": F.when(late, "failed").otherwise(F.col("state")), "error": F.coalesce("_late", "error")}).select(*done.jobs.columns))
    finished = results.filter("state = 'completed'").select("job_id")
    counts = svgs.groupBy("job_id").agg(F.count("*").alias("glyph_count"))
    have = fonts.filter(F.col("kind").isin("ttf", "otf")).groupBy("job_id").agg(F.countDistinct("kind").alias("n")).filter("n = 2").select("job_id")
    seen = fonts.filter(F.col("kind").isin("png", "pdf")).groupBy("job_id").agg(F.countDistinct("kind").alias("n")).filter("n = 2").select("job_id")
    built = named.join(shuffled(have), "job_id", "left_semi").join(shuffled(counts), "job_id", "left")
    ready = packages.select("job_id", F.lit(packaging.PACKAGE).alias("zip_path"))
    previews = named.join(shuffled(seen), "job_id", "left_semi").select("job_id", F.lit("preview.png").alias("png"), F.lit("preview.pdf").alias("pdf"))
    events = done.events.filter("event <> 'JOB_COMPLETED'")
    for e in (
        events_of(built, "FONT_GENERATED", ["family_name", "glyph_count"]),
        events_of(previews, "PREVIEW_GENERATED", ["png", "pdf"]),
        events_of(ready, "PACKAGE_CREATED", ["zip_path"]),
        events_of(finished, "JOB_COMPLETED", ["job_id"]),
        events_of(failures.withColumnRenamed("error", "reason"), "JOB_FAILED", ["reason"]),
    ):
        events = events.unionByName(e)
    drawings_ = svgs.join(shuffled(finished), "job_id", "left_semi").select("job_id", F.concat("character_id", F.lit(".svg")).alias("name"), F.col("svg").cast("binary").alias("content"))
    files = members.join(shuffled(finished), "job_id", "left_semi").unionByName(drawings_).unionByName(packages.select("job_id", F.lit(packaging.PACKAGE).alias("name"), F.col("zip").alias("content")))
    return Delivery(svgs, packages, results, events, files)


def glyph_files(done: Result) -> DataFrame:
    """job_id, name, content: every kept glyph's crop as a PNG named after its character, ink 255."""
    pngs = outlines.glyph_pngs(done.runs, sizes=done.glyphs.select("glyph", "width", "height"))
    return done.glyphs.select("glyph", "job_id", "character_id").join(shuffled(pngs), "glyph").select("job_id", F.concat("character_id", F.lit(".png")).alias("name"), F.col("png").alias("content"))
