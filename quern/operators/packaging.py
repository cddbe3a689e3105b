"""What a job's package holds: metadata, notes, glyph drawings in an archive of their own, and the archive around them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions import text
from quern.operators import outlines
from quern.operators.components import shuffled

#: The name of a job's package, and what its notes say of the other files.
PACKAGE = "package.zip"
CONTENTS = (("preview.png", "a sample of the font"), ("preview.pdf", "a sample of the font for printing"), ("glyphs.zip", "every glyph as a drawing (SVG)"), ("metadata.json", "names, version and character coverage"))
#: Names that a font may have besides those it needs.
OPTIONAL = ("creator", "description", "generated_at")


def metadata(validations: DataFrame, names: DataFrame) -> DataFrame:
    """job_id, glyph_count, valid_characters, invalid_characters (sorted) and document (JSON), one row a job.

    names: job_id, family_name, style_name, version, template_id, and any of creator, description and generated_at (text). A
    job's ids are distinct, at most the character set.
    """
    ids = validations.select("job_id", "character_id", "valid").distinct()
    lists = ids.groupBy("job_id").agg(F.count_if("valid").alias("glyph_count"), *(F.array_sort(F.collect_set(F.when(F.col("valid") == v, F.col("character_id")))).alias(n) for v, n in ((True, "valid_characters"), (False, "invalid_characters"))))
    rows = names.join(shuffled(lists), "job_id")
    creator, description, made = ([c] if c in names.columns else [] for c in OPTIONAL)
    fields = ("family_name", "style_name", "version", *creator, *description, "template_id", *made, "glyph_count", "valid_characters", "invalid_characters")
    return rows.select("job_id", "family_name", "style_name", "glyph_count", "valid_characters", "invalid_characters", F.to_json(F.struct(*fields)).alias("document"))


def notes(validations: DataFrame, names: DataFrame) -> DataFrame:
    """job_id, coverage, note and document: the text file of a package."""
    bad = F.count_if(~F.col("valid"))
    rows = validations.groupBy("job_id").agg(text.coverage(F.count_if("valid"), F.count("*")).alias("coverage"), text.coverage_note(bad).alias("note"))
    rows = names.join(shuffled(rows), "job_id")
    font = text.postscript_name(F.col("family_name"), F.col("style_name"))
    files = [F.concat(font, F.lit(".ttf: TrueType font (install this one or the other)")), F.concat(font, F.lit(".otf: OpenType font"))]
    files += [F.lit(f"{name}: {what}") for name, what in CONTENTS]
    lines = [F.col("family_name"), F.repeat(F.lit("="), F.length("family_name")), F.lit(""), F.lit("Contents"), F.lit("-" * 8), *files, F.lit(""), F.lit("Character coverage"), F.lit("-" * 19), F.concat("coverage", F.lit(" were included in this font.")), F.col("note"), F.lit("")]
    return rows.select("job_id", "coverage", "note", F.concat_ws("\n", *lines).alias("document"))


def glyph_archives(svgs: DataFrame) -> DataFrame:
    """job_id, zip: drawings (job_id, character_id, svg) of each job's present glyphs, sorted by name."""
    files = svgs.select("job_id", F.concat("character_id", F.lit(".svg")).alias("name"), F.col("svg").cast("binary").alias("content"))
    return outlines.packages(files)


def package_members(validations: DataFrame, names: DataFrame, svgs: DataFrame, fonts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members, failures): job_id, name, content of every file of a package; jobs that lack a needed file fail.

    fonts: job_id, kind (ttf, otf, png, pdf), content: made elsewhere, all four needed.
    """
    needed = ("ttf", "otf", "png", "pdf")
    kinds = fonts.filter(F.col("kind").isin(*needed)).groupBy("job_id").agg(F.collect_set("kind").alias("kinds"))
    have = names.select("job_id").join(shuffled(kinds), "job_id", "left")
    missing = F.array_sort(F.array_except(F.lit(list(needed)), F.coalesce("kinds", F.array().cast("array<string>"))))
    failures = have.withColumn("missing", missing).filter("size(missing) > 0").select("job_id", F.concat(F.lit("missing: "), F.array_join("missing", ", ")).alias("error"))
    font = names.select("job_id", text.postscript_name(F.col("family_name"), F.col("style_name")).alias("_f"))
    name = F.when(F.col("kind").isin("ttf", "otf"), F.concat("_f", F.lit("."), "kind")).otherwise(F.concat(F.lit("preview."), F.col("kind")))
    members = fonts.join(shuffled(font), "job_id").select("job_id", name.alias("name"), "content")
    members = members.unionByName(glyph_archives(svgs).select("job_id", F.lit("glyphs.zip").alias("name"), F.col("zip").alias("content")))
    for made, file in ((metadata(validations, names), "metadata.json"), (notes(validations, names), "README.txt")):
        members = members.unionByName(made.select("job_id", F.lit(file).alias("name"), F.col("document").cast("binary").alias("content")))
    return members.join(shuffled(failures.select("job_id")), "job_id", "left_anti"), failures
