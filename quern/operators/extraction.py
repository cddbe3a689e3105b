"""Glyphs from pages: windows of template boxes, characters of plain pages, and stored glyph files; with what is missing.

Failures are rows with a reason: an element's window that is empty fails its page, a plain page with another number of
characters than expected fails whole, and an id outside the character set is never dropped in silence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from quern.functions import geometry
from quern.operators import raster, rectify
from quern.operators.alignment import projected
from quern.operators.components import shuffled

#: Fixed: pixels around a box of the template; marks on plain pages have their own padding.
PADDING = 6
#: The source of a glyph that lies stored and comes from no photo at hand.
EXISTING = "existing"


def inverse(h: Column) -> Column:
    """The inverse (up to scale) of a homography of nine numbers in row order."""
    a, b, c, d, e, f, g, i, j = (h[k] for k in range(9))
    return F.array(e * j - f * i, c * i - b * j, b * f - c * e, f * g - d * j, a * j - c * g, c * d - a * f, d * i - e * g, b * g - a * i, a * e - b * d)


def windows(pages: DataFrame, elements: DataFrame, page_height: float, dpi: float, padding: int = PADDING) -> DataFrame:
    """image, page, character, character_id, x, y, width, height, error: each page's boxes on its photo, padded and clamped.

    pages: image, page, width, height (of the photo) and h (photo to template pixels; null: the photo is aligned already).
    elements: page, character, id, x, y, width, height in points. A window is the box around the four projected corners;
    one without area or beyond the horizon has an error and no size.
    """
    e = elements.select("page", "character", F.col("id").alias("character_id"), geometry.pixels(F.col("x"), dpi).alias("_x"), geometry.flipped_y(F.col("y"), F.col("height"), F.lit(page_height), dpi).alias("_y"), geometry.pixels(F.col("width"), dpi).alias("_w"), geometry.pixels(F.col("height"), dpi).alias("_h"))
    rows = pages.join(e, "page").withColumn("_back", F.when(F.col("h").isNotNull(), inverse(F.col("h"))))

    def seen(p: Column) -> Column:
        u, v = projected(F.col("_back"), p["x"], p["y"])
        return F.when(F.col("_back").isNull(), p).otherwise(F.struct(u.alias("x"), v.alias("y")))

    rows = rows.withColumn("_c", F.transform(geometry.box_corners(F.col("_x"), F.col("_y"), F.col("_w"), F.col("_h")), seen))
    low_x, high_x = (f(F.transform("_c", lambda p: p["x"])) for f in (F.array_min, F.array_max))
    low_y, high_y = (f(F.transform("_c", lambda p: p["y"])) for f in (F.array_min, F.array_max))
    x0, x1 = geometry.clamped(low_x, high_x - low_x, padding, F.col("width"))
    y0, y1 = geometry.clamped(low_y, high_y - low_y, padding, F.col("height"))
    broken = F.exists("_c", lambda p: p["x"].isNull() | p["y"].isNull())
    rows = rows.withColumns({"_x0": x0, "_y0": y0, "_x1": x1, "_y1": y1, "_bad": broken})
    empty = F.col("_bad") | (F.col("_x1") <= F.col("_x0")) | (F.col("_y1") <= F.col("_y0"))
    error = F.when(empty, F.concat(F.lit("window of "), F.col("character_id"), F.lit(" is outside the page")))
    size = [F.when(~empty, c).otherwise(0).cast("int").alias(n) for c, n in ((F.col("_x0"), "x"), (F.col("_y0"), "y"), (F.col("_x1") - F.col("_x0"), "width"), (F.col("_y1") - F.col("_y0"), "height"))]
    return rows.select("image", "page", "character", "character_id", *size, error.alias("error"))


def page_failures(found: DataFrame) -> DataFrame:
    """image, error of pages with an empty window: the first by character_id. One bad element fails its page."""
    return found.filter("error is not null").groupBy("image").agg(F.min_by("error", "character_id").alias("error"))


def template_glyphs(pages: DataFrame, elements: DataFrame, runs: DataFrame, page_size: tuple[float, float], dpi: float, padding: int = PADDING) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(glyphs, their runs, failures of pages): every box of every good page cut out upright, specks removed.

    pages: image, page and h (photo to template pixels; null: the photo is upright). page_size: width and height in points; boxes
    are padded and clamped in template pixels, where the page is upright, and their ink is fetched from the photo.
    glyphs: glyph (image/character_id), image, page, character, character_id, x, y, width, height.
    """
    width, height = (geometry.page_pixels(F.lit(v), dpi) for v in page_size)
    flat = pages.select("image", "page", width.alias("width"), height.alias("height"), F.lit(None).cast("array<double>").alias("h"))
    found = windows(flat, elements, page_size[1], dpi, padding)
    failures = page_failures(found)
    glyphs = found.join(failures.select("image"), "image", "left_anti").drop("error").withColumn("glyph", F.concat_ws("/", F.col("image").cast("string"), "character_id"))
    back = pages.select("image", F.when(F.col("h").isNotNull(), inverse(F.col("h"))).alias("back"))
    ink = rectify.upright(runs, glyphs.join(back, "image")).withColumnRenamed("glyph", "image")
    return glyphs, raster.without_specks(raster.labelled(ink)).select(F.col("image").alias("glyph"), "y", "x0", "x1"), failures


def with_specs(rows: DataFrame, specs: DataFrame) -> DataFrame:
    """rows (character_id, ...) with character, category and unicode of specs; an id that specs lack stops the job."""
    known = rows.join(specs.select("character_id", "character", "category", "unicode"), "character_id", "left")
    unknown = F.raise_error(F.concat(F.lit("not in the character set: "), F.coalesce("character_id", F.lit("null"))))
    return known.withColumn("character", F.coalesce("character", unknown.cast("string")))


def matched_marks(marks: DataFrame, expected: DataFrame, specs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(glyphs, failures) of plain pages: the i-th mark in reading order is the i-th expected character.

    marks: image, position and more; expected: image, position, character_id (positions from 1). A page fails without
    marks, with another number of marks than expected, or with an id outside specs; then it has no glyphs at all.
    """
    found = marks.groupBy("image").agg(F.count("*").alias("found"))
    wanted = expected.join(F.broadcast(specs.select("character_id", F.lit(True).alias("_known"))), "character_id", "left")
    wanted = wanted.groupBy("image").agg(F.count("*").alias("expected"), F.min(F.when(F.col("_known").isNull(), F.coalesce("character_id", F.lit("null")))).alias("unknown"))
    pages = wanted.join(shuffled(found), "image", "left").fillna(0, ["found"])
    error = F.when(F.col("found") == 0, "no handwriting found").when(F.col("found") != F.col("expected"), F.format_string("found %d characters, expected %d", "found", "expected"))
    error = error.when(F.col("unknown").isNotNull(), F.concat(F.lit("not in the character set: "), F.col("unknown")))
    judged = pages.withColumn("error", error)
    good = judged.filter("error is null").select("image")
    glyphs = marks.join(shuffled(good), "image", "left_semi").join(shuffled(expected.select("image", "position", "character_id")), ["image", "position"])
    return glyphs.join(F.broadcast(specs.select("character_id", "character")), "character_id"), judged.filter("error is not null").select("image", "error")


def stored_glyphs(files: DataFrame, specs: DataFrame) -> DataFrame:
    """name, ord, character, character_id of stored glyph files (name): a stem that isn't an id is skipped. Sort by name to read in order."""
    stem = files.withColumn("character_id", F.regexp_extract("name", r"^(.*?)(?:\.[^.]*)?$", 1))
    return stem.join(specs.select("ord", "character", "character_id"), "character_id").select("name", "ord", "character", "character_id")


def ordered_corners(points: DataFrame, key: list[str], x: Column, y: Column, point: Column) -> DataFrame:
    """key, tl, tr, br, bl: each key's points of smallest x + y, smallest y - x, largest x + y and largest y - x.

    Ties go to the smallest point value.
    """
    plus, minus = F.round(x + y, 2), F.round(y - x, 2)
    order = (("tl", F.min_by, plus, point), ("tr", F.min_by, minus, point), ("br", F.max_by, plus, -point), ("bl", F.max_by, minus, -point))
    return points.groupBy(*key).agg(*(f(point, F.struct(by, tie)).alias(n) for n, f, by, tie in order))


def first_match(rows: DataFrame, key: list[str], holds: Column, order: list[str]) -> DataFrame:
    """The first row of each key, by order, for which holds is true; a key without one has no row."""
    place = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return rows.filter(holds).withColumn("_p", place).filter("_p = 1").drop("_p")
