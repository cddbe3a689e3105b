"""The character set, its pages of boxes and markers, and the nested template document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import geometry, text

#: The canonical order of signs and their names, the corners, and the layout in points.
SIGNS = [(".", "period"), (",", "comma"), ("!", "exclamation"), ("?", "question"), ("'", "apostrophe"), (":", "colon"), (";", "semicolon"), ('"', "quote"), ("-", "hyphen"), ("(", "paren_open"), (")", "paren_close"), ("[", "bracket_open"), ("]", "bracket_close"), ("_", "underscore")]
CORNERS = ("top_left", "top_right", "bottom_left", "bottom_right")
PAGE_WIDTH, PAGE_HEIGHT = 595.2755905511812, 841.8897637795277
MARGIN, MARKER, HEADER, CELL_WIDTH, CELL_HEIGHT, GAP = 42.0, 28.0, 54.0, 52.0, 62.0, 10.0
INSET = MARGIN + MARKER + GAP
COLUMNS = int((PAGE_WIDTH - 2 * INSET + GAP) // (CELL_WIDTH + GAP))
ROWS = int((PAGE_HEIGHT - MARGIN - MARKER - HEADER - INSET + GAP) // (CELL_HEIGHT + GAP))


def characters(spark: SparkSession) -> DataFrame:
    """ord, character, character_id, category, unicode: 26 + 26 + 10 letters and digits by rule, then the signs."""
    plain = [("uppercase", "A", 26, 0), ("lowercase", "a", 26, 26), ("digit", "0", 10, 52)]
    rows = [(at + i, chr(ord(c) + i), f"{kind}_{chr(ord(c) + i)}", kind) for kind, c, n, at in plain for i in range(n)]
    rows += [(62 + i, c, f"punctuation_{name}", "punctuation") for i, (c, name) in enumerate(SIGNS)]
    df = spark.createDataFrame(rows, "ord int, character string, character_id string, category string")
    return df.withColumn("unicode", text.codepoint(F.col("character")))


def elements(specs: DataFrame) -> DataFrame:
    """page, ord, character, id, category, unicode, x, y, width, height, filled left to right and down."""
    page, row, col = geometry.grid_cell(F.col("ord"), COLUMNS, ROWS)
    x = F.round(INSET + col * (CELL_WIDTH + GAP), 2)
    y = F.round(PAGE_HEIGHT - MARGIN - MARKER - HEADER - row * (CELL_HEIGHT + GAP) - CELL_HEIGHT, 2)
    return specs.select(page.alias("page"), "ord", "character", F.col("character_id").alias("id"), "category", "unicode", x.alias("x"), y.alias("y"), F.lit(CELL_WIDTH).alias("width"), F.lit(CELL_HEIGHT).alias("height"))


def markers(pages: DataFrame) -> DataFrame:
    """page, marker_id, corner, x, y, size: four a page, numbered from the first page's."""
    far_x, far_y = PAGE_WIDTH - MARGIN - MARKER, PAGE_HEIGHT - MARGIN - MARKER
    at = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(c).alias("corner"), F.lit(far_x if "right" in c else MARGIN).alias("x"), F.lit(far_y if "top" in c else MARGIN).alias("y")) for i, c in enumerate(CORNERS)))
    rows = pages.select("page").distinct().select("page", F.inline(at))
    return rows.select("page", ((F.col("page") - 1) * len(CORNERS) + F.col("i")).alias("marker_id"), "corner", "x", "y", F.lit(MARKER).alias("size"))


def document(boxes: DataFrame, marks: DataFrame, template_id: str, version: str) -> DataFrame:
    """One nested row: pages with their elements in order and their markers."""
    names = ["character", "id", "category", "unicode", "x", "y", "width", "height"]
    inner = boxes.groupBy("page").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", *names))), lambda e: F.struct(*(e[n].alias(n) for n in names))).alias("elements"))
    outer = marks.groupBy("page").agg(F.array_sort(F.collect_list(F.struct("marker_id", "corner", "x", "y", "size"))).alias("markers"))
    pages = inner.join(outer, "page").agg(F.array_sort(F.collect_list(F.struct("page", "elements", "markers"))).alias("pages"))
    size = F.struct(F.lit(PAGE_WIDTH).alias("width"), F.lit(PAGE_HEIGHT).alias("height"), F.lit("pt").alias("unit"))
    count = F.aggregate("pages", F.lit(0), lambda n, p: n + F.size(p["elements"]))
    return pages.select(F.lit(version).alias("template_version"), F.lit(template_id).alias("template_id"), size.alias("page_size"), count.alias("character_count"), "pages")
