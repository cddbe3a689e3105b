"""Validation of glyph crops: what their ink measures, the graded checks, and a verdict for each.

A crop that couldn't be made or read stays as an invalid row with its reason, so that one glyph never fails a job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions import scoring
from quern.operators import raster
from quern.operators.components import shuffled


def checks(character: Column, ink: Column, strokes: Column, box: tuple[Column, ...], width: Column, height: Column) -> list[Column]:
    """The four checks of a crop of width by height with an ink box (x0, y0, x1, y1; nulls without ink)."""
    x0, y0, x1, y1 = box
    return [
        scoring.ink_ratio_check(ink / (width * height)),
        scoring.size_check(x1 - x0, y1 - y0),
        scoring.boundary_check(scoring.touches_edge(x0, y0, x1, y1, width, height)),
        scoring.stroke_check(strokes, *scoring.expected_strokes(character)),
    ]


def measured(crops: DataFrame, runs: DataFrame) -> DataFrame:
    """crops (glyph, width, height, ...) with ink, strokes and the ink's box x0, y0, x1, y1. runs: glyph, y, x0, x1."""
    named = runs.select(F.col("glyph").alias("image"), "y", "x0", "x1")
    found = raster.measures(named).join(shuffled(raster.component_counts(raster.labelled(named))), "image").withColumnRenamed("image", "glyph")
    return crops.join(shuffled(found), "glyph", "left").fillna(0, ["ink", "strokes"])


def validated(crops: DataFrame, runs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """glyph, keep, character, valid, confidence and warnings of crops (glyph, character, width, height, error).

    error: why there is no crop, or null. Crops without ink are invalid, with confidence 0 and an "Empty glyph" warning.
    """
    rows = measured(crops, runs)
    confidence, warnings, valid = scoring.combined(checks(F.col("character"), F.col("ink"), F.col("strokes"), tuple(F.col(c) for c in ("x0", "y0", "x1", "y1")), F.col("width"), F.col("height")))
    failed = F.col("error").isNotNull()
    said = F.array(F.concat(F.lit("Validation failed unexpectedly: "), F.col("error")))
    return rows.select("glyph", *keep, "character", (valid & ~failed).alias("valid"), F.when(failed, 0.0).otherwise(confidence).alias("confidence"), F.when(failed, said).otherwise(warnings).alias("warnings"))
