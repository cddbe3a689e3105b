"""Graded checks as column expressions: scores in [0, 1], warnings, and their combination."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the validation rules.
MIN_CONFIDENCE, WARN_BELOW, STROKE_PENALTY, BOUNDARY_SCORE = 0.5, 0.85, 0.35, 0.5
INK_RATIO, MIN_SIDE = (0.005, 0.02, 0.35, 0.6), (6.0, 14.0)
FEW_PIXELS, NOISE = "Insufficient foreground pixels", "Excessive noise"
EMPTY, SMALL = "Empty glyph", "Glyph is extremely small"
BOUNDARY = "Glyph touches the crop boundary and may be cut off"
STROKES = "Unexpected number of disconnected strokes"
#: Fixed: pixels from a crop's edge that count as touching it; characters that may be one stroke or two (all others: one).
BOUNDARY_MARGIN, TWO_STROKES = 2, ("i", "j", ":", ";", '"')


def ramp(v: Column, fail: float, ideal: float) -> Column:
    """0 up to fail, 1 from ideal on, linear between; null stays null."""
    return F.when(v <= fail, 0.0).when(v >= ideal, 1.0).when(v.isNotNull(), (v - fail) / (ideal - fail))


def trapezoid(v: Column, fail_low: float, low: float, high: float, fail_high: float) -> Column:
    """0 beyond either fail bound, 1 from low to high, linear between."""
    out = F.when((v <= fail_low) | (v >= fail_high), 0.0).when(v < low, (v - fail_low) / (low - fail_low))
    return out.when(v > high, (fail_high - v) / (fail_high - high)).when(v.isNotNull(), 1.0)


def check(score: Column, warning: Column) -> Column:
    return F.struct(score.cast("double").alias("score"), warning.cast("string").alias("warning"))


def ink_ratio_check(ratio: Column) -> Column:
    s = trapezoid(ratio, *INK_RATIO)
    return check(s, F.when(s < 1, F.when(ratio < INK_RATIO[1], FEW_PIXELS).otherwise(NOISE)))


def size_check(width: Column, height: Column) -> Column:
    s = F.coalesce(ramp(F.least(width, height), *MIN_SIDE), F.lit(0.0))
    return check(s, F.when(width.isNull() | height.isNull(), EMPTY).when(s < 1, SMALL))


def boundary_check(touches: Column) -> Column:
    return check(F.when(touches, BOUNDARY_SCORE).otherwise(1.0), F.when(touches, BOUNDARY))


def touches_edge(x0: Column, y0: Column, x1: Column, y1: Column, width: Column, height: Column, margin: int = BOUNDARY_MARGIN) -> Column:
    """Whether an ink box (half-open) reaches within margin of its crop's edges; a crop without ink touches none."""
    return F.coalesce((x0 <= margin) | (y0 <= margin) | (x1 >= width - margin) | (y1 >= height - margin), F.lit(False))


def expected_strokes(character: Column) -> tuple[Column, Column]:
    """(fewest, most) strokes of a well-written character."""
    return F.lit(1), F.when(character.isin(*TWO_STROKES), 2).otherwise(1)


def inlier_mean(error: Column, inlier: Column, least: int, share: float) -> Column:
    """An aggregate: the mean error of inliers, or of all where they are fewer than least or than share of all."""
    enough = F.count_if(inlier) >= F.greatest(F.lit(float(least)), F.bround(F.count("*") * share))
    return F.when(enough, F.avg(F.when(inlier, error))).otherwise(F.avg(error))


def stroke_check(count: Column, low: Column, high: Column) -> Column:
    away = F.when(count < low, low - count).when(count > high, count - high).otherwise(0)
    return check(F.greatest(F.lit(0.0), 1 - STROKE_PENALTY * away), F.when(away > 0, F.when(count == 0, EMPTY).otherwise(STROKES)))


def combined(checks: list[Column]) -> tuple[Column, Column, Column]:
    """(confidence, warnings, valid): the product of the scores at 4 places; the warnings of scores under WARN_BELOW."""
    product = checks[0]["score"]
    for c in checks[1:]:
        product = product * c["score"]
    confidence = F.round(product, 4)
    warned = F.transform(F.filter(F.array(*checks), lambda c: (c["score"] < WARN_BELOW) & c["warning"].isNotNull()), lambda c: c["warning"])
    valid = (confidence >= MIN_CONFIDENCE) & (F.size(warned) == 0)
    weak = F.array(F.concat(F.lit("Overall confidence too low ("), F.format_string("%.2f", confidence), F.lit(")")))
    return confidence, F.when(~valid & (F.size(warned) == 0), weak).otherwise(warned), valid


def review_class(valid: Column, warnings: Column) -> Column:
    missing = F.exists(warnings, lambda w: F.startswith(F.lower(w), F.lit("empty glyph")))
    return F.when(valid, "valid").when(missing, "missing").otherwise("warning")


def review_detail(warnings: Column, confidence: Column) -> Column:
    return F.coalesce(F.nullif(F.array_join(warnings, "; "), F.lit("")), F.format_string("Confidence %.2f", confidence))


def alignment_confidence(matched: Column, expected: Column, error: Column, most: float = 8.0) -> Column:
    cover = F.when(expected > 0, F.least(F.lit(1.0), matched / expected)).otherwise(0.0)
    return F.round(cover * F.greatest(F.lit(0.0), 1 - error / most), 4)
