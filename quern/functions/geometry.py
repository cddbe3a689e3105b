"""Boxes, pages and glyph placement as column expressions. Points have y upwards, pixels downwards."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def pixels(points: Column, dpi: float) -> Column:
    return points * dpi / 72


def page_pixels(points: Column, dpi: float) -> Column:
    """Whole pixels, half to even."""
    return F.bround(pixels(points, dpi)).cast("int")


def flipped_y(y: Column, height: Column, page_height: Column, dpi: float) -> Column:
    return (page_height - (y + height)) * dpi / 72


def clamped(start: Column, length: Column, pad: int, limit: Column) -> tuple[Column, Column]:
    """(from, to) of a padded window inside [0, limit]; the window is empty if from >= to."""
    low = F.greatest(F.lit(0), (F.bround(start) - pad).cast("int"))
    return low, F.least(limit.cast("int"), (F.bround(start + length) + pad).cast("int"))


def edge_gap(ax: Column, ay: Column, aw: Column, ah: Column, bx: Column, by: Column, bw: Column, bh: Column) -> Column:
    """Distance between two boxes' edges, 0 if they overlap."""
    dx = F.greatest(bx - (ax + aw), ax - (bx + bw), F.lit(0))
    dy = F.greatest(by - (ay + ah), ay - (by + bh), F.lit(0))
    return F.sqrt(dx * dx + dy * dy)


def box_corners(x: Column, y: Column, width: Column, height: Column) -> Column:
    """Array of the corners (x, y) of a box in pixels: top left, top right, bottom right, bottom left."""
    at = ((x, y), (x + width, y), (x + width, y + height), (x, y + height))
    return F.array(*(F.struct(a.cast("double").alias("x"), b.cast("double").alias("y")) for a, b in at))


def advance(x0: Column, x1: Column, bearing: int) -> tuple[Column, Column]:
    """(advance width, shift) of an outline between x0 and x1 with bearing on both sides."""
    return F.bround(x1 - x0 + 2 * bearing).cast("int"), bearing - x0


def font_lines(canvas: int, baseline: float) -> tuple[int, int]:
    """(ascender, descender) of a canvas whose baseline lies at a share of its height: together they are the canvas."""
    up = round(canvas * baseline)
    return up, up - canvas


def upwards(points: Column, ascender: int, shift: Column) -> Column:
    """Canvas points (x, y down) as font points (x shifted, y up from the baseline)."""
    return F.transform(points, lambda p: F.struct((p["x"] + shift).alias("x"), (ascender - p["y"]).alias("y")))


def grid_cell(index: Column, columns: int, rows: int) -> tuple[Column, Column, Column]:
    """(page from 1, row, column) of the index-th cell in reading order."""
    return (F.floor(index / (columns * rows)) + 1).cast("int"), F.floor(F.pmod(index, F.lit(columns * rows)) / columns).cast("int"), F.pmod(index, F.lit(columns)).cast("int")


def fit_scale(width: Column, height: Column, target_height: Column, target_width: float) -> Column:
    return F.least(target_height / height, F.lit(float(target_width)) / width)


def skew_angle(raw: Column, limit: float = 15.0) -> Column:
    """The angle in [-45, 45), or 0 beyond the limit."""
    a = F.pmod(raw + 45, F.lit(90.0)) - 45
    return F.when(F.abs(a) > limit, 0.0).otherwise(a)
