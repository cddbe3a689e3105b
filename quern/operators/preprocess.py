"""From photos to upright pages: the page is found, fetched flat, and turned by what its ink is skewed.

A chain of operators over all photos at once, in which a photo that shows no page, or too little ink to tell its skew, stays as a
row with its reason. Pixels are left in the first task; from there on pages are runs.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.operators import alignment, polygons, raster, rectify, skew
from quern.operators.components import stored


@dataclass
class Pages:
    """pages: image, width, height, detected, angle, failure. runs: image, y, x0, x1 of the pages without a failure."""

    pages: DataFrame
    runs: DataFrame


def turned_back(angle: Column, width: Column, height: Column) -> Column:
    """The homography that fetches a page turned by angle degrees (x towards y) around its centre upright."""
    t, cx, cy, zero = F.radians(angle), width / 2, height / 2, F.lit(0.0)
    c, s = F.cos(t), F.sin(t)
    return F.array(c, -s, cx - c * cx + s * cy, s, c, cy - s * cx - c * cy, zero, zero, F.lit(1.0))


def without_frame(runs: DataFrame, sizes: DataFrame) -> DataFrame:
    """runs without components that reach the border of their page: what lies around the paper. Only pages in sizes are looked at."""
    parts = stored(raster.labelled(runs.join(sizes, "image", "left_semi")))
    inside = raster.away_from_border(raster.boxes(parts).join(sizes, "image")).select("image", "component")
    return runs.join(sizes, "image", "left_anti").unionByName(parts.join(inside, ["image", "component"], "left_semi").select(*runs.columns))


def upright_pages(images: DataFrame, ink: DataFrame, corners: DataFrame, size: tuple[int, int], dimmest: float = 150.0) -> Pages:
    """Pages of photos. images: image, width, height, brightness; ink: runs of dark ink on the photos; corners: image, tl, tr, br, bl.

    A page that was found is fetched to size (width, height) pixels, without what reaches its border; a bright photo without one is a page as it is, a dark one
    fails (raster.page_frames). Pages with too little ink fail (skew.skew); others are turned back by their skew.
    """
    frames = raster.page_frames(images, corners, dimmest).join(images.select("image", "width", "height"), "image")
    w, h = (F.when(F.col("detected"), s).otherwise(F.col(c)).cast("int") for s, c in zip(size, ("width", "height")))
    frames = stored(frames.select("image", "corners", "detected", "failure", w.alias("width"), h.alias("height")))
    right, low, zero = (F.col("width") - 1).cast("double"), (F.col("height") - 1).cast("double"), F.lit(0.0)
    at = {"tl": (zero, zero), "tr": (right, zero), "br": (right, low), "bl": (zero, low)}
    pairs = F.array(*(F.struct(x.alias("x"), y.alias("y"), F.col(f"corners.{n}.x").alias("u"), F.col(f"corners.{n}.y").alias("v")) for n, (x, y) in at.items()))
    points = frames.filter("failure is null and detected").select("image", F.inline(pairs))
    back = alignment._fits(points, ["image"]).withColumnRenamed("h", "back")
    good = frames.filter("failure is null").join(back, "image", "left")
    whole = [F.lit(0).alias("x"), F.lit(0).alias("y"), "width", "height"]
    flat = rectify.upright(ink, good.select("image", F.col("image").alias("glyph"), *whole, "back")).withColumnRenamed("glyph", "image")
    flat = stored(without_frame(flat, good.filter("detected").select("image", "width", "height")))
    leaning = stored(skew.skew(good.select("image"), flat).withColumnRenamed("failure", "_f"))
    pages = frames.join(leaning, "image", "left").select("image", "width", "height", "detected", "angle", F.coalesce("failure", "_f").alias("failure"))
    pages = stored(pages)
    lean = pages.filter("failure is null").select("image", F.col("image").alias("glyph"), *whole, F.when(F.col("angle") != 0, turned_back(F.col("angle"), F.col("width"), F.col("height"))).alias("back"))
    return Pages(pages, rectify.upright(flat, lean).withColumnRenamed("glyph", "image"))


def preprocessed(photos: DataFrame, size: tuple[int, int], dimmest: float = 150.0) -> Pages:
    """upright_pages of photos (image, height, width, channels, data): ink by each one's own threshold, and its page's outline.

    A photo that can't be read is a dark one without a page.
    """
    sizes = photos.select("image", F.greatest("width", F.lit(0)).alias("width"), F.greatest("height", F.lit(0)).alias("height"))
    images = stored(sizes.join(raster.brightness(photos), "image", "left").fillna(0.0, ["brightness"]))
    corners = polygons.page_corners(images, raster.bright_runs(photos))
    return upright_pages(images, stored(raster.image_runs(photos)), stored(corners), size, dimmest)
