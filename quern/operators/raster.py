"""Rasters as tables: pixels (image, x, y, v) and ink runs (image, y, x0, x1), x1 exclusive; y grows downwards.

A photo enters as one row of bytes and leaves its task as runs: it is decoded once and its bytes are never shuffled. From there
on everything is joins, windows and aggregates over runs, for all images together. Runs of a page are some thousand rows
where its pixels are millions. What belongs together inside an image (components, near boxes) is found in the image's task.
Null images or values hold no ink; an image without ink has no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from quern.operators.components import local_labels, shuffled
from quern.operators.ranking import row_gaps

#: Smallest component, merge gap and border margin as shares of the page, row gap in median heights, padding, smallest component in a glyph as share of its largest.
MIN_AREA, MERGE_GAP, BORDER, ROW_GAP, PADDING, KEEP_RATIO = 12, 0.018, 0.01, 1.4, 10, 0.40
#: Fixed weights of blue, green and red.
GRAY = (0.114, 0.587, 0.299)
#: Run starts are numbered y * WIDE + x0, so images may be WIDE pixels wide.
WIDE = 1 << 20


def pixels(df: DataFrame, image: str, values: Column, width: int) -> DataFrame:
    """image, x, y, v of arrays of gray values in row order."""
    at = df.select(F.col(image).alias("image"), F.posexplode(values).alias("p", "v"))
    return at.select("image", (F.col("p") % width).alias("x"), F.floor(F.col("p") / width).cast("int").alias("y"), "v")


def runs_of_pixels(ink: DataFrame) -> DataFrame:
    """Runs of ink pixels (image, x, y): neighbours share x minus their rank in the row."""
    rank = F.row_number().over(Window.partitionBy("image", "y").orderBy("x"))
    return ink.withColumn("_g", F.col("x") - rank).groupBy("image", "y", "_g").agg(F.min("x").alias("x0"), (F.max("x") + 1).alias("x1")).drop("_g")


#: Rows of a photo whose neighbourhoods are sorted at a time: nine bytes a pixel of these rows.
STRIP = 256


def _plain_gray(row: dict) -> np.ndarray:
    """Gray values of one image row (height, width, channels, data in BGR order)."""
    a = np.frombuffer(row["data"], np.uint8).reshape(row["height"], row["width"], row["channels"])
    return a[:, :, 0] if row["channels"] == 1 else np.rint(a[:, :, :3] @ np.array(GRAY, np.float32)).astype(np.uint8)


def _gray(row: dict) -> np.ndarray:
    """Gray values of one image row after a 3 x 3 median, strip by strip."""
    g = _plain_gray(row)
    p, (h, w), out = np.pad(g, 1, mode="edge"), g.shape, np.empty_like(g)
    for at in range(0, h, STRIP):
        n = min(STRIP, h - at)
        near = np.stack([p[at + i : at + i + n, j : j + w] for i in range(3) for j in range(3)])
        near.partition(4, axis=0)
        out[at : at + n] = near[4]
    return out


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def histograms(images: DataFrame) -> DataFrame:
    """image, v, n: gray values of each image. images: image, height, width, channels, data; undecodable ones have no data."""
    kind = images.select("image").schema["image"].dataType.simpleString()
    schema = f"image {kind}, v int, n long"

    def count(batches):
        for row in _rows(batches):
            n = np.bincount(_gray(row).ravel(), minlength=256)
            v = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([row["image"]] * len(v), pa.string() if kind == "string" else pa.int64()), pa.array(v, pa.int32()), pa.array(n[v], pa.int64())], ["image", "v", "n"])

    return images.filter("height > 0 and width > 0").select("image", "height", "width", "channels", "data").mapInArrow(count, schema)


def otsu_of_histograms(hist: DataFrame) -> DataFrame:
    """image, threshold: the first gray value of greatest between-class variance."""
    upto, whole = Window.partitionBy("image").orderBy("v"), Window.partitionBy("image")
    n, nv = F.col("n").cast("double"), F.col("n").cast("double") * F.col("v")
    h = hist.withColumns({"w": F.sum(n).over(upto), "s": F.sum(nv).over(upto), "tw": F.sum(n).over(whole), "ts": F.sum(nv).over(whole)})
    apart = F.col("s") / F.col("w") - (F.col("ts") - F.col("s")) / (F.col("tw") - F.col("w"))
    between = F.when(F.col("w") < F.col("tw"), F.col("w") * (F.col("tw") - F.col("w")) * apart * apart).otherwise(0.0)
    return h.withColumn("between", F.round(between, 3)).groupBy("image").agg(F.max_by("v", F.struct("between", -F.col("v"))).alias("threshold"))


def _threshold(gray: np.ndarray) -> int:
    """The first gray value of greatest between-class variance."""
    n = np.bincount(gray.ravel(), minlength=256).astype(np.float64)
    w, s = np.cumsum(n), np.cumsum(n * np.arange(256))
    with np.errstate(divide="ignore", invalid="ignore"):
        between = np.where((w > 0) & (w < w[-1]), w * (w[-1] - w) * (s / w - (s[-1] - s) / (w[-1] - w)) ** 2, 0.0)
    between[n == 0] = -1
    return int(np.round(between, 3).argmax())


def _cut_runs(images: DataFrame, chosen) -> DataFrame:
    """Runs of the pixels that chosen(image row) marks, found in the task that holds the image."""
    kind = images.select("image").schema["image"].dataType.simpleString()

    def cut(batches):
        for row in _rows(batches):
            step = np.diff(np.pad(chosen(row).astype(np.int8), ((0, 0), (1, 1))), axis=1)
            y, x0 = np.nonzero(step == 1)
            x1 = np.nonzero(step == -1)[1]
            yield pa.RecordBatch.from_arrays([pa.array([row["image"]] * len(y), pa.string() if kind == "string" else pa.int64()), *(pa.array(c, pa.int32()) for c in (y, x0, x1))], ["image", "y", "x0", "x1"])

    named = images.filter("height > 0 and width > 0").select("image", "height", "width", "channels", "data")
    return named.mapInArrow(cut, f"image {kind}, y int, x0 int, x1 int")


def image_runs(images: DataFrame) -> DataFrame:
    """Ink runs of photos: dark ink at or under each image's own Otsu threshold, found in the same task."""

    def dark(row):
        gray = _gray(row)
        return gray <= _threshold(gray)

    return _cut_runs(images, dark)


def bright_runs(images: DataFrame, above: int | None = None) -> DataFrame:
    """Runs brighter than above, or, by default, than each image's own Otsu threshold: paper on photos, ink of stored crops."""

    def bright(row):
        gray = _plain_gray(row) if above is not None else _gray(row)
        return gray > (_threshold(gray) if above is None else above)

    return _cut_runs(images, bright)


def brightness(images: DataFrame) -> DataFrame:
    """image, brightness: the mean gray value of photos; unreadable ones have no row."""
    kind = images.select("image").schema["image"].dataType.simpleString()

    def mean(batches):
        for row in _rows(batches):
            yield pa.RecordBatch.from_arrays([pa.array([row["image"]], pa.string() if kind == "string" else pa.int64()), pa.array([float(_plain_gray(row).mean(dtype=np.float64))])], ["image", "brightness"])

    named = images.filter("height > 0 and width > 0").select("image", "height", "width", "channels", "data")
    return named.mapInArrow(mean, f"image {kind}, brightness double")


def _per_image(rows: DataFrame, names: list[str], work, schema: str, per: int = 2000) -> DataFrame:
    """rows (image, names: numbers) gathered by image; work gets arrays of many images, sorted by image and names, and gives columns.

    work(owner, *columns) returns (row numbers, extra columns); owner numbers the images. One image's rows, which come from
    one photo, are the most that is held beside the bound of per images at a time. Result: image, names, then the extra columns.
    """
    grouped = rows.groupBy("image").agg(F.array_sort(F.collect_list(F.struct(*names))).alias("_r"))
    image = grouped.schema["image"].dataType.simpleString()
    kinds = ", ".join(f"{n} {rows.schema[n].dataType.simpleString()}" for n in names)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, per):
                part = batch.slice(at, per)
                lists = part.column("_r")
                owner = np.repeat(np.arange(part.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
                flat = lists.flatten()
                columns = [flat.field(n) for n in names]
                kept, extra = work(owner, *(c.to_numpy(zero_copy_only=False) for c in columns))
                take = pa.array(kept)
                yield pa.RecordBatch.from_arrays([part.column("image").take(pa.array(owner[kept])), *(c.take(take) for c in columns), *(pa.array(v) for v in extra.values())], ["image", *names, *extra])

    return grouped.mapInArrow(run, f"image {image}, {kinds}, {schema}")


def labelled(runs: DataFrame) -> DataFrame:
    """image, y, x0, x1, component: 8-connected components; two runs in rows that follow touch if they share or adjoin a column."""

    def work(owner, y, x0, x1):
        y, x0, x1 = (v.astype(np.int64) for v in (y, x0, x1))
        line = owner * (WIDE << 1) + y - (y.min() if len(y) else 0) + 1  # rows of all images, with a gap between images
        at = np.arange(len(y))
        low = np.searchsorted(line * (WIDE << 1) + x1, (line - 1) * (WIDE << 1) + x0)
        high = np.searchsorted(line * (WIDE << 1) + x0, (line - 1) * (WIDE << 1) + x1, side="right")
        many = np.maximum(high - low, 0)
        b = np.repeat(at, many)
        a = np.repeat(low - np.cumsum(many) + many, many) + np.arange(many.sum())
        root = local_labels(len(y), a, b)
        return at, {"component": y[root] * WIDE + x0[root]}

    whole = runs.select("image", *(F.col(c).cast("int").alias(c) for c in ("y", "x0", "x1")))
    return _per_image(whole, ["y", "x0", "x1"], work, "component long")


def boxes(parts: DataFrame) -> DataFrame:
    """image, component, x, y, w, h, area of labelled runs."""
    found = parts.groupBy("image", "component").agg(F.min("x0").alias("x"), F.min("y").alias("y"), F.max("x1").alias("_x1"), (F.max("y") + 1).alias("_y1"), F.sum(F.col("x1") - F.col("x0")).alias("area"))
    return found.select("image", "component", "x", "y", (F.col("_x1") - F.col("x")).alias("w"), (F.col("_y1") - F.col("y")).alias("h"), "area")


def without_specks(parts: DataFrame, ratio: float = KEEP_RATIO) -> DataFrame:
    """Labelled runs whose component has at least ratio times the area of its image's largest."""
    b = boxes(parts).select("image", "component", "area")
    top = b.groupBy("image").agg(F.max("area").alias("_top"))
    keep = b.join(shuffled(top), "image").filter(F.col("area") >= ratio * F.col("_top")).select("image", "component")
    return parts.join(shuffled(keep), ["image", "component"], "left_semi")


def measures(runs: DataFrame) -> DataFrame:
    """image, ink, x0, y0, x1, y1 (half-open box of all ink)."""
    return runs.groupBy("image").agg(F.sum(F.col("x1") - F.col("x0")).alias("ink"), F.min("x0").alias("x0"), F.min("y").alias("y0"), F.max("x1").alias("x1"), (F.max("y") + 1).alias("y1"))


def component_counts(parts: DataFrame) -> DataFrame:
    """image, strokes: how many components each image's labelled runs have."""
    return parts.groupBy("image").agg(F.countDistinct("component").alias("strokes"))


def merged_boxes(found: DataFrame, gap: Column) -> DataFrame:
    """image, component, x, y, w, h, parts: boxes united that chain within less than gap between edges."""

    def work(owner, x, y, w, h, component, gap):
        x, y, w, h = (v.astype(np.float64) for v in (x, y, w, h))
        span = 4.0 * (np.max(np.abs(x) + w + gap) + 1) if len(x) else 1.0
        place, a, b, at = owner * span + x, [], [], 0  # boxes are sorted by image, then x: each looks ahead only
        last = np.searchsorted(place, place + w + gap, side="right")
        while at < len(x):
            upto = np.cumsum(last[at:] - np.arange(at, len(x)) - 1)
            end = at + max(1, int(np.searchsorted(upto, 1 << 20)))
            many = last[at:end] - np.arange(at, end) - 1
            i = np.repeat(np.arange(at, end), many)
            j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(many) - many, many)
            dx = np.maximum(np.maximum(x[j] - (x[i] + w[i]), x[i] - (x[j] + w[j])), 0)
            dy = np.maximum(np.maximum(y[j] - (y[i] + h[i]), y[i] - (y[j] + h[j])), 0)
            near = (np.sqrt(dx * dx + dy * dy) < gap[i]) & (owner[i] == owner[j])
            a, b, at = [*a, i[near]], [*b, j[near]], end
        none = np.zeros(0, dtype=np.int64)
        root = local_labels(len(x), np.concatenate([none, *a]), np.concatenate([none, *b]))
        least = np.full(len(x), np.iinfo(np.int64).max)
        np.minimum.at(least, root, component)
        return np.arange(len(x)), {"whole": least[root]}

    rows = found.select("image", *(F.col(c).cast("double").alias(c) for c in "xywh"), F.col("component").cast("long").alias("component"), gap.cast("double").alias("gap"))
    whole = _per_image(rows, ["x", "y", "w", "h", "component", "gap"], work, "whole long").select("image", "component", "whole")
    whole = found.join(shuffled(whole), ["image", "component"])
    out = whole.groupBy("image", F.col("whole").alias("component")).agg(F.min("x").alias("x"), F.min("y").alias("y"), F.max(F.col("x") + F.col("w")).alias("_x1"), F.max(F.col("y") + F.col("h")).alias("_y1"), F.count("*").alias("parts"))
    return out.select("image", "component", "x", "y", (F.col("_x1") - F.col("x")).alias("w"), (F.col("_y1") - F.col("y")).alias("h"), "parts")


def away_from_border(found: DataFrame, share: float = BORDER) -> DataFrame:
    """Boxes (x, y, w, h) further than share of the page (width, height) from all its borders."""
    mx, my = share * F.col("width"), share * F.col("height")
    return found.filter(~((F.col("x") <= mx) | (F.col("y") <= my) | (F.col("x") + F.col("w") >= F.col("width") - mx) | (F.col("y") + F.col("h") >= F.col("height") - my)))


def freeform_marks(runs: DataFrame, sizes: DataFrame) -> DataFrame:
    """image, position, x, y, w, h: characters of a plain page in reading order. sizes: image, width, height.

    The order of steps matters: small components go, near ones unite, united ones at the border go, rows are read.
    """
    found = boxes(labelled(runs)).filter(F.col("area") >= MIN_AREA).join(shuffled(sizes), "image")
    inside = away_from_border(merged_boxes(found, MERGE_GAP * F.col("width")).join(shuffled(sizes), "image"))
    inside = inside.select("image", "component", "x", "y", "w", "h", (F.col("y") + F.col("h") / 2).alias("_yc"))
    tall = row_gaps(inside, ["image"], "h", ROW_GAP).withColumnRenamed("gap", "_gap")
    by = Window.partitionBy("image").orderBy("_yc", "component")
    new = F.coalesce((F.col("_yc") - F.lag("_yc").over(by) > F.col("_gap")).cast("int"), F.lit(0))
    rows = inside.join(shuffled(tall), "image").withColumn("_new", new)
    rows = rows.withColumn("_row", F.sum("_new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.select("image", F.row_number().over(Window.partitionBy("image").orderBy("_row", "x", "_yc", "component")).alias("position"), "x", "y", "w", "h")


def cut(runs: DataFrame, windows: DataFrame) -> DataFrame:
    """Runs inside windows (image, glyph, x, y, width, height), in each window's own coordinates and without specks.

    glyph (any type) names a window; the result has glyph, y, x0, x1. A window without ink has no rows.
    """
    m = windows.select("image", "glyph", F.col("x").alias("_x"), F.col("y").alias("_y"), "width", "height").filter("width > 0 and height > 0")
    rows = m.withColumn("y", F.explode(F.sequence(F.col("_y").cast("int"), (F.col("_y") + F.col("height") - 1).cast("int"))))
    inside = rows.join(shuffled(runs), ["image", "y"]).filter("x1 > _x and x0 < _x + width")
    inside = inside.select(F.col("glyph").alias("image"), (F.col("y") - F.col("_y")).cast("int").alias("y"), F.greatest(F.lit(0), F.col("x0") - F.col("_x")).alias("x0"), F.least(F.col("width"), F.col("x1") - F.col("_x")).alias("x1"))
    return without_specks(labelled(inside)).select(F.col("image").alias("glyph"), "y", "x0", "x1")


def padded(marks: DataFrame, padding: int = PADDING) -> DataFrame:
    """marks (image, x, y, w, h and the page's width, height) with x, y, width, height of their padded boxes inside the page."""
    lo_x, lo_y = F.greatest(F.lit(0), F.col("x") - padding), F.greatest(F.lit(0), F.col("y") - padding)
    hi_x, hi_y = F.least(F.col("width"), F.col("x") + F.col("w") + padding), F.least(F.col("height"), F.col("y") + F.col("h") + padding)
    kept = [c for c in marks.columns if c not in ("x", "y", "w", "h", "width", "height")]
    return marks.select(*kept, lo_x.cast("int").alias("x"), lo_y.cast("int").alias("y"), (hi_x - lo_x).cast("int").alias("width"), (hi_y - lo_y).cast("int").alias("height"))


def crops(runs: DataFrame, marks: DataFrame, sizes: DataFrame, padding: int = PADDING) -> DataFrame:
    """Runs inside each mark's padded box, in the box's own coordinates and without specks: image, position, y, x0, x1, width, height."""
    m = padded(marks.join(shuffled(sizes), "image"), padding)
    m = m.withColumn("glyph", F.struct("image", "position", "width", "height"))
    return cut(runs, m).select("glyph.image", "glyph.position", "y", "x0", "x1", "glyph.width", "glyph.height")


def content_box(values: DataFrame, above: int = 10) -> DataFrame:
    """image, x0, y0, x1, y1 (half-open): the box of pixels (image, x, y, v) brighter than above; all of an image without any."""
    bright = F.col("v") > above
    names = (("x0", F.min, "x", 0), ("y0", F.min, "y", 0), ("x1", F.max, "x", 1), ("y1", F.max, "y", 1))
    return values.groupBy("image").agg(*((F.coalesce(f(F.when(bright, F.col(c))), f(c)) + add).alias(n) for n, f, c, add in names))


def page_frames(images: DataFrame, corners: DataFrame, dimmest: float = 150.0) -> DataFrame:
    """image, corners, detected, failure: detected page corners (image, tl, tr, br, bl), or the whole frame of a bright image.

    images: image, width, height, brightness. A dark image (mean under dimmest) without corners isn't a page and fails.
    """

    def point(x, y):
        return F.struct(F.col(x).cast("double").alias("x") if isinstance(x, str) else x.cast("double").alias("x"), y.cast("double").alias("y"))

    zero, right, low = F.lit(0.0), F.col("width") - 1, F.col("height") - 1
    frame = F.struct(point(zero, zero).alias("tl"), point(right, zero).alias("tr"), point(right, low).alias("br"), point(zero, low).alias("bl"))
    rows = images.join(corners.select("image", F.struct("tl", "tr", "br", "bl").alias("_c")), "image", "left")
    failure = F.when(F.col("_c").isNull() & (F.col("brightness") < dimmest), "page not found")
    return rows.select("image", F.when(failure.isNull(), F.coalesce("_c", frame)).alias("corners"), F.col("_c").isNotNull().alias("detected"), failure.alias("failure"))


def too_little_ink(sizes: DataFrame, least: int = 50) -> DataFrame:
    """image of measured images (image, ink) whose skew can't be estimated: fewer than least ink pixels."""
    return sizes.filter(F.coalesce("ink", F.lit(0)) < least).select("image")
