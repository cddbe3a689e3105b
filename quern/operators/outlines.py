"""From glyph runs to canvases, outlines and packages. Glyph runs: glyph, y, x0, x1 (x1 exclusive).

Outlines follow pixel edges exactly: along every grid line the corners of a shape, sorted, pair up into its segments, so
windows find all segments of all glyphs; only walking a glyph's segments round is done in Python, in its own task.
"""

from __future__ import annotations

import io
import struct
import zipfile
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from quern.functions import geometry
from quern.operators.components import shuffled

#: Canvas side, baseline, heights of tall and short glyphs and of descenders, side margin (shares of the canvas).
CANVAS, BASELINE, TALL, SHORT, DESCENDER, SIDE = 500, 0.75, 0.60, 0.40, 0.18, 0.10


def normalised(runs: DataFrame, kinds: DataFrame) -> DataFrame:
    """Runs scaled to fit their height class on the canvas, on the baseline and centred. kinds: glyph, tall, descender.

    A target pixel takes the source pixel under its centre. Glyphs without kinds or without ink have no rows.
    """
    box = runs.groupBy("glyph").agg(F.min("x0").alias("_x"), F.min("y").alias("_y"), (F.max("x1") - F.min("x0")).alias("_w"), (F.max("y") + 1 - F.min("y")).alias("_h"))
    below = F.when(F.col("descender"), DESCENDER * CANVAS).otherwise(0.0)
    height = F.when(F.col("tall"), TALL * CANVAS).otherwise(SHORT * CANVAS) + below
    s = box.join(shuffled(kinds.select("glyph", "tall", "descender")), "glyph").withColumn("_s", geometry.fit_scale(F.col("_w"), F.col("_h"), height, CANVAS * (1 - 2 * SIDE)))
    s = s.withColumns({"_nw": F.greatest(F.lit(1), F.bround(F.col("_w") * F.col("_s"))).cast("int"), "_nh": F.greatest(F.lit(1), F.bround(F.col("_h") * F.col("_s"))).cast("int")})
    top = F.greatest(F.lit(0), F.least(F.bround(F.lit(BASELINE * CANVAS)) + F.bround(below) - F.col("_nh"), CANVAS - F.col("_nh"))).cast("int")
    left = F.greatest(F.lit(0), F.least(F.bround((CANVAS - F.col("_nw")) / 2), CANVAS - F.col("_nw"))).cast("int")
    s = s.withColumns({"_top": top, "_left": left})

    def edge(v: Column, new: str, old: str) -> Column:
        """The first target pixel whose centre is at or past source edge v."""
        return F.ceil(v * F.col(new) / F.col(old) - 0.5).cast("int")

    r = runs.join(shuffled(s), "glyph")
    r = r.withColumns({"_a": edge(F.col("y") - F.col("_y"), "_nh", "_h"), "_b": edge(F.col("y") - F.col("_y") + 1, "_nh", "_h"), "_p": edge(F.col("x0") - F.col("_x"), "_nw", "_w"), "_q": edge(F.col("x1") - F.col("_x"), "_nw", "_w")})
    r = r.filter("_b > _a and _q > _p").withColumn("_row", F.explode(F.sequence(F.col("_a"), F.col("_b") - 1)))
    return united(r.select("glyph", (F.col("_row") + F.col("_top")).alias("y"), (F.col("_p") + F.col("_left")).alias("x0"), (F.col("_q") + F.col("_left")).alias("x1")))


def united(runs: DataFrame) -> DataFrame:
    """Runs of a row that touch or overlap as one."""
    by = Window.partitionBy("glyph", "y").orderBy("x0", "x1")
    reach = F.max("x1").over(by.rowsBetween(Window.unboundedPreceding, -1))
    r = runs.withColumn("_new", F.coalesce((F.col("x0") > reach).cast("int"), F.lit(0)))
    r = r.withColumn("_g", F.sum("_new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return r.groupBy("glyph", "y", "_g").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1")).drop("_g")


def corners(runs: DataFrame) -> DataFrame:
    """glyph, x, y, h, v: corners of united runs' outline, with the numbers of their horizontal and vertical segment on its line.
    Where two shapes touch at a point there are two corners."""
    ends = runs.select("glyph", "y", F.explode(F.array(F.struct(F.col("x0").alias("x"), F.lit(0).alias("end")), F.struct(F.col("x1").alias("x"), F.lit(1).alias("end")))).alias("e")).select("glyph", "y", "e.x", "e.end")
    # An end of a row lies on the lines above and below; the same end in both rows is no corner.
    lines = ends.select("glyph", "x", "end", F.explode(F.array(F.struct(F.col("y").alias("y"), F.lit(1).alias("under")), F.struct((F.col("y") + 1).alias("y"), F.lit(0).alias("under")))).alias("l"))
    lines = lines.select("glyph", "x", "end", "l.y", "l.under").groupBy("glyph", "x", "y", "end").agg(F.count("*").alias("n"), F.max("under").alias("under")).filter("n = 1")
    # Sorted by end in one direction and against it in the other, corners at one point go to the shapes they belong to.
    across = Window.partitionBy("glyph", "y").orderBy("x", F.desc("end"))
    down = Window.partitionBy("glyph", "x").orderBy("y", "under")
    c = lines.withColumns({"_h": F.row_number().over(across) - 1, "_v": F.row_number().over(down) - 1})
    return c.select("glyph", "x", "y", F.floor(F.col("_h") / 2).alias("h"), F.floor(F.col("_v") / 2).alias("v"))


def outlines(runs: DataFrame) -> DataFrame:
    """glyph, d, subpaths, x0, y0, x1, y1: SVG path data (even-odd) of glyph runs, and its bounds."""
    c = corners(runs)
    kind = c.select("glyph").schema["glyph"].dataType.simpleString()
    # A glyph's corners as one row: many glyphs are walked in one call.
    glyphs = c.groupBy("glyph").agg(F.collect_list(F.struct(*(F.col(n).cast("long").alias(n) for n in "xyhv"))).alias("c"))

    def walk(x, y, h, v) -> list[str]:
        mates = []
        for line, number in ((y, h), (x, v)):
            order = np.lexsort((number, line))
            mate = np.empty(len(order), np.int64)
            mate[order[0::2]], mate[order[1::2]] = order[1::2], order[0::2]
            mates.append(mate.tolist())
        names, seen, paths = [f"{a} {b}" for a, b in zip(x.tolist(), y.tolist())], [False] * len(x), []
        for start in np.lexsort((x, y)).tolist():
            if seen[start]:
                continue
            loop, at, along = [], start, 0
            while not (seen[at] and along == 0):
                seen[at] = True
                loop.append(names[at])
                at, along = mates[along][at], 1 - along
            paths.append("M " + " L ".join(loop) + " Z")
        return paths

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = batch.column("c")
            cuts = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))])
            flat = [lists.flatten().field(n).to_numpy(zero_copy_only=False) for n in "xyhv"]
            paths = [walk(*(f[a:b] for f in flat)) for a, b in zip(cuts, cuts[1:])]
            bounds = [f(flat[i][a:b]) for i, f in ((0, np.min), (1, np.min), (0, np.max), (1, np.max)) for a, b in zip(cuts, cuts[1:])]
            box = np.array(bounds, dtype=np.int64).reshape(4, -1)
            yield pa.RecordBatch.from_arrays([batch.column("glyph"), pa.array([" ".join(p) for p in paths]), pa.array([len(p) for p in paths], pa.int64()), *map(pa.array, box)], ["glyph", "d", "subpaths", "x0", "y0", "x1", "y1"])

    return glyphs.mapInArrow(run, f"glyph {kind}, d string, subpaths long, x0 long, y0 long, x1 long, y1 long")


def svg(d: Column, side: int = CANVAS) -> Column:
    """The SVG document of path data."""
    head = F.lit(f'<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 {side} {side}"><path fill-rule="evenodd" d="')
    return F.concat(head, d, F.lit('"/></svg>'))


def path_data(document: Column) -> Column:
    """The first path's data of an SVG document; null if there is none."""
    return F.nullif(F.regexp_extract(document, r"""<path\b[^>]*?\sd\s*=\s*["']([^"']+)["']""", 1), F.lit(""))


def subpath_points(d: Column) -> Column:
    """array<array<struct<x, y>>> of straight path data."""
    loops = F.filter(F.split(d, r"\s*M\s*"), lambda s: F.trim(s) != "")

    def point(p: Column) -> Column:
        xy = F.split(F.trim(p), r"[ ,]+")
        return F.struct(xy[0].cast("double").alias("x"), xy[1].cast("double").alias("y"))

    return F.transform(loops, lambda s: F.transform(F.split(F.regexp_replace(s, r"\s*Z\s*$", ""), r"\s*L\s*"), point))


def png(gray: np.ndarray) -> bytes:
    """A gray PNG."""

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    h, w = gray.shape
    lines = np.hstack([np.zeros((h, 1), np.uint8), gray]).tobytes()
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


def glyph_pngs(runs: DataFrame, side: int = CANVAS, sizes: DataFrame | None = None) -> DataFrame:
    """glyph, png: each glyph's runs drawn with ink 255 on a canvas of side, or of its own width and height in sizes (glyph, width, height).

    Ink beyond the canvas isn't drawn; with sizes, a glyph without ink is an empty canvas.
    """
    kind = runs.select("glyph").schema["glyph"].dataType.simpleString()
    drawn = runs.groupBy("glyph").agg(F.collect_list(F.struct(*(F.col(c).cast("int").alias(c) for c in ("y", "x0", "x1")))).alias("r"))
    if sizes is None:
        drawn = drawn.withColumns({"width": F.lit(side), "height": F.lit(side)})
    else:
        drawn = sizes.select("glyph", F.col("width").cast("int").alias("width"), F.col("height").cast("int").alias("height")).join(shuffled(drawn), "glyph", "left")

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                a = np.zeros((row["height"], row["width"]), np.uint8)
                for r in row["r"] or ():
                    if 0 <= r["y"] < row["height"]:
                        a[r["y"], max(0, r["x0"]) : max(0, r["x1"])] = 255
                yield pa.RecordBatch.from_arrays([batch.column("glyph").slice(i, 1), pa.array([png(a)], pa.binary())], ["glyph", "png"])

    return drawn.select("glyph", "width", "height", "r").mapInArrow(run, f"glyph {kind}, png binary")


def packages(members: DataFrame) -> DataFrame:
    """job_id, zip: members (job_id, name, content) of each job sorted by name, with a fixed date, so that reruns agree byte for byte."""
    kind = members.select("job_id").schema["job_id"].dataType.simpleString()

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for name, content in sorted(zip(pdf["name"], pdf["content"])):
                z.writestr(zipfile.ZipInfo(name), bytes(content), zipfile.ZIP_DEFLATED)
        return pd.DataFrame({"job_id": [pdf["job_id"].iloc[0]], "zip": [out.getvalue()]})

    return members.groupBy("job_id").applyInPandas(pack, f"job_id {kind}, zip binary")


