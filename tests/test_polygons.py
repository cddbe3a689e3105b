"""Polygons against plain arithmetic, pages on drawn photos, and paths against dense sampling."""

import math

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from quern.operators import paths, polygons, raster


def table(spark, loops):
    return spark.createDataFrame([(n, [(float(x), float(y)) for x, y in p]) for n, p in loops.items()], "n string, p array<struct<x:double,y:double>>")


def test_measures(spark):
    loops = {
        "square": [(0, 0), (4, 0), (4, 4), (0, 4)], "other way": [(0, 4), (4, 4), (4, 0), (0, 0)], "straight corner": [(0, 0), (2, 0), (4, 0), (4, 4), (0, 4)],
        "dent": [(0, 0), (4, 0), (1, 1), (0, 4)], "two": [(0, 0), (3, 4)], "one": [(1, 1)], "none": [],
    }
    rows = {r.n: (r.a, r.l, r.c) for r in table(spark, loops).select("n", polygons.signed_area(F.col("p")).alias("a"), polygons.perimeter(F.col("p")).alias("l"), polygons.convex(F.col("p")).alias("c")).collect()}
    assert rows == {"square": (16, 16, True), "other way": (-16, 16, True), "straight corner": (16, 16, True), "dent": (4, 8 + 2 * math.hypot(3, 1), False), "two": (0, 10, False), "one": (0, 0, False), "none": (0, 0, False)}


def test_simplified_outlines(spark):
    t = np.linspace(0, 1, 50, endpoint=False)
    corners = np.array([(10, 20), (210, 40), (190, 300), (30, 280)], float)
    rough = np.concatenate([a + (b - a) * t[:, None] for a, b in zip(corners, np.roll(corners, -1, axis=0))])
    rough += np.random.default_rng(3).uniform(-1, 1, rough.shape)
    ring = np.array([(100 * math.cos(a), 100 * math.sin(a)) for a in np.linspace(0, 2 * math.pi, 90, endpoint=False)])
    df = table(spark, {"page": rough, "ring": ring, "few": corners[:3]})
    got = {r.n: np.array([(q.x, q.y) for q in r.q]) for r in df.withColumn("q", polygons.simplified(F.col("p"), 0.02 * polygons.perimeter(F.col("p")))).collect()}
    assert len(got["page"]) == 4 and max(np.hypot(*(got["page"] - c).T).min() for c in corners) < 3
    assert len(got["ring"]) > 4 and len(got["few"]) == 3
    for n, p in (("page", rough), ("ring", ring)):  # nothing that was left out is far from what stayed
        a, b = got[n], np.roll(got[n], -1, axis=0)
        far = 0.02 * sum(np.hypot(*(p - np.roll(p, 1, axis=0)).T))
        for q in p:
            u = np.clip(((q - a) * (b - a)).sum(1) / ((b - a) ** 2).sum(1), 0, 1)
            assert np.hypot(*(a + (b - a) * u[:, None] - q).T).min() <= far + 1e-9


def runs_of(a, name):
    p = np.diff(np.pad((a > 0).astype(np.int8), ((0, 0), (1, 1))), axis=1)
    y, x0 = np.nonzero(p == 1)
    return [(name, int(r), int(s), int(e)) for r, s, e in zip(y, x0, np.nonzero(p == -1)[1])]


def test_pages_on_photos(spark):
    """A page at eight degrees on noise is found, with its corners; noise, a disc and a page that is too small aren't."""
    y, x = np.mgrid[0:600, 0:800]
    r, t = np.random.default_rng(0), math.radians(8)
    u, v = (x - 400) * math.cos(t) + (y - 300) * math.sin(t), -(x - 400) * math.sin(t) + (y - 300) * math.cos(t)
    noise = r.random((600, 800)) < 0.02
    photos = {"page": (abs(u) <= 250) & (abs(v) <= 150) | noise, "small": (abs(u) <= 100) & (abs(v) <= 100), "disc": np.hypot(u, v) < 280, "noise": noise, "written": (abs(u) <= 250) & (abs(v) <= 200) & ~((abs(u) < 50) & (abs(v) < 5))}
    runs = spark.createDataFrame([q for n, a in photos.items() for q in runs_of(a, n)], "image string, y int, x0 int, x1 int")
    images = spark.createDataFrame([(n, 800, 600, 160.0 if n == "disc" else 60.0) for n in [*photos, "black"]], "image string, width int, height int, brightness double")
    found = polygons.page_corners(images, runs)
    got = {q.image: q for q in found.collect()}
    assert set(got) == {"page", "written"}
    for n, h in (("page", 150), ("written", 200)):
        for name, (a, b) in {"tl": (-250, -h), "tr": (250, -h), "br": (250, h), "bl": (-250, h)}.items():
            want = (400 + a * math.cos(t) - b * math.sin(t), 300 + a * math.sin(t) + b * math.cos(t))
            assert math.dist((got[n][name].x, got[n][name].y), want) < 6
    frames = {q.image: (q.detected, q.failure) for q in raster.page_frames(images, found).collect()}
    assert frames == {"page": (True, None), "written": (True, None), "disc": (False, None), "small": (False, "page not found"), "noise": (False, "page not found"), "black": (False, "page not found")}
    assert polygons.page_corners(images, runs.limit(0)).collect() == []


def test_bounds_of_curves(spark):
    r, rows, want = np.random.default_rng(5), [], {}
    s = np.linspace(0, 1, 4001)[:, None]
    for i in range(60):
        text, seen, at = [], [], None
        for sub in range(2):
            start = at = r.uniform(-100, 100, 2).round(2)
            text.append(f"M {at[0]} {at[1]}")
            seen.append(at[None])
            for kind in r.choice(["L", "Q", "C"], 4):
                p = r.uniform(-100, 100, ({"L": 1, "Q": 2, "C": 3}[kind], 2)).round(2)
                text.append(f"{kind}" + ",".join(f"{a} {b}" for a, b in p))
                if kind == "L":
                    seen.append(p)
                elif kind == "Q":
                    seen.append((1 - s) ** 2 * at + 2 * s * (1 - s) * p[0] + s * s * p[1])
                else:
                    seen.append((1 - s) ** 3 * at + 3 * s * (1 - s) ** 2 * p[0] + 3 * s * s * (1 - s) * p[1] + s**3 * p[2])
                at = p[-1]
            if sub:
                text.append("ZL 3 4")  # goes on from where the part began
                seen.append(np.array([[3.0, 4.0]]))
        rows.append((i, " ".join(text)))
        seen = np.concatenate(seen)
        want[i] = (*seen.min(axis=0), *seen.max(axis=0))
    rows += [(100, "M 1 2 C 1 2 1 2 1 2 Q 1 2 1 2 Z"), (101, ""), (102, None), (103, "M-1.5-2L.5 1e1Z")]
    df = spark.createDataFrame(rows, "k int, d string")
    got = {q.k: (q.x0, q.y0, q.x1, q.y1) for q in paths.bounds(df, "k", "d").collect()}
    assert set(got) == set(range(60)) | {100, 103} and got[100] == (1, 2, 1, 2) and got[103] == (-1.5, -2, 0.5, 10)
    for i, w in want.items():
        assert np.allclose(got[i], w, atol=1e-3), i
    for bad in ("M 1", "M 1 2 A 3 4", "M 1 2 L 1 2 3"):
        with pytest.raises(PySparkException, match="not a command"):
            paths.bounds(spark.createDataFrame([(1, bad)], "k int, d string"), "k", "d").collect()


def test_path_text(spark):
    df = table(spark, {"a": [(1, 2.004), (1234.5, -3)]})
    assert df.select(paths.path_text(F.col("p")).alias("t")).first().t == "M 1.00 2.00 L 1234.50 -3.00 Z"
