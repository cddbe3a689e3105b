"""Upright crops against a pixel by pixel warp, and a turned page through the whole of its extraction."""

import numpy as np
from pyspark.sql import functions as F

from quern.operators import extraction, rectify, template
from tests.test_flow import DPI, letter, runs_of, template_page


def drawn(rows, h, w):
    a = np.zeros((h, w), np.uint8)
    for r in rows:
        assert 0 <= r.x0 < r.x1 <= w
        assert not a[r.y, r.x0 : r.x1].any()
        a[r.y, r.x0 : r.x1] = 1
    return a


def warped(photo, back, x, y, w, h):
    b = np.array(back).reshape(3, 3)
    v, u = np.mgrid[y : y + h, x : x + w]
    p = np.einsum("ij,jkl->ikl", b, np.stack([u, v, np.ones_like(u)]).astype(float))
    sx, sy = (np.floor(p[i] / p[2] + 0.5).astype(int) for i in (0, 1))
    ok = (sx >= 0) & (sy >= 0) & (sx < photo.shape[1]) & (sy < photo.shape[0])
    out = np.zeros((h, w), np.uint8)
    out[ok] = photo[sy[ok], sx[ok]] > 0
    return out


def test_same_as_pixel_by_pixel(spark):
    r = np.random.default_rng(9)
    photo = (np.kron(r.random((30, 40)), np.ones((4, 5))) < 0.5).astype(np.uint8)
    views = {"same": rectify.IDENTITY, "upside down": [-1, 0, 150.2, 0, -1, 100.3, 0, 0, 1], "quarter": [0, -1, 140.1, 1, 0, 3.2, 0, 0, 1], "mirrored": [-1, 0, 170.4, 0, 1, 0, 0, 0, 1]}
    for i in range(8):
        t = r.uniform(-3, 3)
        views[f"any {i}"] = [np.cos(t) * 1.1, -np.sin(t), 90.123, np.sin(t), np.cos(t) * 0.9, 55.456, r.uniform(-2e-3, 2e-3), r.uniform(-2e-3, 2e-3), 1]
    views["negative"] = [-v for v in views["any 1"]]
    windows, want = [], {}
    for n, b in views.items():
        for k, (x, y, w, h) in enumerate(((0, 0, 60, 50), (-30, -20, 70, 45), (35, 20, 1, 30), (10, 10, 40, 1))):
            windows.append(("photo", f"{n} {k}", x, y, w, h, [float(v) for v in b]))
            want[f"{n} {k}"] = warped(photo, b, x, y, w, h)
    windows += [("photo", "null", 3, 4, 20, 20, None), ("photo", "empty", 3, 4, 0, 20, None), ("none", "other photo", 0, 0, 9, 9, None), ("photo", "horizon", 0, 0, 60, 60, [1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.05, 0.0, -1.0])]
    want["null"] = warped(photo, rectify.IDENTITY, 3, 4, 20, 20)
    rows = rectify.upright(spark.createDataFrame(runs_of(photo, "photo"), "image string, y int, x0 int, x1 int"), spark.createDataFrame(windows, "image string, glyph string, x int, y int, width int, height int, back array<double>")).collect()
    for n, a in want.items():
        assert (drawn([x for x in rows if x.glyph == n], *a.shape) == a).all(), n
    assert {x.glyph for x in rows} <= set(want)


def test_turned_page_gives_the_crops_of_a_straight_one(spark):
    written = {"uppercase_A", "uppercase_L", "lowercase_c"}
    straight, elements = template_page(spark, written)
    t = np.deg2rad(7)
    h = np.array([[np.cos(t), np.sin(t), -60.0], [-np.sin(t), np.cos(t), 40.0], [2e-5, -1e-5, 1.0]])  # photo to template
    turned = warped(straight, h, 0, 0, 1000, 1400)  # a photo's pixel shows what lies on the page there
    pages = spark.createDataFrame([("flat", 1, None), ("turned", 1, [float(x) for x in h.ravel()])], "image string, page int, h array<double>")
    runs = spark.createDataFrame(runs_of(straight, "flat") + runs_of(turned, "turned"), "image string, y int, x0 int, x1 int")
    glyphs, ink, failures = extraction.template_glyphs(pages, elements, runs, (template.PAGE_WIDTH, template.PAGE_HEIGHT), DPI)
    assert failures.count() == 0
    boxes = {r.glyph: (r.height, r.width) for r in glyphs.filter(F.col("character_id").isin(*written)).collect()}
    assert len(boxes) == 6
    rows = ink.collect()
    assert {r.glyph for r in rows} == set(boxes)
    for c in written:
        a, b = (drawn([r for r in rows if r.glyph == f"{p}/{c}"], *boxes[f"{p}/{c}"]) for p in ("flat", "turned"))
        assert a.sum() == (letter()[:60, 10:50] > 0).sum()
        wide = lambda m: np.max([np.roll(m, (i, j), (0, 1)) for i in (-1, 0, 1) for j in (-1, 0, 1)], axis=0)
        assert (b <= wide(a)).all() and (a <= wide(b)).all() and abs(int(a.sum()) - int(b.sum())) < 0.1 * a.sum()
