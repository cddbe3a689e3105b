"""Stencils, morphology and skew against arrays."""

import math

import numpy as np
import pytest

from quern.operators import filters, skew


def runs_of(a, name):
    p = np.diff(np.pad((a > 0).astype(np.int8), ((0, 0), (1, 1))), axis=1)
    y, x0 = np.nonzero(p == 1)
    return [(name, int(r), int(s), int(e)) for r, s, e in zip(y, x0, np.nonzero(p == -1)[1])]


def drawn(rows, shape):
    a = np.zeros(shape, np.uint8)
    for r in rows:
        a[r.y, r.x0 : r.x1] = 1
    return a


def spread(a, rx, ry, fill, pick):
    p = np.pad(a, ((ry, ry), (rx, rx)), constant_values=fill)
    h, w = a.shape
    return pick(np.stack([p[j : j + h, i : i + w] for j in range(2 * ry + 1) for i in range(2 * rx + 1)]), axis=0)


@pytest.fixture(scope="module")
def scenes():
    r = np.random.default_rng(4)
    made = {f"noise{i}": (r.random((23, 31)) < share).astype(np.uint8) for i, share in enumerate((0.2, 0.6, 0.9))}
    made["full"], made["thin"] = np.ones((5, 4), np.uint8), np.eye(9, 14, dtype=np.uint8)
    made["blocks"] = np.kron(r.integers(0, 2, (6, 7)), np.ones((5, 5))).astype(np.uint8)
    return made


@pytest.mark.parametrize("rx,ry", [(1, 1), (2, 2), (3, 0), (0, 2)])
def test_morphology(spark, scenes, rx, ry):
    runs = spark.createDataFrame([x for n, a in scenes.items() for x in runs_of(a, n)], "image string, y int, x0 int, x1 int")
    sizes = spark.createDataFrame([(n, a.shape[1], a.shape[0]) for n, a in scenes.items()] + [("blank", 9, 9)], "image string, width int, height int")
    grown = {n: spread(a, rx, ry, 0, np.max) for n, a in scenes.items()}
    shrunk = {n: spread(a, rx, ry, 1, np.min) for n, a in scenes.items()}
    for got, want in ((filters.dilated(runs, sizes, rx, ry), grown), (filters.eroded(runs, sizes, rx, ry), shrunk), (filters.opened(runs, sizes, rx, ry), {n: spread(a, rx, ry, 0, np.max) for n, a in shrunk.items()})):
        rows = got.collect()
        for n, a in want.items():
            mine = [r for r in rows if r.image == n]
            assert (drawn(mine, a.shape) == a).all(), n
            assert len(mine) == len(runs_of(a, n))  # whole runs, not pieces of them
    assert filters.opened(runs.limit(0), sizes, rx, ry).collect() == []


def test_adaptive_threshold(spark):
    """A page that darkens to one side: its writing is found where one threshold for all would take the shade."""
    r = np.random.default_rng(6)
    h, w = 40, 60
    page = (220 - np.arange(w)[None, :] * 2 + r.integers(0, 5, (h, w))).astype(int)
    ink = np.zeros((h, w), bool)
    ink[8:30, 10:13] = ink[8:30, 50:53] = ink[20:23, 5:55] = True
    page[ink] -= 60
    rows = [("p", x, y, int(page[y, x])) for y in range(h) for x in range(w)]
    weights = filters.gaussian(11)
    assert abs(sum(weights) - 1) < 1e-12 and weights == weights[::-1]
    wide = np.pad(page.astype(float), 5, mode="edge")
    across = sum(wide[:, k : k + w] * g for k, g in enumerate(weights))
    mean = sum(across[k : k + h] * g for k, g in enumerate(weights))
    df = spark.createDataFrame(rows, "image string, x int, y int, v int").repartition(5)
    got = {(x.x, x.y): x.mean for x in filters.smoothed(df, weights).collect()}
    assert max(abs(got[x, y] - mean[y, x]) for x in range(w) for y in range(h)) < 1e-5
    found = {(x.x, x.y) for x in filters.adaptive_ink(df, 11, 15).collect()}
    assert found == {(x, y) for y in range(h) for x in range(w) if page[y, x] <= round(mean[y, x], 6) - 15}
    assert found <= {(x, y) for y in range(h) for x in range(w) if ink[y, x]} and len(found) > 0.9 * ink.sum()
    nulls = spark.createDataFrame([("n", x, 0, None if x == 2 else 200) for x in range(5)] + [("n", 0, 1, None)], "image string, x int, y int, v int")
    assert filters.adaptive_ink(nulls, 3, 15).collect() == []
    assert filters.adaptive_ink(df.limit(0)).collect() == []


def turned(degrees, w=200, h=100, side=300):
    t = math.radians(degrees)
    y, x = np.mgrid[0:side, 0:side] - side / 2
    return ((np.abs(x * math.cos(t) + y * math.sin(t)) <= w / 2) & (np.abs(-x * math.sin(t) + y * math.cos(t)) <= h / 2)).astype(np.uint8)


def test_skew_of_turned_rectangles(spark):
    made = {d: turned(d) for d in (0, 3, 12, -7, 14, 40, -30, 90)}
    made["few"], made["dots"], made["line"] = np.eye(7, dtype=np.uint8), np.zeros((9, 9), np.uint8), np.ones((1, 80), np.uint8)
    runs = spark.createDataFrame([(str(n), *r[1:]) for n, a in made.items() for r in runs_of(a, n)], "image string, y int, x0 int, x1 int")
    images = spark.createDataFrame([(str(n),) for n in made], "image string")
    got = {r.image: (r.angle, r.failure) for r in skew.skew(images, runs).collect()}
    for d in (3, 12, -7, 14):
        assert abs(got[str(d)][0] - d) < 1 and got[str(d)][1] is None
    assert {got[d][0] for d in ("0", "40", "-30", "90", "line")} == {0.0}
    assert got["few"] == (None, skew.NO_INK) and got["dots"] == (None, skew.NO_INK)


def test_smallest_rectangle_over_all_edges(spark):
    """Against every pair of points whose line has all others on one side."""
    r, made = np.random.default_rng(8), {}
    for i in range(25):
        made[f"i{i}"] = (r.random((9, 12)) < r.choice([0.05, 0.2, 0.6])).astype(np.uint8)
    runs = spark.createDataFrame([x for n, a in made.items() for x in runs_of(a, n)], "image string, y int, x0 int, x1 int")
    corners = skew.hulls(runs)
    hull, got = {}, {x.image: (x.area, x.raw) for x in skew.smallest_rectangles(corners).collect()}
    for c in corners.collect():
        hull.setdefault(c.image, set()).add((c.x, c.y))
    for n, a in made.items():
        points = [(int(x), int(y)) for y, x in zip(*np.nonzero(a))]
        edges = [(p, q) for p in points for q in points if p != q and all((q[0] - p[0]) * (z[1] - p[1]) - (q[1] - p[1]) * (z[0] - p[0]) >= 0 for z in points)]
        if not edges:
            assert len(points) < 2
            continue
        best = []
        for (px, py), (qx, qy) in edges:
            dx, dy = qx - px, qy - py
            along, across = [x * dx + y * dy for x, y in points], [y * dx - x * dy for x, y in points]
            raw = math.degrees(math.atan2(dy, dx)) % 90
            raw = 0.0 if raw > 89.9999999 else raw
            best.append((round((max(along) - min(along)) * (max(across) - min(across)) / (dx * dx + dy * dy), 6), round(abs((raw + 45) % 90 - 45), 6), raw))
        area, _, raw = min(best)
        assert abs(got[n][0] - area) < 1e-5 and abs(got[n][1] - raw) < 1e-5, n
        assert hull[n] <= set(points) and {p for e in edges for p in e} >= hull[n]
