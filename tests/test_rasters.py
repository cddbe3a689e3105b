"""Raster, outline, alignment, source and stream operators against brute force on drawn images."""

import io
import json
import re
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.operators import alignment, components, jobs, outlines, raster, template
from quern.plans import rasters
from quern.sources import images as sources
from quern.streaming import status


def runs_of(a, name="g"):
    p = np.diff(np.pad((a > 0).astype(np.int8), ((0, 0), (1, 1))), axis=1)
    y, x0 = np.nonzero(p == 1)
    x1 = np.nonzero(p == -1)[1]
    return [(name, int(r), int(s), int(e)) for r, s, e in zip(y, x0, x1)]


def table(spark, rows, key="image"):
    return spark.createDataFrame(rows, f"{key} string, y int, x0 int, x1 int")


def disc(a, cx, cy, r, v=255):
    y, x = np.ogrid[: a.shape[0], : a.shape[1]]
    a[(x - cx) ** 2 + (y - cy) ** 2 <= r * r] = v
    return a


def filled(d, side):
    """Even-odd fill of straight path data, sampled at pixel centres."""
    out = np.zeros((side, side), bool)
    for sub in re.findall(r"M ([^MZ]+) Z", d):
        pts = [tuple(map(int, p.split())) for p in sub.split(" L ")]
        for (xa, ya), (xb, yb) in zip(pts, pts[1:] + pts[:1]):
            assert (xa == xb) != (ya == yb)
            if xa == xb:
                out[min(ya, yb) : max(ya, yb), xa:] ^= True
    return out


def brute_components(a):
    label, n = np.zeros(a.shape, int), 0
    for y, x in zip(*np.nonzero(a)):
        if label[y, x]:
            continue
        n += 1
        todo = [(y, x)]
        label[y, x] = n
        while todo:
            r, c = todo.pop()
            for i in range(max(r - 1, 0), min(r + 2, a.shape[0])):
                for j in range(max(c - 1, 0), min(c + 2, a.shape[1])):
                    if a[i, j] and not label[i, j]:
                        label[i, j] = n
                        todo.append((i, j))
    return sorted(int((label == k).sum()) for k in range(1, n + 1))


def test_components_of_random_rasters(spark):
    rng = np.random.default_rng(0)
    pics = {f"r{i}": (rng.random((25, 30)) < q).astype(np.uint8) for i, q in enumerate([0.05, 0.3, 0.45, 0.7])}
    df = table(spark, [r for k, a in pics.items() for r in runs_of(a, k)])
    got = raster.boxes(raster.labelled(df)).collect()
    for k, a in pics.items():
        assert sorted(r.area for r in got if r.image == k) == brute_components(a)
    assert raster.labelled(df.limit(0)).count() == 0


def test_components_operator(spark):
    nodes = spark.createDataFrame([("k", i) for i in range(50)] + [("m", 3)], "k string, n long")
    edges = spark.createDataFrame([("k", i, i + 1) for i in range(30)] + [("k", 40, 45), ("k", 45, 40), ("k", 7, 7), ("k", None, 3), ("m", 3, 3)], "k string, a long, b long")
    got = {(r.k, r.n): r.component for r in components.components(nodes, edges, ["k"], "n").collect()}
    assert got == {("k", i): 0 if i <= 30 else 40 if i == 45 else i for i in range(50)} | {("m", 3): 3}


def test_specks(spark):
    stem = np.zeros((200, 100), np.uint8)
    stem[80:180, 40:60] = 255
    pics = {"both": disc(stem.copy(), 50, 40, 18), "noise": disc(stem.copy(), 50, 40, 14), "two": disc(disc(np.zeros((150, 100), np.uint8), 50, 40, 15), 50, 110, 15), "one": disc(np.zeros((60, 60), np.uint8), 30, 30, 1)}
    kept = raster.without_specks(raster.labelled(table(spark, [r for k, a in pics.items() for r in runs_of(a, k)])))
    got = {r.image: r.n for r in kept.groupBy("image").agg(F.count_distinct("component").alias("n")).collect()}
    assert got == {"both": 2, "noise": 1, "two": 2, "one": 1}


def page(marks, h=400, w=600, size=30):
    a = np.full((h, w), 245, np.uint8)
    for m in marks:
        x, y, *s = m
        s = s[0] if s else size
        a[y : y + s, x : x + s] = 20
    return a


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("photos")
    three_two = [(100, 80), (250, 80), (400, 80), (150, 250), (350, 250)]
    pics = {"three_two": page(three_two), "sizes": page([(100, 80, 20), (400, 80, 60), (250, 250, 40)]), "blank": np.full((100, 100), 245, np.uint8), "border": page([(100, 80), (300, 80), (0, 200)]), "speck": page([(100, 80), (300, 80), (200, 300, 2)]), "dots": page([(100, 80, 20), (100, 103, 40), (400, 100)])}
    for k, a in pics.items():
        (d / f"{k}.png").write_bytes(outlines.png(a))
    (d / "broken.png").write_bytes(b"no image")
    return d


def test_freeform_page(spark, folder):
    photos = sources.photos(spark, str(folder), "*.png")
    assert {r.image for r in photos.filter("height < 0").collect()} == {"broken"}
    assert sources.photos(spark, str(folder), "*.png", True).count() == 6
    sizes = photos.filter("height > 0").select("image", "width", "height")
    runs = raster.image_runs(photos)
    marks = raster.freeform_marks(runs.filter("image <> 'blank'"), sizes)
    got = {}
    for r in marks.orderBy("image", "position").collect():
        got.setdefault(r.image, []).append((r.x, r.y, r.w, r.h))
    assert [b[:2] for b in got["three_two"]] == [(100, 80), (250, 80), (400, 80), (150, 250), (350, 250)]
    assert {k: len(v) for k, v in got.items()} == {"three_two": 5, "sizes": 3, "border": 2, "speck": 2, "dots": 2}
    assert [b[2] for b in got["sizes"]] == [20, 60, 40]
    assert got["dots"][0] == (100, 80, 40, 63)
    crops = raster.crops(runs.filter("image = 'dots'"), marks.filter("image = 'dots'"), sizes)
    ink = {r.position: (r.n, r.width, r.height) for r in crops.groupBy("position").agg(F.sum(F.col("x1") - F.col("x0")).alias("n"), F.first("width").alias("width"), F.first("height").alias("height")).collect()}
    # The 20-pixel dot has a quarter of the square's area and goes; a 3 x 3 median rounds corners off.
    assert ink == {1: (1600 - 4, 60, 83), 2: (900 - 4, 50, 50)}


def test_outlines_fill_the_same_pixels(spark):
    rng = np.random.default_rng(1)
    ring = disc(disc(np.zeros((60, 60), np.uint8), 30, 30, 20), 30, 30, 8, 0)
    pics = {"ring": ring, "disc": disc(np.zeros((60, 60), np.uint8), 30, 30, 15), "dots": np.eye(60, dtype=np.uint8)} | {f"r{i}": (rng.random((60, 60)) < 0.5).astype(np.uint8) for i in range(3)}
    df = table(spark, [r for k, a in pics.items() for r in runs_of(a, k)], "glyph")
    got = {r.glyph: r for r in outlines.outlines(df).collect()}
    for k, a in pics.items():
        assert (filled(got[k].d, 60) == (a > 0)).all(), k
    assert (got["ring"].subpaths, got["disc"].subpaths) == (2, 1)
    assert (got["disc"].x0, got["disc"].x1) == (15, 46)
    back = spark.createDataFrame([(got["ring"].d,)], "d string").select(outlines.svg(F.col("d")).alias("s")).select(outlines.path_data(F.col("s")).alias("d")).select("d", outlines.subpath_points(F.col("d")).alias("p")).first()
    assert back.d == got["ring"].d and len(back.p) == 2
    assert spark.createDataFrame([("<svg/>",)], "s string").select(outlines.path_data(F.col("s"))).first()[0] is None


@pytest.mark.parametrize("w,h,tall,descender", [(30, 90, True, False), (90, 20, False, False), (40, 100, False, True), (3, 3, True, True), (120, 130, True, False)])
def test_normalised(spark, w, h, tall, descender):
    a = np.zeros((140, 160), np.uint8)
    a[5 : 5 + h, 25 : 25 + w] = 255
    kinds = spark.createDataFrame([("g", tall, descender)], "glyph string, tall boolean, descender boolean")
    out = outlines.normalised(table(spark, runs_of(a), "glyph"), kinds)
    m = raster.measures(out.withColumnRenamed("glyph", "image")).first()
    height = (300 if tall else 200) + (90 if descender else 0)
    s = min(height / h, 400 / w)
    assert abs((m.x1 - m.x0) - w * s) <= 1 and abs((m.y1 - m.y0) - h * s) <= 1
    assert abs(m.y1 - (375 + (90 if descender else 0))) <= 1 and abs((m.x0 + m.x1) / 2 - 250) <= 1
    assert m.ink == (m.x1 - m.x0) * (m.y1 - m.y0)


def test_pngs_and_packages(spark, tmp_path):
    a = disc(np.zeros((50, 50), np.uint8), 20, 20, 9)
    png = outlines.glyph_pngs(table(spark, runs_of(a), "glyph"), 50).first().png
    (tmp_path / "g.png").write_bytes(bytes(png))
    photo = sources.photos(spark, str(tmp_path), "g.png").first()
    assert (np.frombuffer(photo.data, np.uint8).reshape(50, 50) == a).all()
    members = spark.createDataFrame([("j", "b.svg", b"2"), ("j", "a.svg", b"1"), ("k", "README.txt", b"")], "job_id string, name string, content binary")
    zips = {r.job_id: zipfile.ZipFile(io.BytesIO(r.zip)) for r in outlines.packages(members).collect()}
    assert zips["j"].namelist() == ["a.svg", "b.svg"] and zips["j"].read("b.svg") == b"2" and zips["k"].namelist() == ["README.txt"]


def test_homography(spark):
    rng = np.random.default_rng(2)
    h = np.array([[1.1, 0.05, 12], [-0.02, 0.95, 7], [1e-5, 2e-5, 1]])
    rows = []
    for name, far in (("clean", []), ("one off", [2]), ("bad", None)):
        # Nine markers: with four, a bent projection passes within five pixels of a misread one.
        for m in range(9):
            for c in range(4):
                x, y = (m % 3) * 400.0 + (c % 2) * 40, (m // 3) * 500.0 + (c // 2) * 40
                # A marker read with its corners in another order: some 40 to 60 pixels off each.
                k = (c + 1) % 4 if far and m in far else c
                u, v, w = h @ [x + (k % 2 - c % 2) * 40, y + (k // 2 - c // 2) * 40, 1]
                u, v = u / w, v / w
                if far is None:
                    u, v = rng.random(2) * 1000
                rows.append((name, m, c, x, y, float(u), float(v)))
    rows += [("few", 0, c, float(c), 0.0, 1.0, 1.0) for c in range(3)]
    points = spark.createDataFrame(rows, "image string, marker_id int, corner int, x double, y double, u double, v double")
    fits = alignment.homographies(points)
    got = {r.image: r for r in fits.collect()}
    assert np.allclose(np.array(got["clean"].h).reshape(3, 3), h, atol=1e-6) and np.allclose(np.array(got["one off"].h).reshape(3, 3), h, atol=1e-6)
    assert got["one off"].n_inliers == 32 and got["one off"].error < 1e-6 and got["bad"].error > 8 and "few" not in got
    pages = points.selectExpr("image", "1 as page").distinct()
    done = {r.image: r.failure for r in alignment.aligned(points, pages, pages, fits, 9).collect()}
    assert done == {"clean": None, "one off": None, "bad": "low confidence", "few": "too few markers"}
    seen = spark.createDataFrame([("p", 5, 0), ("p", 6, 1), ("p", 1, 2), ("q", 9, 0), ("q", 1, 1)], "image string, marker_id int, seq int")
    assert {r.image: r.page for r in alignment.pages_of(seen).collect()} == {"p": 2, "q": 3}


def test_only_markers_of_the_voted_page_count(spark):
    """Misread ids of another page neither help nor harm; too few of its own, or a page that the template lacks, fails."""
    expected = [(m, c, 300.0 * (m % 2) + 20 * (c in (1, 2)), 400.0 * (m % 4 // 2) + 20 * (c > 1)) for m in range(8) for c in range(4)]
    # image: the markers that are there (place, id as read).
    photos = {"all": [(0, 0), (1, 1), (2, 2), (3, 3)], "three": [(0, 0), (1, 1), (2, 2), (3, 5), (3, 6)], "two": [(0, 0), (1, 1), (2, 6)], "twice": [(0, 0), (0, 0), (1, 1)], "beyond": [(0, 8), (1, 9), (2, 10), (3, 11)], "second": [(0, 4), (1, 5), (2, 6), (3, 3)]}
    place = {(m, c): (u, v) for m, c, u, v in expected}
    seen = [(name, m, c, seq, place[p, c][0] + 7, place[p, c][1] * 1.5) for name, ms in photos.items() for seq, (p, m) in enumerate(ms) for c in range(4)]
    detected = spark.createDataFrame(seen, "image string, marker_id int, corner int, seq int, x double, y double")
    wanted = spark.createDataFrame(expected, "marker_id int, corner int, u double, v double")
    images = spark.createDataFrame([(n,) for n in [*photos, "none"]], "image string")
    known, pages = spark.createDataFrame([(1,), (2,)], "page int"), alignment.pages_of(detected)
    fits = alignment.homographies(alignment.point_pairs(detected, wanted, pages))
    got = {r.image: (r.page, r.markers, r.confidence, r.failure) for r in alignment.aligned(images, pages, known, fits, 4).collect()}
    assert got == {
        "all": (1, 4, 1.0, None), "three": (1, 3, 0.75, None), "two": (1, 2, 0.5, "too few markers"), "twice": (1, 2, 0.5, "too few markers"),
        "beyond": (3, 0, 0.0, "page 3 is not part of the template"), "second": (2, 3, 0.75, None), "none": (None, 0, 0.0, "no markers"),
    }


def test_records_and_templates(spark, tmp_path):
    boxes = template.elements(template.characters(spark))
    assert {r.page: r["count"] for r in boxes.groupBy("page").count().collect()} == {1: 56, 2: 20}
    doc = template.document(boxes, template.markers(boxes), "t", "1.0")
    (tmp_path / "t.json").write_text(json.dumps(json.loads(doc.toJSON().first()), indent=1))
    (tmp_path / "bad.json").write_text("{not json")
    back = sources.templates(spark, str(tmp_path / "*.json"))
    assert back.count() == 1 and sources.template_elements(back).count() == 76 and sources.template_markers(back).count() == 8
    assert sources.template_elements(back).filter("id = 'uppercase_A'").select("x", "y").first() == (80.0, 655.89)
    assert sources.records(spark, str(tmp_path / "none"), sources.STATUS).count() == 0
    (tmp_path / "v").mkdir()
    (tmp_path / "v" / "v.json").write_text('[{"character_id":"a","valid":true,"confidence":1.0,"warnings":[]},{"character_id":"b","valid":false}]')
    (tmp_path / "v" / "page_1.png").write_bytes(b"123")
    assert sources.records(spark, str(tmp_path / "v" / "v.json"), sources.VALIDATION).count() == 2
    assert sources.uploads(spark, str(tmp_path / "v")).select("name", "n_bytes").first() == ("page_1.png", 3)


def test_rewrites(spark):
    old = spark.createDataFrame([("j", "a", 1, 0.5), ("j", "b", 1, 0.9)], "job_id string, character_id string, version int, extraction_confidence double")
    new = spark.createDataFrame([("j", "a", 2, 1.0)], old.schema)
    assert sorted(jobs.rewritten(old, new, "version").collect()) == [("j", "a", 2, 1.0), ("j", "b", 1, 0.9)]
    specs = template.characters(spark)
    asked = spark.createDataFrame([("j", "uppercase_A"), ("j", "nonsense"), ("j", None)], "job_id string, character_id string")
    assert {r.character_id for r in jobs.unknown_ids(asked, specs).collect()} == {"nonsense", None}


def test_streams(spark, tmp_path):
    src = str(tmp_path / "in")
    rows = [("j", "created", "2024-01-01 00:10:00", 1), ("j", "processing", "2024-01-01 01:10:00", 3), ("j", "uploading", "2024-01-01 00:50:00", 2), ("k", "created", "2024-01-01 00:20:00", 4)]
    df = spark.createDataFrame(rows, "job string, state string, ts string, seq int").withColumn("ts", F.to_timestamp("ts"))
    df.repartition(2).write.parquet(src)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(src)
    q = status.latest_states(stream, "job", "state", "ts", "seq").writeStream.format("memory").queryName("states").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c1")).start()
    q.awaitTermination(120)
    assert sorted((r.job, r.state, r.seq) for r in spark.table("states").collect()) == [("j", "processing", 3), ("k", "created", 4)]
    q = status.append_events(stream, str(tmp_path / "out"), str(tmp_path / "c2"))
    q.awaitTermination(120)
    assert spark.read.json(str(tmp_path / "out")).count() == 4
    assert {(str(r.start), r.state): r.n for r in status.event_counts(df, "ts", "state").collect()}[("2024-01-01 00:00:00", "created")] == 2


def test_samples_of_a_page_are_no_rows(spark):
    """Each page is one row while its samples are solved: nothing is multiplied by their number, sorted or shuffled."""
    rows = [(i, m, c, 100.0 * m + c, 50.0 * c * m + m, 100.0 * m + c + 3, 50.0 * c * m + m - 1) for i in range(3) for m in range(4) for c in range(4)]
    fits = alignment.homographies(spark.createDataFrame(rows, "image int, marker_id int, corner int, x double, y double, u double, v double"))
    plan = fits._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Generate explode" not in plan and "Join" not in plan
    assert {r.image: (r.n_points, r.n_inliers) for r in fits.collect()} == {i: (16, 16) for i in range(3)}


def test_first_samples_settle_a_page(monkeypatch):
    """A sample that all points agree with needs no others; else the first of those with the most inliers wins, as one by one."""
    rng, solved = np.random.default_rng(4), []
    real = alignment._solved
    monkeypatch.setattr(alignment, "_solved", lambda p: solved.append(len(p)) or real(p))
    for far in (0, 3):
        points = rng.random((16, 4)) * 500
        points[:, 2:] = points[:, :2] * [1.1, 0.9] + [7, 3]
        points[:far, 2] += 80
        samples = np.array([rng.permutation(16)[:4] for _ in range(200)])
        solved.clear()
        got = alignment._consensus(points, samples)
        assert sum(solved) <= 9 if not far else sum(solved) > 100
        good = [alignment._inliers(h, points)[0] if (h := real(alignment._sorted(points[s][None]))) is not None else None for s in samples]
        first = max(range(200), key=lambda i: (good[i].sum(), -i))
        assert got == alignment._solve(alignment._sorted(points[good[first]][None])[0]) and good[first].sum() == 16 - far


def test_first_samples_of_many_pages_are_solved_together(monkeypatch):
    """Pages are settled by a few calls for all of them, with what each gets alone; one with a point far off, or without points, isn't fitted here."""
    rng, calls = np.random.default_rng(5), []
    real = alignment._solved
    monkeypatch.setattr(alignment, "_solved", lambda p: calls.append(len(p)) or real(p))
    pages = [rng.random((4 + i % 5, 4)) * 500 for i in range(200)]
    for i, p in enumerate(pages):
        p[:, 2:] = p[:, :2] * [1.1, 0.9] + [7, 3]
        p[0, 2] += 80 * (i % 20 == 14)
        p[0 if i % 20 == 8 else slice(len(p)), 1] *= np.nan if i % 20 in (8, 19) else 1
    samples = np.array([[rng.permutation(len(p))[:4] for _ in range(200)] for p in pages])
    done, fits = alignment._settled(np.concatenate(pages), np.array([len(p) for p in pages]), samples[:, : alignment.FIRST])
    assert len(calls) <= alignment.FIRST + 5
    assert done[[i for i in range(200) if i % 20 not in (8, 14)]].all() and done[8::20].any() and not done[14::20].any()
    assert (np.isnan(fits[:, 0]) == (~done | (np.arange(200) % 20 == 19))).all()
    for p, s, f in zip(pages, samples, fits):
        if not np.isnan(f[0]):
            np.testing.assert_allclose(f, alignment._consensus(p, s), rtol=1e-9)


def test_a_page_is_searched_no_further_than_needed(monkeypatch):
    """Where the first samples determine nothing, the next few are tried before all others."""
    rng, solved = np.random.default_rng(6), []
    real = alignment._solved
    monkeypatch.setattr(alignment, "_solved", lambda p: solved.append(len(p)) or real(p))
    points = rng.random((16, 4)) * 500
    points[:4, 1] = points[:4, 0]  # on a line
    points[:, 2:] = points[:, :2] * [1.1, 0.9] + [7, 3]
    samples = np.array([[0, 1, 2, 3]] * alignment.FIRST + [rng.permutation(16)[:4] for _ in range(192)])
    assert alignment._consensus(points, samples) == alignment._solve(alignment._sorted(points[None])[0]) and sum(solved) < 20


def test_pages_of_many_blocks(spark, monkeypatch):
    """Pages keep their own points when they are solved in blocks, settled or not, also those that samples settle late."""
    monkeypatch.setattr(alignment, "BLOCK", 7)
    far = lambda i, m, c: 80.0 * (i % 3 == 0 and (m, c) == (1, 2))
    rows = [(i, m, c, 40.0 * m + 7 * c * c + i % 11, 30.0 * (m * c % 5) + 11 * c, 40.0 * m + 7 * c * c + i % 11 + i + far(i, m, c), 30.0 * (m * c % 5) + 11 * c - 2 * i) for i in range(60) for m in range(1 + i % 4) for c in range(4)]
    fits = alignment.homographies(spark.createDataFrame(rows, "image int, marker_id int, corner int, x double, y double, u double, v double").coalesce(1))
    got = {r.image: r for r in fits.collect()}
    for i in range(60):
        if i % 4:
            wrong = i % 3 == 0
            assert (got[i].n_points, got[i].n_markers, got[i].n_inliers) == (4 + 4 * (i % 4), 1 + i % 4, 4 + 4 * (i % 4) - wrong) and got[i].error < 1e-6
            np.testing.assert_allclose(got[i].h, [1, 0, i, 0, 1, -2 * i, 0, 0, 1], atol=1e-6)


def test_outcomes_are_one_aggregation(spark, tmp_path):
    """Pages and their glyphs come from one table without a join; missing keys are a group like any other."""
    lines = spark.createDataFrame([(1, 2), (1, 2), (1, 5), (None, 2), (None, 2)], "l_suppkey long, l_partkey long")
    lines.write.parquet(str(tmp_path / "lineitem.parquet"))
    got = rasters.queries()["job_page_outcomes"](spark, str(tmp_path))
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()
    found = {(r.job_id, r.source_image): (r.succeeded, r.error, r.glyphs_extracted) for r in got.collect()}
    assert found == {(1, 2): (True, None, 2), (1, 5): (False, "page not found", 0), (None, 2): (True, None, 2)}
