"""Photos of turned pages through the whole of preprocessing, stored crops read back, and counts while writing."""

import math

import numpy as np
from pyspark.sql import functions as F

from quern.operators import flow, outlines, preprocess, raster, template
from quern.sources import file_table, images
from tests.test_flow import letter, runs_of


def test_median_in_strips(monkeypatch):
    r = np.random.default_rng(2)
    for shape in ((1, 1), (3, 50), (70, 41)):
        g = r.integers(0, 256, shape, dtype=np.uint8)
        p = np.pad(g, 1, mode="edge")
        want = np.median(np.stack([p[i : i + shape[0], j : j + shape[1]] for i in range(3) for j in range(3)]), axis=0).astype(np.uint8)
        for strip in (256, 7, 1):
            monkeypatch.setattr(raster, "STRIP", strip)
            assert (raster._gray({"data": g.tobytes(), "height": shape[0], "width": shape[1], "channels": 1}) == want).all()


def photo(lean, h=600, w=800, size=(500, 300), text=0.0):
    """White paper on dark noise, turned by lean degrees; its three lines of writing are turned by text degrees more."""
    y, x = np.mgrid[0:h, 0:w].astype(float)
    a = np.random.default_rng(0).integers(0, 60, (h, w)).astype(np.uint8)
    turn = lambda t: ((x - w / 2) * math.cos(t) + (y - h / 2) * math.sin(t), -(x - w / 2) * math.sin(t) + (y - h / 2) * math.cos(t))
    u, v = turn(math.radians(lean))
    a[(abs(u) <= size[0] / 2) & (abs(v) <= size[1] / 2)] = 245
    u, v = turn(math.radians(lean + text))
    for at in (-60, 0, 60):
        a[(abs(u) <= 160) & (abs(v - at) <= 5)] = 15
    return a


def test_photos_become_upright_pages(spark):
    flat = np.full((300, 500), 250, np.uint8)
    flat[100:110, 50:400] = flat[200:210, 50:400] = 10
    drawn = {"turned": photo(7), "leaning": photo(-5, text=4), "flat": flat, "noise": np.random.default_rng(1).integers(0, 80, (300, 300)).astype(np.uint8), "blank": np.full((300, 400), 250, np.uint8)}
    rows = [(n, *a.shape, 1, a.tobytes()) for n, a in drawn.items()] + [("unreadable", -1, -1, -1, b"")]
    df = spark.createDataFrame(rows, "image string, height int, width int, channels int, data binary")
    done = preprocess.preprocessed(df, (500, 300))
    pages = {r.image: r for r in done.pages.collect()}
    assert {n: (r.detected, r.failure) for n, r in pages.items() if n != "blank"} == {"turned": (True, None), "leaning": (True, None), "flat": (False, None), "noise": (False, "page not found"), "unreadable": (False, "page not found")}
    assert abs(pages["turned"].angle) < 1 and abs(pages["leaning"].angle - 4) < 1.2 and pages["flat"].angle == 0
    ink = {}
    for r in done.runs.collect():
        ink.setdefault(r.image, np.zeros((300, 500), bool))[r.y, r.x0 : r.x1] = True
    assert "noise" not in ink and (ink["flat"] != (flat < 100)).sum() <= 8  # the median rounds corners
    for n in ("turned", "leaning"):  # three straight level lines where they were drawn
        inner = ink[n][20:280, 60:440]
        rows = np.flatnonzero(inner[:, 100:280].all(axis=1)) + 20
        starts = rows[np.diff(rows, prepend=-9) > 1]
        assert len(starts) == 3 and all(abs(s - want) < 5 for s, want in zip(starts, (85, 145, 205))) and inner.sum() < 3 * 14 * 340
    job = spark.createDataFrame([(1, n) for n in pages], "job_id long, image string")
    events = flow.preprocessing_events(job, done.pages)
    assert {r.event for r in events.collect()} == {"PAGE_PREPROCESSED"} and events.count() == sum(r.failure is None for r in pages.values())


def test_jobs_from_stored_crops(spark, tmp_path):
    """Crops written as files come back as the job that they were; sources can be told; a rewrite goes on from there."""
    a = np.zeros((300, 400), np.uint8)
    a[60:120, 60:120] |= letter()
    a[60:120, 220:280] |= letter()
    specs = template.characters(spark)
    page = spark.createDataFrame([(7, "re", 400, 300)], "job_id long, image string, width int, height int")
    done = flow.plain_jobs(page, spark.createDataFrame(runs_of(a, "re"), "image string, y int, x0 int, x1 int"), spark.createDataFrame([("re", 1, "uppercase_L"), ("re", 2, "lowercase_c")], "image string, position int, character_id string"), specs)
    [total] = done.jobs.collect()
    assert done.totals == {"pages": 1, "failed_pages": 0, "valid": total.valid, "invalid": total.invalid} and total.valid == 2
    from quern.operators import delivery

    extra = spark.createDataFrame([("7", "notes.png", outlines.png(np.zeros((3, 3), np.uint8))), ("7", "metadata.json", b"{}")], "job_id string, name string, content binary")
    file_table.write_files(delivery.glyph_files(done).withColumn("job_id", F.col("job_id").cast("string")).unionByName(extra), str(tmp_path / "jobs"))
    crops = images.stored_crops(spark, str(tmp_path / "jobs")).withColumn("job_id", F.col("job_id").cast("long"))
    told = spark.createDataFrame([(7, "lowercase_c", "page_9")], "job_id long, character_id string, source string")
    back = flow.from_files(crops, specs, done.pages, told)
    assert {r.character_id: r.image for r in back.glyphs.collect()} == {"uppercase_L": "existing", "lowercase_c": "page_9"}
    key = lambda df: sorted((r.character_id, r.y, r.x0, r.x1) for r in df.collect())
    assert key(back.runs.join(back.glyphs.select("glyph", "character_id"), "glyph")) == key(done.runs.join(done.glyphs.select("glyph", "character_id"), "glyph"))
    assert sorted(map(str, back.validations.collect())) == sorted(map(str, done.validations.collect())) and sorted(back.jobs.collect()) == sorted(done.jobs.collect())
    both = flow.rewritten(back, done)
    assert {r.character_id: r.image for r in both.glyphs.collect()} == {"uppercase_L": "re", "lowercase_c": "re"} and both.jobs.first().valid == 2
