"""Validation, extraction, uploads, packages and whole jobs on drawn pages."""

import io
import json
import re
import zipfile

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from quern.functions import geometry, text
from quern.operators import delivery, extraction, flow, jobs, outlines, packaging, raster, template, uploads, validation
from quern.plans import flows
from quern.sources import file_table
from quern.sources import images as sources
from quern.streaming import status


def runs_of(a, name):
    p = np.diff(np.pad((a > 0).astype(np.int8), ((0, 0), (1, 1))), axis=1)
    y, x0 = np.nonzero(p == 1)
    return [(name, int(r), int(s), int(e)) for r, s, e in zip(y, x0, np.nonzero(p == -1)[1])]


def disc(a, cx, cy, r):
    y, x = np.ogrid[: a.shape[0], : a.shape[1]]
    a[(x - cx) ** 2 + (y - cy) ** 2 <= r * r] = 255
    return a


def letter(h=60, w=60):
    a = np.zeros((h, w), np.uint8)
    a[12:48, 18:23] = a[43:48, 18:44] = 255
    return a


def test_validation_of_drawn_crops(spark):
    noise = (np.random.default_rng(0).random((60, 60)) < 0.85) * 255
    edge = np.zeros((60, 60), np.uint8)
    edge[20:40, 0:20] = 255
    two = disc(disc(np.zeros((60, 60), np.uint8), 30, 18, 7), 30, 42, 7)
    drawn = {"clean": ("L", letter()), "blank": ("A", np.zeros((60, 60))), "sparse": ("A", disc(np.zeros((60, 60), np.uint8), 30, 30, 1)), "noisy": ("A", noise), "edge": ("A", edge), "colon": (":", two), "wrong": ("A", two), "gone": ("A", letter())}
    crops = spark.createDataFrame([(n, c, 60, 60, "can't be read" if n == "gone" else None) for n, (c, _) in drawn.items()], "glyph string, character string, width int, height int, error string")
    runs = spark.createDataFrame([r for n, (_, a) in drawn.items() for r in runs_of(a, n)], "glyph string, y int, x0 int, x1 int")
    got = {r.glyph: r for r in validation.validated(crops, runs).collect()}
    assert got["clean"].valid and got["clean"].confidence > 0.9 and got["clean"].warnings == []
    assert not got["blank"].valid and got["blank"].confidence == 0 and any("Empty glyph" in w for w in got["blank"].warnings)
    assert "Insufficient foreground pixels" in got["sparse"].warnings and "Excessive noise" in got["noisy"].warnings
    assert not got["edge"].valid and 0 < got["edge"].confidence < 1 and any("boundary" in w for w in got["edge"].warnings)
    assert got["colon"].valid and not got["wrong"].valid
    assert (got["gone"].valid, got["gone"].confidence, got["gone"].warnings) == (False, 0.0, ["Validation failed unexpectedly: can't be read"])
    assert validation.validated(crops.limit(0), runs).count() == 0
    assert {r.valid for r in validation.validated(crops, runs.limit(0)).collect()} == {False}


DPI = 100.0


def template_page(spark, written, page=1):
    """Runs of a page of the template with a letter in the boxes of written, and the elements."""
    elements = template.elements(template.characters(spark))
    a = np.zeros((1170, 827), np.uint8)
    for e in elements.filter(F.col("page") == page).collect():
        if e.id in written:
            x, y = int(e.x * DPI / 72) + 10, int((template.PAGE_HEIGHT - e.y - e.height) * DPI / 72) + 12
            a[y : y + 60, x : x + 40] |= letter()[:60, 10:50]
    return a, elements


def corner_table(spark):
    expected = []
    for m in template.markers(template.elements(template.characters(spark))).collect():
        for i, (dx, dy) in enumerate(((0, 0), (1, 0), (1, 1), (0, 1))):
            expected.append((m.marker_id, i, (m.x + dx * m.size) * DPI / 72, (template.PAGE_HEIGHT - m.y - m.size + dy * m.size) * DPI / 72))
    return expected


def test_template_job_from_photo_to_results(spark, tmp_path):
    """Job 1: a good page twice and a page without markers; job 2: only a blank page, seen through a shifted camera."""
    first, elements = template_page(spark, {"uppercase_A", "uppercase_L", "lowercase_c"})
    expected = corner_table(spark)
    rows, seen = [], []
    for image, shift, a in (("p1", 0, first), ("p1b", 0, first), ("p3", 30, np.zeros_like(first))):
        rows += [(image, y, x0 + shift, x1 + shift) for _, y, x0, x1 in runs_of(a, image)]
        seen += [(image, m, c, i, u + shift, v) for i, (m, c, u, v) in enumerate(expected) if m < 4]
    images = spark.createDataFrame([(1, "p1", 827, 1170), (1, "p1b", 827, 1170), (1, "p2", 827, 1170), (2, "p3", 900, 1170)], "job_id long, image string, width int, height int")
    runs = spark.createDataFrame(rows, "image string, y int, x0 int, x1 int")
    detected = spark.createDataFrame(seen, "image string, marker_id int, corner int, seq int, x double, y double")
    out = flow.template_jobs(images, runs, detected, spark.createDataFrame(expected, "marker_id int, corner int, u double, v double"), elements, DPI)
    pages = {r.source_image: r for r in out.pages.collect()}
    assert pages["p1"].succeeded and pages["p1"].glyphs_extracted == 56 and pages["p3"].succeeded
    assert not pages["p2"].succeeded and pages["p2"].error == "no markers"
    valid = {(r.job_id, r.character_id) for r in out.validations.collect() if r.valid}
    assert valid == {(1, "uppercase_A"), (1, "uppercase_L"), (1, "lowercase_c")}
    assert out.validations.count() == 112 and out.glyphs.filter("job_id = 1").count() == 56
    results = {r.job_id: r for r in out.jobs.collect()}
    assert (results[1].state, results[1].failed_pages, results[1].valid, results[1].invalid) == ("completed", 1, 3, 53)
    assert (results[2].state, results[2].error) == ("failed", "no valid glyphs")
    events = {(r.job_id, r.event): r.n for r in out.events.groupBy("job_id", "event").agg(F.count("*").alias("n")).collect()}
    assert events == {(1, "PAGE_ALIGNED"): 2, (2, "PAGE_ALIGNED"): 1, (1, "GLYPHS_EXTRACTED"): 2, (2, "GLYPHS_EXTRACTED"): 1, (1, "PAGE_FAILED"): 1, (1, "DUPLICATE_GLYPH_DISCARDED"): 56, (1, "VALIDATION_COMPLETED"): 1, (2, "VALIDATION_COMPLETED"): 1, (1, "JOB_COMPLETED"): 1, (2, "JOB_FAILED"): 1, (1, "JOB_CREATED"): 1, (2, "JOB_CREATED"): 1}
    # Left out by hand, then nothing else changes.
    less = flow.without(out, spark.createDataFrame([(1, "uppercase_A")], "job_id long, character_id string"))
    a = less.validations.filter("character_id = 'uppercase_A' and job_id = 1").first()
    assert not a.valid and a.warnings == ["Manually excluded"] and less.jobs.filter("job_id = 1").first().valid == 2
    # A plain page with clearer writing takes the place of two characters, one of them invalid before.
    page = np.zeros((300, 400), np.uint8)
    page[60:120, 60:120] |= letter()
    page[60:120, 220:280] |= letter()
    again = flow.plain_jobs(spark.createDataFrame([(1, "re", 400, 300)], "job_id long, image string, width int, height int"), spark.createDataFrame(runs_of(page, "re"), "image string, y int, x0 int, x1 int"), spark.createDataFrame([("re", 1, "uppercase_B"), ("re", 2, "uppercase_A")], "image string, position int, character_id string"), template.characters(spark))
    both = flow.rewritten(out, again)
    assert {(r.job_id, r.character_id) for r in both.validations.collect() if r.valid} == valid | {(1, "uppercase_B")}
    assert both.jobs.filter("job_id = 1").first().valid == 4 and both.events.filter("event = 'REWRITE_STARTED'").count() == 1
    assert [json.loads(r.fields) for r in both.events.filter("event = 'REWRITE_EXTRACTED'").collect()] == [{"characters": 2}] and both.events.filter("event = 'REWRITE_FAILED'").count() == 0
    # A photo with too few marks fails: the job stays as it was.
    short = flow.plain_jobs(spark.createDataFrame([(1, "re2", 400, 300)], "job_id long, image string, width int, height int"), spark.createDataFrame(runs_of(page, "re2"), "image string, y int, x0 int, x1 int"), spark.createDataFrame([("re2", i, c) for i, c in enumerate(("uppercase_B", "uppercase_A", "uppercase_C"), 1)], "image string, position int, character_id string"), template.characters(spark))
    same = flow.rewritten(out, short)
    assert {(r.job_id, r.character_id) for r in same.validations.collect() if r.valid} == valid and sorted(same.jobs.collect()) == sorted(out.jobs.collect())
    assert [json.loads(r.fields) for r in same.events.filter("event = 'REWRITE_FAILED'").collect()] == [{"reason": "found 2 characters, expected 3"}]
    # The tail: drawings, archives and packages of the completed job; the files come back from their folder as they were.
    made = delivery.delivered(both, template.characters(spark), names_of(spark, [1, 2]), fonts_of(spark, [1, 2]))
    assert {(r.job_id, r.state) for r in made.jobs.collect()} == {(1, "completed"), (2, "failed")}
    assert {(r.job_id, r.character_id) for r in made.svgs.collect()} == valid | {(1, "uppercase_B")} and made.svgs.filter("svg like '%M %Z%'").count() == 4
    assert {(r.job_id, r.event) for r in made.events.collect() if r.job_id == 1} >= {(1, e) for e in ("VALIDATION_COMPLETED", "FONT_GENERATED", "PREVIEW_GENERATED", "PACKAGE_CREATED", "JOB_COMPLETED")}
    file_table.write_files(made.files.unionByName(delivery.glyph_files(both)), str(tmp_path / "files"))
    back = {(r.job_id, r.name): bytes(r.content) for r in file_table.read_files(spark, str(tmp_path / "files")).collect()}
    assert {n for j, n in back if n.endswith(".svg")} == {"uppercase_A.svg", "uppercase_B.svg", "uppercase_L.svg", "lowercase_c.svg"} and {j for j, n in back if not n.endswith(".png")} == {"1"}
    with zipfile.ZipFile(io.BytesIO(back["1", "package.zip"])) as z:
        assert z.namelist() == ["MyHand-Regular.otf", "MyHand-Regular.ttf", "README.txt", "glyphs.zip", "metadata.json", "preview.pdf", "preview.png"]
        said = json.loads(z.read("metadata.json"))
        assert said["creator"] == "someone" and said["generated_at"] == "2024-01-01T00:00:00+00:00" and said["glyph_count"] == 4 and "MyHand-Regular.ttf" in z.read("README.txt").decode()
        with zipfile.ZipFile(io.BytesIO(z.read("glyphs.zip"))) as inner:
            assert inner.read("uppercase_A.svg") == back["1", "uppercase_A.svg"]


def names_of(spark, ids):
    rows = [(i, "My Hand", "Regular", "1.0", "t", "someone", "a hand", "2024-01-01T00:00:00+00:00") for i in ids]
    return spark.createDataFrame(rows, "job_id long, family_name string, style_name string, version string, template_id string, creator string, description string, generated_at string")


def fonts_of(spark, ids, kinds=("ttf", "otf", "png", "pdf")):
    return spark.createDataFrame([(i, k, k.encode()) for i in ids for k in kinds], "job_id long, kind string, content binary")


def test_deliveries_that_fail(spark):
    """A job without a preview, one without names and one whose valid glyph has no ink fail alone."""
    glyphs = [(f"{j}/{c}", j, f"p{j}", c[-1], c, 20, 20, 1.0, 1) for j in (1, 2, 3, 4) for c in ("uppercase_A", "lowercase_p")]
    runs = [(g[0], y, 5, 15) for g in glyphs for y in range(5, 15) if g[0] != "3/lowercase_p"]
    verdicts = [(g[1], g[4], g[3], True, 1.0, []) for g in glyphs]
    done = flow.Result(
        spark.createDataFrame(glyphs, "glyph string, job_id long, image string, character string, character_id string, width int, height int, extraction_confidence double, seq long"),
        spark.createDataFrame(runs, "glyph string, y int, x0 int, x1 int"),
        spark.createDataFrame([], "job_id long, source_image string, succeeded boolean, error string, glyphs_extracted long"),
        spark.createDataFrame(verdicts, "job_id long, character_id string, character string, valid boolean, confidence double, warnings array<string>"),
        spark.createDataFrame([(j, "completed", 1, 0, 2, 0, None) for j in (1, 2, 3, 4)], "job_id long, state string, pages long, failed_pages long, valid long, invalid long, error string"),
        spark.createDataFrame([(j, "JOB_COMPLETED", "{}") for j in (1, 2, 3, 4)], "job_id long, event string, fields string"),
    )
    fonts = fonts_of(spark, [1, 3, 4]).unionByName(fonts_of(spark, [2], ("ttf", "otf", "pdf")))
    made = delivery.delivered(done, template.characters(spark), names_of(spark, [1, 2, 3]), fonts)
    assert {r.job_id: (r.state, r.error) for r in made.jobs.collect()} == {1: ("completed", None), 2: ("failed", "missing: png"), 3: ("failed", "no contours of lowercase_p"), 4: ("failed", "no names")}
    assert {r.job_id for r in made.packages.collect()} == {1} == {r.job_id for r in made.files.collect()}
    assert {(r.job_id, r.event) for r in made.events.collect()} == {(1, "FONT_GENERATED"), (2, "FONT_GENERATED"), (1, "PREVIEW_GENERATED"), (1, "PACKAGE_CREATED"), (1, "JOB_COMPLETED"), (2, "JOB_FAILED"), (3, "JOB_FAILED"), (4, "JOB_FAILED")}


def test_plain_jobs(spark):
    """A page of 76 marks is completed, one of 75 fails, and so do a blank page and an unknown id."""
    specs = template.characters(spark)
    ids = [r.character_id for r in specs.orderBy("ord").collect()]

    def grid(n):
        a = np.zeros((700, 520), np.uint8)
        for i in range(n):
            a[30 + i // 8 * 65 : 61 + i // 8 * 65, 25 + i % 8 * 60 : 56 + i % 8 * 60] = 255
        return a

    drawn = {"full": grid(76), "short": grid(75), "blank": grid(0), "odd": grid(2)}
    names = [("full", i + 1, c) for i, c in enumerate(ids)] + [("short", i + 1, c) for i, c in enumerate(ids)] + [("blank", 1, "uppercase_A"), ("odd", 1, "uppercase_A"), ("odd", 2, "nonsense")]
    images = spark.createDataFrame([(i, n, 520, 700) for i, n in enumerate(drawn)], "job_id long, image string, width int, height int")
    runs = spark.createDataFrame([r for n, a in drawn.items() for r in runs_of(a, n)], "image string, y int, x0 int, x1 int")
    out = flow.plain_jobs(images, runs, spark.createDataFrame(names, "image string, position int, character_id string"), specs)
    pages = {r.source_image: r.error for r in out.pages.collect()}
    assert pages == {"full": None, "short": "found 75 characters, expected 76", "blank": "no handwriting found", "odd": "not in the character set: nonsense"}
    assert {r.job_id: r.state for r in out.jobs.collect()} == {0: "completed", 1: "failed", 2: "failed", 3: "failed"}
    assert {r.character_id for r in out.glyphs.collect()} == set(ids)
    assert {r.job_id: r.error for r in out.jobs.collect()}[1] == "no pages processed"


def test_windows_through_a_homography(spark):
    h = np.array([[0.9, 0.05, 12.0], [-0.03, 1.1, 7.0], [1e-5, 2e-5, 1.0]])  # photo to template
    elements = spark.createDataFrame([(1, "A", "uppercase_A", 50.0, 600.0, 52.0, 62.0), (1, "B", "uppercase_B", 5000.0, 600.0, 52.0, 62.0)], "page int, character string, id string, x double, y double, width double, height double")
    pages = spark.createDataFrame([("i", 1, 900, 900, h.ravel().tolist())], "image string, page int, width int, height int, h array<double>")
    got = {r.character_id: r for r in extraction.windows(pages, elements, 800.0, 72.0, 5).collect()}
    corners = np.array([[50, 138, 1], [102, 138, 1], [102, 200, 1], [50, 200, 1]], float) @ np.linalg.inv(h).T
    xy = corners[:, :2] / corners[:, 2:]
    lo, hi = np.rint(xy.min(0)) - 5, np.rint(xy.max(0)) + 5
    a = got["uppercase_A"]
    assert np.allclose([a.x, a.y, a.x + a.width, a.y + a.height], [*lo, *hi], atol=1) and a.error is None
    assert got["uppercase_B"].error == "window of uppercase_B is outside the page" and got["uppercase_B"].width == 0
    assert [r.image for r in extraction.page_failures(extraction.windows(pages, elements, 800.0, 72.0)).collect()] == ["i"]


def test_completeness(spark):
    specs = template.characters(spark)
    rows = spark.createDataFrame([("uppercase_A", 1), ("nonsense", 2)], "character_id string, seq int")
    assert extraction.with_specs(rows.limit(1), specs).first().character == "A"
    with pytest.raises(PySparkException, match="nonsense"):
        extraction.with_specs(rows, specs).collect()
    files = spark.createDataFrame([("uppercase_A.png",), ("page.2.png",), ("digit_7.png",), ("digit_7",)], "name string")
    assert sorted((r.name, r.character) for r in extraction.stored_glyphs(files, specs).collect()) == [("digit_7", "7"), ("digit_7.png", "7"), ("uppercase_A.png", "A")]
    marks = spark.createDataFrame([("a", 3, 1), ("a", 1, 2), ("b", 1, 0)], "k string, at int, good int")
    assert [(r.k, r.at) for r in extraction.first_match(marks, ["k"], F.col("good") > 0, ["at"]).collect()] == [("a", 1)]


def test_uploads(spark):
    mb = 1048576
    rows = [("j", 1, 15 * mb, "image/png", "x"), ("j", 2, 15 * mb + 1, "image/png", "x"), ("j", 3, 0, "image/png", "x"), ("j", 4, 9, "application/pdf", "x"), ("j", 5, 9, "image/jpeg", "x"), ("k", 6, 9, None, "dir/photo.JPEG"), ("k", 7, 9, None, "noext"), ("k", 8, None, None, "a.png")]
    files = spark.createDataFrame(rows, "job string, seq int, n_bytes long, content_type string, name string")
    before = spark.createDataFrame([("k", 4)], "job string, pages int")
    got = {r.seq: (r.error, r.page_name) for r in uploads.judged(files, "job", ["seq"], numbered_before=before).collect()}
    assert got == {1: (None, "page_1.png"), 2: ("too large (15.0 MB of 15 MB)", None), 3: ("empty", None), 4: ("type", None), 5: (None, "page_2.jpg"), 6: (None, "page_5.jpeg"), 7: (None, "page_6.jpg"), 8: ("empty", None)}


def test_packages(spark):
    verdicts = spark.createDataFrame([(1, "b", True), (1, "a", True), (1, "c", False), (2, "a", True)], "job_id long, character_id string, valid boolean")
    names = spark.createDataFrame([(1, "My Hand", "Regular", "1.0", "t"), (2, "Other", "Bold", "1.0", "t")], "job_id long, family_name string, style_name string, version string, template_id string")
    svgs = spark.createDataFrame([(1, "b", "<svg b/>"), (1, "a", "<svg a/>"), (2, "a", "<svg/>")], "job_id long, character_id string, svg string")
    fonts = spark.createDataFrame([(1, k, k.encode()) for k in ("ttf", "otf", "png", "pdf")] + [(2, "ttf", b"x")], "job_id long, kind string, content binary")
    members, failures = packaging.package_members(verdicts, names, svgs, fonts)
    assert [(r.job_id, r.error) for r in failures.collect()] == [(2, "missing: otf, pdf, png")]
    [packed] = outlines.packages(members).collect()
    with zipfile.ZipFile(io.BytesIO(packed.zip)) as z:
        assert z.namelist() == ["MyHand-Regular.otf", "MyHand-Regular.ttf", "README.txt", "glyphs.zip", "metadata.json", "preview.pdf", "preview.png"]
        said = json.loads(z.read("metadata.json"))
        assert (said["glyph_count"], said["valid_characters"], said["invalid_characters"]) == (2, ["a", "b"], ["c"])
        assert "2 of 3 requested characters were included" in z.read("README.txt").decode() and "1 character(s)" in z.read("README.txt").decode()
        with zipfile.ZipFile(io.BytesIO(z.read("glyphs.zip"))) as inner:
            assert inner.namelist() == ["a.svg", "b.svg"] and inner.read("a.svg") == b"<svg a/>"


def test_records_settings_and_lines(spark, tmp_path):
    rows = spark.createDataFrame([("A", "uppercase_A", True, 0.9, ["w"])], sources.VALIDATION)
    sources.write_records(rows, str(tmp_path / "v"))
    assert sources.records(spark, str(tmp_path / "v"), sources.VALIDATION).collect() == rows.collect()
    assert sources.settings({"dpi": "300", "hosts": " a, b,,", "debug": "True", "x": "1"}, {"dpi": 150, "hosts": [], "debug": False, "name": "n"}) == {"dpi": 300, "hosts": ["a", "b"], "debug": True, "name": "n"}
    assert geometry.font_lines(500, 0.75) == (375, -125)
    r = spark.range(1).select(geometry.upwards(F.array(F.struct(F.lit(10).alias("x"), F.lit(375).alias("y"))), 375, F.lit(5)).alias("p"), text.listed(F.lit(" a,,b ")).alias("l"), geometry.skew_angle(F.lit(89.0)).alias("s")).first()
    assert [tuple(p) for p in r.p] == [(15, 0)] and r.l == ["a", "b"] and r.s == -1.0


def test_glyph_pngs_of_crops(spark):
    runs = spark.createDataFrame([("g", 1, 2, 9), ("g", 7, 0, 3), ("other", 0, 0, 1)], "glyph string, y int, x0 int, x1 int")
    sizes = spark.createDataFrame([("g", 5, 4), ("empty", 3, 2)], "glyph string, width int, height int")
    got = {r.glyph: bytes(r.png) for r in outlines.glyph_pngs(runs, sizes=sizes).collect()}
    want = np.zeros((4, 5), np.uint8)
    want[1, 2:5] = 255
    assert got == {"g": outlines.png(want), "empty": outlines.png(np.zeros((2, 3), np.uint8))}
    assert {r.glyph for r in outlines.glyph_pngs(runs, 6).collect()} == {"g", "other"}


def test_too_little_ink(spark):
    assert [r.image for r in raster.too_little_ink(spark.createDataFrame([("a", 49), ("b", 50), ("c", None)], "image string, ink int")).orderBy("image").collect()] == ["a", "c"]


def test_event_counts_as_a_stream(spark, tmp_path):
    rows = [("2024-01-01 00:10:00", "A"), ("2024-01-01 00:20:00", "A"), ("2024-01-01 01:00:00", "B"), ("2024-01-02 00:00:00", "A")]
    spark.createDataFrame(rows, "ts string, event string").coalesce(1).write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts string, event string").json(str(tmp_path / "in"))
    made = status.event_counts(stream, "ts", "event")
    made.writeStream.format("memory").queryName("counted").outputMode("update").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start().awaitTermination()
    got = sorted((str(r.start), r.event, r.n) for r in spark.table("counted").collect())
    assert got == [("2024-01-01 00:00:00", "A", 2), ("2024-01-01 01:00:00", "B", 1), ("2024-01-02 00:00:00", "A", 1)]


def test_toggle_and_only_valid(spark):
    a, b = (spark.createDataFrame(x, "k int, v int") for x in ([(1, 1), (1, 2), (1, 2), (2, 1)], [(1, 2), (3, 9)]))
    assert sorted(map(tuple, jobs.toggled(a, b, ["k", "v"]).collect())) == [(1, 1), (2, 1), (3, 9)]


def test_only_the_character_set_is_broadcast(spark):
    """What grows with the jobs never passes whole through the driver, however small it looks: all other joins of a whole flow shuffle."""
    store = spark._jsparkSession.sharedState().statusStore()

    def executions():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        found = store.executionsList()
        return {e.executionId(): e.physicalPlanDescription() for e in (found.apply(i) for i in range(found.size()))}

    last = max(executions(), default=-1)
    flows.queries()["flow_deliveries"](spark, "/root/testdata/sf0.01").write.format("noop").mode("overwrite").save()
    plans = "\n".join(plan for i, plan in executions().items() if i > last)
    keys = re.findall(r"\) Broadcast\w*Join.*\nLeft keys \[\d+\]: \[(.*)\]", plans)
    assert len(keys) == len(re.findall(r"\) Broadcast\w*Join", plans)) > 0 and plans.count(") SortMergeJoin") > 50
    assert {re.sub(r"#\d+L?", "", k) for k in keys} == {"position", "character_id"}
