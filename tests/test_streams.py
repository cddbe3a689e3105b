"""Keyed job states and the landing folder as streams."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.operators import flow, jobs, outlines, template
from quern.plans.rasters import _changes
from quern.streaming import job_states
from quern.streaming.landing import Landing, photos

SCHEMA = "job string, state string, ts timestamp, seq long"


def streamed(spark, tmp_path, files, **options):
    """All that the stream gives for rows that come in the given files, one a micro-batch."""
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for rows in files:
        rows.coalesce(1).write.mode("append").json(source)
        stream = spark.readStream.schema(rows.schema).json(source)
        made = job_states.judged_changes(stream, *rows.columns[:4], **options)
        made.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "c")).outputMode("append").trigger(availableNow=True).start().awaitTermination(300)
    return spark.read.parquet(out)


@pytest.fixture(autouse=True)
def two_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_same_as_the_table(spark, tmp_path):
    """Events in files that overlap in time and repeat rows; a far row of another job moves the watermark past all of them."""
    rows = _changes(spark, "/root/testdata/sf0.001").select("user_id", "state", F.col("ts").cast("timestamp").alias("ts"), "event_id")
    end = spark.createDataFrame([(-1, "created", dt.datetime(2100, 1, 1), -1)], rows.schema)
    # Within an hour of one another rows come in any order, and some come twice.
    order = F.unix_timestamp("ts") + F.pmod(F.xxhash64("event_id"), F.lit(3600))
    cut = rows.select(F.percentile_approx(order, [0.33, 0.66]).alias("c")).first().c
    files = [rows.filter((order >= a) & (order < b) | (F.col("event_id") % 7 == 0) & (order >= a - 100_000) & (order < b)) for a, b in zip([0, *cut], [*cut, 1 << 40])]
    assert sum(f.count() for f in files) > rows.count()
    got = streamed(spark, tmp_path, [*files, end], late="40 hours").filter("user_id >= 0")
    want = jobs.transitions(rows, "user_id", "state", ["ts", "event_id"])
    columns = ["user_id", "event_id", "state", "before", "allowed"]
    assert sorted(map(tuple, got.select(*columns).collect()), key=str) == sorted(map(tuple, want.select(*columns).collect()), key=str)


def test_late_and_hanging_jobs(spark, tmp_path):
    at = lambda h, m=0: dt.datetime(2024, 1, 1, h, m)
    first = [("a", "created", at(0), 1), ("a", "uploading", at(1), 2), ("a", "processing", at(2), 3), ("b", "created", at(0), 4), ("b", "processing", at(3), 5), (None, "created", at(0), 6), ("z", "created", at(12), 7)]
    late = [("a", "created", at(0, 30), 8), ("b", "uploading", at(0, 30), 9), ("c", "created", at(11), 10), ("z", "created", at(23), 11)]
    last = [("z", "created", dt.datetime(2024, 1, 3), 12)]
    got = streamed(spark, tmp_path, [spark.createDataFrame(r, SCHEMA) for r in (first, late, last)], late="2 hours", timeout_ms=4 * 3600 * 1000)
    rows = sorted((r.job, r.seq, r.state, r.before, r.allowed, r.reason) for r in got.filter("job <> 'z'").collect())
    assert rows == [
        ("a", 1, "created", None, True, None), ("a", 2, "uploading", "created", True, None), ("a", 3, "failed", "processing", True, "timed out"), ("a", 3, "processing", "uploading", True, None),
        ("b", 4, "created", None, True, None), ("b", 5, "failed", "processing", True, "timed out"), ("b", 5, "processing", "created", False, None), ("c", 10, "created", None, True, None),
    ]


def page(n, extra=0):
    a = np.full((300, 400), 230, np.uint8)
    for i in range(n):
        x, y = 30 + i % 5 * 70, 40 + i // 5 * 90
        a[y : y + 40, x : x + 8] = a[y + 32 : y + 40, x : x + 30] = 20
    return a


def landed(spark, folder, root, groups, expected, again=False):
    """Present job and validation rows after the files of each group have come, a batch each."""
    specs = template.characters(spark)
    landing = Landing(str(root / "store"), lambda images, runs: flow.plain_jobs(images, runs, expected, specs))
    seen = []
    for files in groups:
        for job, name, content in files:
            (folder / job).mkdir(parents=True, exist_ok=True)
            (folder / job / name).write_bytes(content)
        landing.start(photos(spark, str(folder)), str(root / "c")).awaitTermination(600)
    if again:  # the first batch once more, as after a crash between its writes and its commit
        first = spark.read.format("image").load([str(folder / j / n) for j, n, _ in groups[0]])
        place = [F.regexp_extract("image.origin", r"([^/]+)/([^/]+)$", i) for i in (1, 2)]
        landing.take(first.select(place[0].alias("job_id"), F.concat_ws("/", *place).alias("image"), "image.height", "image.width", F.col("image.nChannels").alias("channels"), "image.data"), 0)
    for name in ("jobs", "validations", "pages"):
        seen.append(sorted(map(str, landing.table(spark, name).collect())))
    return seen


def test_batches_of_a_landing_folder(spark, tmp_path):
    ids = [r.character_id for r in template.characters(spark).orderBy("ord").limit(9).collect()]
    wanted = [("a/page_1.png", i + 1, c) for i, c in enumerate(ids[:5])] + [("a/page_2.png", i + 1, c) for i, c in enumerate(ids[5:7])] + [("b/page_1.png", i + 1, c) for i, c in enumerate(ids[:3])] + [("b/page_2.png", 1, ids[8])]
    expected = spark.createDataFrame(wanted, "image string, position int, character_id string")
    files = [("a", "page_1.png", outlines.png(page(5))), ("b", "page_1.png", outlines.png(page(2))), ("a", "page_2.png", outlines.png(page(2))), ("b", "page_2.png", b"not an image"), ("b", "page_2.png", b"not an image")][:4]
    for d in ("one", "three"):
        (tmp_path / d).mkdir()
    one = landed(spark, tmp_path / "in1", tmp_path / "one", [files], expected)
    three = landed(spark, tmp_path / "in3", tmp_path / "three", [files[:2], files[2:3], files[3:]], expected, again=True)
    assert one == three and len(one[0]) == 2 and len(one[1]) == 7
    assert "completed" in one[0][0] and "failed" in one[0][1] and "found 2 characters, expected 3" in one[2][2] and "no handwriting found" in one[2][3]
