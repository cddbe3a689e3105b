"""The file sink and reader: every file once, also when a task is killed half-way; pruned reads."""

import os
import subprocess
import sys

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from quern.sources import file_table
from quern.sources.file_table import FileReader, read_files, write_files

SCHEMA = "job_id string, name string, content binary"


def table(df):
    return sorted((r.job_id, r.name, r.format, bytes(r.content)) for r in df.collect())


def on_disk(path):
    return sorted(os.path.relpath(os.path.join(d, f), path) for d, _, files in os.walk(path) for f in files)


def test_written_and_read_back(spark, tmp_path):
    path = str(tmp_path / "files")
    rows = [(f"j{i % 7}", f"uppercase_{i}.{('png', 'SVG', 'zip')[i % 3]}", bytes([i]) * i) for i in range(60)] + [("j0", "no suffix", None)]
    write_files(spark.createDataFrame(rows, SCHEMA).repartition(6), path)
    want = sorted((j, n, n.rpartition(".")[2].lower() if "." in n else "", c or b"") for j, n, c in rows)
    assert table(read_files(spark, path)) == want and on_disk(path) == sorted(f"{j}/{n}" for j, n, _ in rows)
    # Appending replaces files of the same name; overwriting clears what was there.
    write_files(spark.createDataFrame([("j0", "uppercase_0.png", b"new"), ("k", "a.png", b"k")], SCHEMA), path)
    assert len(table(read_files(spark, path))) == 62 and ("j0", "uppercase_0.png", "png", b"new") in table(read_files(spark, path))
    write_files(spark.createDataFrame([("k", "b.png", b"k")], SCHEMA), path, "overwrite")
    assert on_disk(path) == ["k/b.png"]
    assert table(read_files(spark, str(tmp_path / "nothing"))) == []
    write_files(spark.createDataFrame([], SCHEMA), path)
    assert on_disk(path) == ["k/b.png"]


def test_bad_names_change_nothing(spark, tmp_path):
    path = str(tmp_path / "files")
    write_files(spark.createDataFrame([("j", "a.png", b"1")], SCHEMA), path)
    for job, name in (("j", "../a.png"), ("..", "a.png"), ("j", ""), (None, "a.png"), ("j", None)):
        with pytest.raises(PySparkException):
            write_files(spark.createDataFrame([("j", "new.png", b"2"), (job, name, b"2")], SCHEMA), path)
        assert on_disk(path) == ["j/a.png"]


def test_twice_the_same_file_stops(spark, tmp_path):
    with pytest.raises(PySparkException, match="same file"):
        write_files(spark.createDataFrame([("j", "a.png", b"1"), ("j", "a.png", b"2")], SCHEMA), str(tmp_path / "files"))


def test_reads_are_pruned(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "files")
    rows = [(f"j{i % 7}", f"{i}.{('png', 'svg')[i % 2]}", bytes([i])) for i in range(28)]
    write_files(spark.createDataFrame(rows, SCHEMA), path)
    df = read_files(spark, path)
    assert table(df.filter("job_id = 'j3' and format = 'png'")) == sorted((j, n, "png", c) for j, n, c in rows if j == "j3" and n.endswith("png"))
    assert table(df.filter(F.col("job_id").isin("j1", "j2", "../j1") & (F.length("content") > 0))) == sorted((j, n, n[-3:], c) for j, n, c in rows if j in ("j1", "j2"))
    # Only wanted files are in a reader's shares, dealt by number.
    monkeypatch.setattr(file_table, "FILES", 2)
    from pyspark.sql.datasource import EqualTo, In

    reader = FileReader(path)
    assert list(reader.pushFilters([EqualTo(("format",), "svg"), In(("job_id",), ("j1", "j2", "j9")), EqualTo(("name",), "x")])) == [EqualTo(("name",), "x")]
    shares = reader.partitions()
    assert {os.path.relpath(p, path) for s in shares for _, p in s.files} == {f"{j}/{n}" for j, n, _ in rows if j in ("j1", "j2") and n.endswith("svg")}
    assert max(len(s.files) for s in shares) == 2


KILLED = """
import os, sys
from pyspark import TaskContext
from pyspark.sql import SparkSession
from quern.sources.file_table import read_files, write_files
path, root = sys.argv[1:]
spark = SparkSession.builder.master("local[2,3]").config("spark.ui.enabled", "false").config("spark.sql.warehouse.dir", root).config("spark.sql.shuffle.partitions", "3").config("spark.sql.execution.arrow.maxRecordsPerBatch", "5").getOrCreate()

def rows(batches):
    for n, batch in enumerate(batches):
        if n == 2 and TaskContext.get().attemptNumber() == 0:
            os._exit(1)  # the first attempt dies with files written
        yield batch

df = spark.range(90).selectExpr("concat('j', id % 4) as job_id", "concat(id, '.png') as name", "cast(cast(id as string) as binary) as content")
from quern.sources import file_table
file_table._registered(spark)
files = df.selectExpr("job_id", "name", "'' as format", "content").repartition("job_id").mapInArrow(rows, file_table.SCHEMA)
files.write.format("quern_files").mode("append").save(path)
got = sorted((r.job_id, r.name, bytes(r.content)) for r in read_files(spark, path).collect())
assert got == sorted((f"j{i % 4}", f"{i}.png", str(i).encode()) for i in range(90)), len(got)
print("whole")
"""


def test_killed_task_is_repeated(tmp_path):
    path = str(tmp_path / "files")
    run = subprocess.run([sys.executable, "-c", KILLED, path, str(tmp_path / "w")], capture_output=True, text=True, timeout=300, cwd=os.getcwd(), env={**os.environ, "PYTHONPATH": f"{os.getcwd()}:{os.environ.get('PYTHONPATH', '')}"})
    assert run.stdout.strip().endswith("whole"), run.stderr[-3000:]
    assert len(on_disk(path)) == 90 and not [f for f in on_disk(path) if "_writing" in f]
