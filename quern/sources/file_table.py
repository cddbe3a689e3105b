"""A folder of files as a table and a sink: one PNG, SVG or ZIP a row, under its own name in its job's folder.

Written rows have job_id, name and content; files lie at path/job_id/name. Tasks write into a folder of their own attempt under
path/_writing-*; only when all tasks are done does the commit move these files into place, so that a task that failed, was
killed or ran twice leaves nothing behind. Messages to the driver hold a folder and a number a task, no names.
Reading gives job_id, name, format (suffix) and content; filters on job_id and format are decided before any file is opened.

The path may be a local one that all machines share, or one of a store that pyarrow knows (hdfs://, s3://, gs://).
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

SCHEMA = "job_id string, name string, format string, content binary"
WRITING = "_writing-"
#: Files moved at a time, and files and bytes that a reading task is given.
THREADS, FILES, BYTES = 32, 2000, 128 << 20
_BAD = re.compile(r"[/\\\x00]|^\.{0,2}$|^_writing-")


def _store(path: str) -> tuple[fs.FileSystem, str]:
    found, base = fs.FileSystem.from_uri(path)
    return found, base.rstrip("/")


def suffix(name: str) -> str:
    """What follows a name's last dot, in small letters; empty without one."""
    return name.rpartition(".")[2].lower() if "." in name else ""


def _files(store: fs.FileSystem, folder: str) -> list[fs.FileInfo]:
    found = store.get_file_info(fs.FileSelector(folder, allow_not_found=True))
    return [f for f in found if f.type == fs.FileType.File]


def _folders(store: fs.FileSystem, folder: str) -> list[str]:
    found = store.get_file_info(fs.FileSelector(folder, allow_not_found=True))
    return sorted(f.path for f in found if f.type == fs.FileType.Directory)


@dataclass
class Written(WriterCommitMessage):
    folder: str
    files: int


class FileWriter(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.base = path, overwrite, f"{WRITING}{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        """One task's files, in a folder that no other attempt uses."""
        store, root = _store(self.path)
        folder, n = f"{root}/{self.base}/{uuid.uuid4().hex}", 0
        jobs: set[str] = set()
        for batch in iterator:
            for row in range(batch.num_rows):
                job, name, content = (batch.column(c)[row].as_py() for c in ("job_id", "name", "content"))
                job, name = "" if job is None else str(job), "" if name is None else name
                if _BAD.search(job) or _BAD.search(name):
                    raise ValueError(f"not a file name: {job!r}, {name!r}")
                if job not in jobs:
                    jobs.add(job)
                    store.create_dir(f"{folder}/{job}")
                with store.open_output_stream(f"{folder}/{job}/{name}") as out:
                    out.write(content or b"")
                n += 1
        return Written(folder, n)

    def _moved(self, store: fs.FileSystem, root: str, folder: str) -> int:
        moves = []
        for job in _folders(store, folder):
            target = f"{root}/{job.rpartition('/')[2]}"
            store.create_dir(target)
            moves += [(f.path, f"{target}/{f.base_name}") for f in _files(store, job)]
        with ThreadPoolExecutor(THREADS) as pool:
            list(pool.map(lambda m: store.move(*m), moves))
        return len(moves)

    def commit(self, messages: list[Written | None]) -> None:
        """Moves each task's files into place; what an attempt wrote that isn't named here goes."""
        store, root = _store(self.path)
        if self.overwrite:
            for job in _folders(store, root):
                if not job.rpartition("/")[2].startswith(WRITING):
                    store.delete_dir(job)
        for m in messages:
            if m is not None and m.files and self._moved(store, root, m.folder) != m.files:
                raise RuntimeError(f"two rows of one task name the same file in {m.folder}")
        self._cleared(store, root)

    def abort(self, messages: list[Written | None]) -> None:
        self._cleared(*_store(self.path))

    def _cleared(self, store: fs.FileSystem, root: str) -> None:
        if store.get_file_info(f"{root}/{self.base}").type == fs.FileType.Directory:
            store.delete_dir(f"{root}/{self.base}")


@dataclass
class Share(InputPartition):
    """Some files: (job_id, path)."""

    files: tuple[tuple[str, str], ...]


class FileReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path
        self.wanted: dict[str, set[str]] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            column, values = (f.attribute[0], {f.value} if isinstance(f, EqualTo) else set(f.value)) if isinstance(f, EqualTo | In) else (None, set())
            if column in ("job_id", "format"):
                self.wanted[column] = self.wanted.get(column, values) & values
            else:
                yield f

    def partitions(self) -> list[Share]:
        """Files dealt into shares by number and size. Only folders of wanted jobs are listed, and no file is opened."""
        store, root = _store(self.path)
        if "job_id" in self.wanted:
            jobs = sorted(j for j in self.wanted["job_id"] if isinstance(j, str) and not _BAD.search(j))
        else:
            jobs = [j for p in _folders(store, root) if not (j := p.rpartition("/")[2]).startswith("_")]
        out, now, size = [], [], 0
        for job in jobs:
            for f in sorted(_files(store, f"{root}/{job}"), key=lambda f: f.base_name):
                if suffix(f.base_name) in self.wanted.get("format", {suffix(f.base_name)}):
                    now.append((job, f.path))
                    size += f.size or 0
                    if len(now) >= FILES or size >= BYTES:
                        out.append(Share(tuple(now)))
                        now, size = [], 0
        return [*out, Share(tuple(now))]

    def read(self, partition: Share) -> Iterator[tuple]:
        store, _ = _store(self.path)
        for job, path in partition.files:
            name = path.rpartition("/")[2]
            with store.open_input_stream(path) as f:
                yield job, name, suffix(name), f.read()


class FileTable(DataSource):
    """Format "quern_files"; the path is the folder of all jobs."""

    @classmethod
    def name(cls) -> str:
        return "quern_files"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> FileReader:
        return FileReader(self.options["path"])

    def writer(self, schema: StructType, overwrite: bool) -> FileWriter:
        return FileWriter(self.options["path"], overwrite)


def _registered(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(FileTable)


def write_files(rows: DataFrame, path: str, mode: str = "append") -> None:
    """rows (job_id, name, content) as files. Rows of one job are dealt together, so that its folder is listed once.

    append replaces files of the same name and leaves the others; overwrite removes all jobs' files first. Every (job_id,
    name) may occur once; names with slashes, empty ones and null ids stop the write, and then nothing has changed.
    """
    _registered(rows.sparkSession)
    files = rows.selectExpr("cast(job_id as string) as job_id", "name", "'' as format", "content")
    files.repartition("job_id").write.format("quern_files").mode(mode).save(path)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """job_id, name, format, content of all files; a folder that isn't there is an empty table."""
    _registered(spark)
    return spark.read.format("quern_files").load(path)
