"""A sink for files: tasks write under temporary names, the commit gives all files their names, an abort leaves nothing."""

from __future__ import annotations

import json
import os
import posixpath
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

NAME = "lathework_files"
SCHEMA = "path string, content binary"
#: Lists that the format's own commit goes through at once; write_files has tasks for them.
THREADS = 32
#: Files that a task writes or reads, about; where a task would have more, rows are dealt anew.
FILES_A_TASK = 4_000


def located(folder: str) -> tuple[arrow_fs.FileSystem, str]:
    """The file system of a folder, and the folder's path there."""
    if "://" in folder or folder.startswith("file:"):
        return arrow_fs.FileSystem.from_uri(folder if "://" in folder else "file://" + folder[5:])
    return arrow_fs.LocalFileSystem(), folder


def inside(path: str) -> str:
    """A path below the sink's folder, cleaned; raises where it leads out of it."""
    clean = posixpath.normpath(path.lstrip("/"))
    if clean in ("", ".") or clean.startswith(".."):
        raise ValueError(f"not a file below the folder: {path!r}")
    return clean


def spread(df: DataFrame, key: str, most: int = FILES_A_TASK) -> DataFrame:
    """df as it lies if no task has more than `most` rows, else dealt by a key to tasks of about so many. The driver sees a count a task."""
    counts = [r[0] for r in df.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).select("n").collect()]
    return df if max(counts, default=0) <= most else df.repartition(max(len(counts), -(-sum(counts) // most)), key)


def stage(root: str, staging: str, rows: Iterator[tuple[str | None, bytes | None]]) -> tuple[str, int]:
    """Writes a task's files into a folder of the attempt's own, so that attempts never meet, with a list of their names. Returns that folder and the number of files; one that fails deletes what it wrote."""
    files, root = located(root)
    attempt, n = f"{staging}/{uuid.uuid4().hex}", 0
    files.create_dir(f"{root}/{attempt}", recursive=True)
    try:
        with files.open_output_stream(f"{root}/{attempt}/list") as listed:
            for path, content in rows:
                if path is None or content is None:
                    continue
                target = inside(path)
                with files.open_output_stream(f"{root}/{attempt}/{n}.part") as out:
                    out.write(content)
                listed.write(json.dumps(target).encode() + b"\n")
                n += 1
    except BaseException:
        files.delete_dir(f"{root}/{attempt}")
        raise
    return attempt, n


def _listed(root: str, attempt: str) -> Iterator[tuple[arrow_fs.FileSystem, str, str]]:
    """(file system, staged file, target) of a task's files."""
    files, root = located(root)
    with files.open_input_stream(f"{root}/{attempt}/list") as listed:
        lines = listed.read().splitlines()
    for k, line in enumerate(lines):
        yield files, f"{root}/{attempt}/{k}.part", f"{root}/{json.loads(line)}"


def name_all(root: str, attempt: str) -> None:
    """Gives a task's files their names; those that have them from an attempt before are done."""
    made: set[str] = set()
    for files, staged, target in _listed(root, attempt):
        folder = posixpath.dirname(target)
        if folder not in made:
            files.create_dir(folder, recursive=True)
            made.add(folder)
        try:
            place(files, staged, target)
        except FileExistsError:
            if not placed(files, staged, target):
                raise


def take_back(root: str, attempt: str) -> None:
    for files, staged, target in _listed(root, attempt):
        if placed(files, staged, target):
            files.delete_file(target)


def sweep(root: str, at: str) -> None:
    """Deletes what is staged in a folder, if it is there."""
    files, root = located(root)
    if files.get_file_info(f"{root}/{at}").type != arrow_fs.FileType.NotFound:
        files.delete_dir(f"{root}/{at}")


def commit_all(each: Callable[[Callable[[str, str], None]], None]) -> None:
    """Names all files, or none: if one of them exists already, those that were named are taken back and the write fails. `each` applies a function to every task's folder."""
    try:
        each(name_all)
    except BaseException:
        each(take_back)
        raise


@dataclass
class Written(WriterCommitMessage):
    """What a task leaves for the commit: its folder, in which a list of its files lies, so that the driver holds a name a task."""

    attempt: str
    files: int


class FileWriter(DataSourceWriter):
    def __init__(self, folder: str) -> None:
        self.folder = folder.rstrip("/") or "/"
        self.staging = f".lathework-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator) -> Written:
        return Written(*stage(self.folder, self.staging, iterator))

    def commit(self, messages: list[Written | None]) -> None:
        def each(act: Callable[[str, str], None]) -> None:
            with ThreadPoolExecutor(THREADS) as pool:
                list(pool.map(lambda message: act(self.folder, message.attempt), filter(None, messages)))

        try:
            commit_all(each)
        finally:
            self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        """Deletes everything staged, also by attempts whose executor was lost."""
        sweep(self.folder, self.staging)


def place(files: arrow_fs.FileSystem, staged: str, target: str) -> None:
    """Gives a staged file its name unless that exists. On a local or mounted file system this is one step; elsewhere it is looked up first."""
    if isinstance(files, arrow_fs.LocalFileSystem):
        os.link(staged, target)
    elif files.get_file_info(target).type != arrow_fs.FileType.NotFound:
        raise FileExistsError(target)
    else:
        files.move(staged, target)


def placed(files: arrow_fs.FileSystem, staged: str, target: str) -> bool:
    """Whether the target is this staged file."""
    if isinstance(files, arrow_fs.LocalFileSystem):
        return os.path.exists(target) and os.path.samefile(staged, target)
    return files.get_file_info(staged).type == arrow_fs.FileType.NotFound


class FileSink(DataSource):
    """df.write.format(NAME).mode("append").save(folder), for rows SCHEMA. Rows are written as they lie, and the driver names all files; write_files leaves that to tasks."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema: StructType, overwrite: bool) -> FileWriter:
        if overwrite:
            raise ValueError("files are never overwritten; use mode append")
        return FileWriter(self.options["path"])


def write_files(df: DataFrame, folder: str, path: Column, content: Column) -> None:
    """Writes a file for each row: `content` at `path` below `folder`, which all executors must reach by that name.

    All files get their names at the end or none does. A file that exists, two rows of one path, and a path that
    leads out of the folder fail the write and change nothing. Rows whose path or content is null are failed jobs and
    leave no file; empty contents are empty files; of an empty table nothing is written. A task that is run again
    writes under new temporary names, and the commit sweeps those of lost attempts. Tasks hold a batch of rows.

    Rows are counted by task first and, where a task has too many, dealt anew (spread). Files are named, and what was
    staged is deleted, by tasks as well: a task for each that wrote.
    """
    spark = df.sparkSession
    spark.dataSource.register(FileSink)
    root, staging = folder.rstrip("/") or "/", f".lathework-{uuid.uuid4().hex}"
    rows = df.select(path.cast("string").alias("path"), content.cast("binary").alias("content")).where(F.col("path").isNotNull())

    def staged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values = (row for batch in batches for row in zip(*(column.to_pylist() for column in batch.columns), strict=True))
        attempt, n = stage(root, staging, values)
        yield pa.RecordBatch.from_pydict({"attempt": pa.array([attempt], pa.string()), "files": pa.array([n], pa.int64())})

    try:
        attempts = [r["attempt"] for r in spread(rows, "path").mapInArrow(staged, "attempt string, files long").where("files > 0").collect()]
        commit_all(lambda act: _in_tasks(spark, attempts, root, act))
        _in_tasks(spark, attempts, root, sweep)
    finally:
        sweep(root, staging)


def _in_tasks(spark: SparkSession, attempts: list[str], root: str, act: Callable[[str, str], None]) -> None:
    """Applies a function to the folders that tasks wrote, a task for each."""

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in batch.column(0).to_pylist():
                act(root, attempts[k])
        yield from ()

    if attempts:
        spark.range(0, len(attempts), 1, len(attempts)).mapInArrow(one, "done long").collect()
