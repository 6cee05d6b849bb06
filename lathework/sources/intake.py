"""Intake: path lists and files as DataFrames, filtered and without repeats."""

from __future__ import annotations

import os
import posixpath
from collections.abc import Iterator, Sequence
from functools import reduce
from itertools import islice

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import base_name, extension, raw_extension, standard
from .file_sink import located, spread
from .stash import stash

INPUTS = "idx long, path string"
#: Rows of an Arrow batch of names.
ROWS = 10_000
#: Bytes of an Arrow batch of contents; a larger file is one of its own.
BYTES = 4 << 20
#: Tasks that list folders at most.
TASKS = 1_024


def path_list(spark: SparkSession, paths: Sequence[str | None]) -> DataFrame:
    """A list of paths in order as (idx, path); entries that resolved to nothing are left out."""
    return spark.createDataFrame(list(enumerate(p for p in paths if p is not None)), INPUTS)


def read_files(spark: SparkSession, path: str, glob: str | None = None, content: bool = True) -> DataFrame:
    """Files under a path with name, size and, if wanted, content; a glob is applied before files are opened.

    A folder of a local or mounted file system is listed, level by level, and its files are read by tasks, as the list
    that Spark's reader makes lies in the driver. Globs, single files and other file systems are left to that reader.
    Both leave out names that begin with a dot or an underscore, and what lies in such folders; Spark's reader also
    leaves out empty files.
    """
    if glob is None and (root := _mounted(path)):
        found = _files_below(spark, root)
        return _contents(found) if content else found
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    files = reader.load(path)
    return files if content else files.drop("content")


def names_in(spark: SparkSession, path: str) -> DataFrame:
    """(path) of the files in a folder, and of those below it that have a folder `key=value` on their way.

    A folder of a local or mounted file system is listed by tasks. All others, and globs, are listed by Spark, in the
    driver, and hold what it finds there: of a folder with folders `key=value` only what lies in these.
    """
    if not (root := _mounted(path)):
        return spark.read.format("binaryFile").load(path).select("path")
    root = "/" + posixpath.normpath(root).lstrip("/")
    inside = F.substr("path", F.lit(len(f"file:{root.rstrip('/')}/") + 1))
    return _files_below(spark, root).where(inside.rlike("^[^/]*$|(^|/)[^/=]+=[^/]*/")).select("path")


def _mounted(path: str) -> str | None:
    """The folder that a path names on this machine; None if it is another thing."""
    if not (path.startswith("/") or path.startswith("file:/")) or any(c in path for c in "*?[]{}\\%"):
        return None
    _, at = located(path)
    return (at.rstrip("/") or "/") if os.path.isdir(at) else None


def _hidden(name: str) -> bool:
    """As Spark has it."""
    return name.startswith(".") or (name.startswith("_") and "=" not in name) or name.endswith("._COPYING_")


def _files_below(spark: SparkSession, root: str) -> DataFrame:
    """(path, modificationTime, length) of all files below a folder; the driver sees only how many folders a level has."""

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                with os.scandir(folder) as there:
                    seen = ((x.path, x.is_dir(), stat) for x in there if not _hidden(x.name) and (stat := _stat(x)))
                    while part := list(islice(seen, ROWS)):
                        yield pa.RecordBatch.from_pydict({"path": pa.array([p for p, _, _ in part], pa.string()), "folder": pa.array([d for _, d, _ in part], pa.bool_()), "changed": pa.array([s.st_mtime_ns // 1_000_000 for _, _, s in part], pa.int64()), "length": pa.array([s.st_size for _, _, s in part], pa.int64())})

    folders, files = spark.createDataFrame([(root,)], "path string"), []
    while files == [] or not folders.isEmpty():
        found = stash(_dealt(folders, "path").mapInArrow(listed, "path string, folder boolean, changed long, length long"))
        files.append(found.where(~F.col("folder")))
        folders = found.where("folder").select("path")
    return reduce(DataFrame.unionAll, files).select(F.concat(F.lit("file:"), "path").alias("path"), F.timestamp_millis("changed").alias("modificationTime"), "length")


def _stat(found: os.DirEntry) -> os.stat_result | None:
    """None for a link that leads nowhere, and for what has gone meanwhile; Spark leaves both out."""
    try:
        return found.stat()
    except FileNotFoundError:
        return None


def _contents(files: DataFrame) -> DataFrame:
    """Adds the content of local files."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths, lengths, at = batch.column("path").to_pylist(), batch.column("length").to_pylist(), 0
            while at < len(paths):
                to = at + 1
                size = lengths[at]
                while to < len(paths) and size + lengths[to] <= BYTES:
                    size += lengths[to]
                    to += 1
                contents = []
                for path in paths[at:to]:
                    with open(path.removeprefix("file:"), "rb") as file:
                        contents.append(file.read())
                part = batch.slice(at, to - at)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(contents, pa.binary())], names=[*part.schema.names, "content"])
                at = to

    return spread(files, "path").mapInArrow(read, "path string, modificationTime timestamp, length long, content binary")


def with_extension(df: DataFrame, allowed: Sequence[str], path: str = "path") -> DataFrame:
    """Rows whose extension, in any case, is allowed; all rows if none is named."""
    return df.where(extension(F.col(path)).isin(*[e.lower() for e in allowed])) if allowed else df


def first_of_each(df: DataFrame, key: Column, order: str = "idx") -> DataFrame:
    """The first row by `order` of each key, nulls being one key; rows whose order is null come last.

    One aggregate, combined before the shuffle: a key that a third of all rows share costs a row a task.
    """
    firsts = df.groupBy(key.alias("_key")).agg(F.min_by(F.struct(*[df[c] for c in df.columns]), F.struct(F.col(order).isNull(), F.col(order))).alias("_row"))
    return firsts.select("_row.*")


def queued(df: DataFrame, queue: DataFrame | None = None, path: str = "path", order: str = "idx") -> DataFrame:
    """New paths of a batch in order: first of each standard path, and none that is in the queue already."""
    new = first_of_each(df, standard(F.col(path)), order)
    if queue is None:
        return new
    known = queue.select(standard(F.col(path)).alias("_known")).distinct()
    return new.join(known, standard(new[path]) == F.col("_known"), "left_anti")


def without(df: DataFrame, path: str) -> DataFrame:
    """The queue without one path."""
    return df.where(~F.col("path").eqNullSafe(F.lit(path)))


def cleared(df: DataFrame) -> DataFrame:
    return df.limit(0)


def file_size(length: Column) -> Column:
    """Bytes, 0 where they are not known."""
    return F.coalesce(length.cast("long"), F.lit(0).cast("long"))


def existing_names(folders: DataFrame, folder: str = "out_dir") -> DataFrame:
    """(out_dir, base, out_ext) of all that lies in the folders of a column, for assign_names and the like.

    Tasks list the folders, each folder once, so that no list goes through the driver; the file system must be reached
    by the folders' names from all executors. Files, folders and links count alike, as any of them takes its name. A
    folder that does not exist, and null or empty ones (bare names in no folder), hold nothing.
    """

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                found = iter(_names(*located(name)))
                while part := list(islice(found, ROWS)):
                    yield pa.RecordBatch.from_pydict({"out_dir": pa.array([name] * len(part), pa.string()), "name": pa.array(part, pa.string())})

    wanted = stash(folders.select(F.col(folder).alias("out_dir")).where(F.coalesce(F.col("out_dir"), F.lit("")) != "").distinct())
    found = _dealt(wanted, "out_dir").mapInArrow(listed, "out_dir string, name string")
    return found.select("out_dir", base_name(F.col("name")).alias("base"), raw_extension(F.col("name")).alias("out_ext"))


def _dealt(folders: DataFrame, key: str) -> DataFrame:
    """Folders dealt to a task each, as far as TASKS go; Spark itself would put so few rows into one task."""
    return folders.repartition(max(1, min(folders.count(), TASKS)), key)


def _names(files: arrow_fs.FileSystem, path: str) -> Iterator[str]:
    """The names in a folder, without a look at each file where that can be spared; none if it is not there."""
    if not isinstance(files, arrow_fs.LocalFileSystem):
        yield from (x.base_name for x in files.get_file_info(arrow_fs.FileSelector(path, allow_not_found=True)))
        return
    try:
        with os.scandir(path) as found:
            yield from (x.name for x in found)
    except FileNotFoundError:
        return
