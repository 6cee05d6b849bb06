"""Helpers that several operators share: written intermediate tables, Arrow slices, exact positions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.stash import discard, finished, stash  # noqa: F401  for the operators

#: Bytes of text that one step inside a task works on; longer single texts form a slice of their own.
SLICE_BYTES = 1 << 20
#: Rows of 16 bytes up to which a table of one row for each partition is broadcast; a larger one is joined by shuffling.
BROADCAST_ROWS = 1 << 17
#: Bytes of an Arrow batch that Spark hands to Python (one row at least).
BATCH_BYTES = 4 << 20


def bounded(df: DataFrame) -> DataFrame:
    """df, in a session whose Arrow batches are bounded in bytes, as 10,000 long texts would fill a worker. A bound that the session sets itself stays."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(name, None) is None:
        conf.set(name, str(BATCH_BYTES))
    return df


def packed(df: DataFrame, *replaced: str) -> Column:
    """The caller's columns but for those replaced, as one struct: inside an operator none of them meets a name of its own. Taken apart by `packed.*`."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns if c not in replaced] or [F.lit(None).cast("boolean").alias("none")]).alias("packed")


def unpacked(df: DataFrame, *replaced: str) -> list[Column]:
    """The columns of df that packed() took in, out of `packed`."""
    return [F.col("packed").getField(c).alias(c) for c in df.columns if c not in replaced]


def task_rows(df: DataFrame, pid: str = "_pid", row: str = "_row") -> DataFrame:
    """A stash of df in which each row knows the task that wrote it and its place there."""
    mid = F.monotonically_increasing_id()
    return stash(df.withColumn("_mid", mid)).withColumns({pid: F.shiftright("_mid", 33), row: F.col("_mid").bitwiseAND((1 << 33) - 1)}).drop("_mid")


def with_position(df: DataFrame, order: list[Column], to: str) -> DataFrame:
    """Adds each row's place, from 0 and without gaps, in the total order of `order`.

    The rows are range-partitioned and sorted in parallel; the driver only sees one count for each
    partition. Rows equal in `order` get places in any order.
    """
    placed = task_rows(df.repartitionByRange(*order).sortWithinPartitions(*order))
    counts = sorted((r[0], r[1]) for r in placed.groupBy("_pid").count().collect())
    total, starts = 0, []
    for pid, n in counts:
        starts.append((pid, total))
        total += n
    spark = df.sparkSession
    offsets = spark.createDataFrame(starts, "_pid long, _start long")  # one row for each partition
    if len(starts) <= BROADCAST_ROWS:
        offsets = F.broadcast(offsets)
    return placed.join(offsets, "_pid").withColumn(to, F.col("_start") + F.col("_row")).drop("_pid", "_row", "_start")


def slices(batch: pa.RecordBatch, text: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts a batch into runs of rows with at most `most` bytes of text (one row at least)."""
    if not batch.num_rows:
        return
    size = np.asarray(pc.fill_null(pc.binary_length(batch.column(text)), 0), dtype=np.int64)
    ends = np.cumsum(size)
    at = 0
    while at < len(size):
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + most, side="right")))
        yield batch.slice(at, to - at)
        at = to


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words (runs without ASCII white space) of the texts in order, and where each text's words start (one more entry than texts)."""
    texts = pc.fill_null(texts, "")
    if pa.types.is_string(texts.type):
        texts = texts.cast(pa.large_string())
    parts = pc.ascii_split_whitespace(texts)
    flat = parts.flatten()
    ends = np.asarray(pc.list_value_length(parts), dtype=np.int64).cumsum()
    full = np.asarray(pc.binary_length(flat), dtype=np.int64) > 0
    kept = np.concatenate([[0], np.cumsum(full)])
    return flat.filter(pa.array(full)), np.concatenate([[0], kept[ends]])


def sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of values over the runs between consecutive starts."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[starts[1:]] - total[starts[:-1]]


def tile_rows(members: DataFrame, kept: list[str], n: Column, n_main: Column, of_main: Column, tile: int) -> DataFrame:
    """A row of `kept` for each tile that a member of a group goes to, with the tile's blocks i <= j and the member's side.

    Groups have n rows, n_main of them (where of_main) in one component, and rows of one component need no
    comparing. Blocks hold about `tile` rows by hash of `rep`: first those outside the largest component, then
    those of it. A tile is two blocks, or one with itself, but never two of the largest component. A group of
    `tile` rows or fewer is one tile. Give n_main 0 where all pairs are needed.
    """
    small = n <= tile
    outside = F.when(small, 1).otherwise(F.ceil((n - n_main) / tile)).cast("int")
    inside = F.when(small, 0).otherwise(F.ceil(n_main / tile)).cast("int")
    placed = members.withColumns({"_out": outside, "_in": inside, "_main": ~small & of_main})
    dealt = F.xxhash64("rep")
    block = F.when(F.col("_main"), F.col("_out") + F.pmod(dealt, F.col("_in"))).otherwise(F.pmod(dealt, F.col("_out"))).cast("int")
    others = F.sequence(F.lit(0), F.when(F.col("_main"), F.col("_out")).otherwise(F.col("_out") + F.col("_in")) - 1)
    tiles = F.transform(others, lambda o: F.struct(F.least("_block", o).alias("i"), F.greatest("_block", o).alias("j"), F.when(F.col("_block") > o, 1).otherwise(0).alias("side")))
    return placed.withColumn("_block", block).withColumn("_tile", F.explode(tiles)).select(*kept, "_tile.i", "_tile.j", "_tile.side")


def tiles_of(columns: dict[str, np.ndarray], key: list[str]) -> Iterator[dict[str, np.ndarray]]:
    """The rows of each tile (equal in key, i and j) of a step."""
    by = [*key, "i", "j"]
    order = np.lexsort([columns[c] for c in reversed(by)])
    sorted_by = np.stack([columns[c][order] for c in by])
    cuts = np.flatnonzero((sorted_by[:, 1:] != sorted_by[:, :-1]).any(axis=0)) + 1
    for rows in np.split(order, cuts):
        yield {c: x[rows] for c, x in columns.items()}


def tile_sides(tile: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, bool]:
    """Rows and columns to compare in a tile, and whether both are of the same block."""
    if tile["i"][0] == tile["j"][0]:
        every = np.arange(len(tile["i"]))
        return every, every, True
    return np.flatnonzero(tile["side"] == 0), np.flatnonzero(tile["side"] == 1), False


def in_steps(rows: DataFrame, key: list[str], steps: int) -> DataFrame:
    """Adds `step`, which deals the tiles of rows at random into `steps` groups (one at least)."""
    return rows.withColumn("step", F.pmod(F.xxhash64(*key, "i", "j"), F.lit(max(1, steps))))


def arrow_schema(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def word_count(text: Column) -> Column:
    """Number of runs without ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
