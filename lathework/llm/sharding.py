"""Sharding by a hypergeometric communication matrix.

A uniform shuffle of N rows into S shards of exact sizes needs no random tie-breaking and no rejection:
the number of rows that each input partition sends to each shard is multivariate hypergeometric, so it is
drawn first; every partition then permutes its own rows and deals them out by those counts, and every
shard permutes what it has received.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_schema, bounded, packed, task_rows, unpacked, with_position


#: Bytes up to which the partitions' rows of the matrix are broadcast; a larger matrix is joined to the rows instead.
BROADCAST_BYTES = 32 << 20


def shard_sizes(rows: int, shards: int) -> np.ndarray:
    """Sizes at most one apart."""
    return np.full(shards, rows // shards, dtype=np.int64) + (np.arange(shards) < rows % shards)


def communication_matrix(counts: np.ndarray, sizes: np.ndarray, seed: int) -> np.ndarray:
    """Rows that partition i sends to shard j: row sums are `counts`, column sums are `sizes`.

    Each row is multivariate hypergeometric given what the rows before it have left over.
    """
    rng = np.random.default_rng(seed)
    left, out = sizes.copy(), np.zeros((len(counts), len(sizes)), dtype=np.int64)
    for i, n in enumerate(counts):
        out[i] = rng.multivariate_hypergeometric(left, n, method="marginals")
        left -= out[i]
    return out


def shard_rows(df: DataFrame, shards: int, seed: int = 17) -> DataFrame:
    """Adds `shard` (0 to shards - 1) and `slot` (place in the shard, gapless from 0).

    The result is a uniform random permutation of the rows, cut into shards whose sizes differ by one at
    most. Content plays no part: null values, empty texts and repeated rows are dealt like any others, and
    columns named shard or slot are replaced, all others kept whatever their names. An empty table gives an empty result.

    The driver holds one row of `shards` counts for each input partition. Rows are written once with their
    partition and place, so a lost executor's work is redone on the same rows; a shard is ordered by a
    range-partitioned sort, so that it may span many tasks.
    """
    if shards < 1:
        raise ValueError("shards must be at least 1")
    spark = df.sparkSession
    own = unpacked(df, "shard", "slot")
    placed = task_rows(df.select(packed(df, "shard", "slot")))
    found = sorted((r[0], r[1]) for r in placed.groupBy("_pid").count().collect())
    pids, counts = np.array([p for p, _ in found], dtype=np.int64), np.array([n for _, n in found], dtype=np.int64)
    sizes = shard_sizes(int(counts.sum()), shards)
    matrix = communication_matrix(counts, sizes, seed)
    ends = np.cumsum(matrix, axis=1)
    schema = T.StructType(placed.schema.fields + [T.StructField("shard", T.IntegerType())])
    to = arrow_schema(schema)
    small, names = ends.nbytes <= BROADCAST_BYTES, placed.columns
    if small:
        shared = spark.sparkContext.broadcast((pids, ends))
        given = placed
    else:
        rows = spark.createDataFrame(zip(pids.tolist(), ends.tolist(), strict=True), "_pid long, _ends array<long>")
        shared, given = None, placed.join(rows, "_pid").select(*placed.columns, "_ends")

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, order, mine = -1, np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
        for batch in batches:
            pid, row = np.asarray(batch.column("_pid")), np.asarray(batch.column("_row"))
            shard = np.empty(len(pid), dtype=np.int32)
            for p in np.unique(pid):
                at = np.flatnonzero(pid == p)
                if p != last:
                    mine = shared.value[1][np.searchsorted(shared.value[0], p)] if shared else np.asarray(batch.column("_ends")[int(at[0])].values)
                    last, order = p, np.random.default_rng([seed, 1, int(p)]).permutation(mine[-1])
                shard[at] = np.searchsorted(mine, order[row[at]], side="right")
            yield pa.RecordBatch.from_arrays([*(batch.column(name) for name in names), pa.array(shard)], schema=to)

    dealt = bounded(given).mapInArrow(deal, schema)
    again = F.xxhash64(F.lit(seed), F.col("_pid"), F.col("_row"))
    shown = [c for c in dealt.columns if c not in ("_pid", "_row")]
    placed = with_position(dealt.select(*shown, again.alias("_again"), F.struct("_pid", "_row").alias("_tie")), [F.col("shard"), F.col("_again"), F.col("_tie")], "slot")
    least = int(sizes.min())
    larger = int((sizes > least).sum())  # the first shards have one row more
    start = F.col("shard").cast("long") * least + F.least("shard", F.lit(larger))
    return placed.withColumn("slot", F.col("slot") - start).select(*own, "shard", "slot")
