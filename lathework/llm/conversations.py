"""Chat formatting with collapse of cumulative snapshots.

Logs often hold a conversation again each time it grows. A rolling hash of each conversation's turns gives
one value for every prefix; a conversation whose whole hash is the hash of a proper prefix of another one is
dropped by an anti-join, and only maximal conversations are rendered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import discard, finished, stash, task_rows

#: Turns that one output row renders at most; longer conversations have several rows.
TURNS_PER_PIECE = 256


def placed_turns(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The turns (conv, turn, role, text) as written in order by tasks, with two hashes of each, and the tasks' runs of each conversation.

    Turns are range-partitioned in the order of (conv, turn, role, text), so a conversation of any length
    spreads over many tasks. A run (conv, _pid, _first, _before) is a task's part of a conversation: the row where it
    starts, and how many turns of the conversation stand before it. This is the only table that holds texts.
    """
    order = ["conv", "turn", "role", "text"]
    parts = [x for c in ("role", "text") for x in (F.col(c).isNull(), F.col(c))]  # a null changes no hash by itself
    hashed = turns.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"_one": F.xxhash64(F.lit(1), *parts), "_two": F.xxhash64(F.lit(2), *parts[2:], *parts[:2])})
    rows = task_rows(hashed)
    before = Window.partitionBy("conv").orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)  # a row for each task
    runs = rows.groupBy("conv", "_pid").agg(F.count("*").alias("_n"), F.min("_row").alias("_first"))
    return rows, stash(runs.select("conv", "_pid", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")))


def place() -> Column:
    """A turn's place in its conversation, from 1, once its run is joined."""
    return F.col("_row") - F.col("_first") + F.col("_before") + 1


def turn_prefixes(rows: DataFrame, runs: DataFrame) -> DataFrame:
    """(conv, place, low, high): the hash of each conversation up to each turn; no texts are read.

    A prefix's hash is the exclusive or of its turns' hashes, each of which includes the turn's place. Each run is
    scanned by itself, and what the runs before it add up to is carried over.
    """
    narrow = rows.select("conv", "_pid", "_row", "_one", "_two").join(runs, ["conv", "_pid"]).withColumn("place", place())
    narrow = stash(narrow.select("conv", "_pid", "place", F.xxhash64(F.lit(3), "place", "_one").alias("_low"), F.xxhash64(F.lit(4), "place", "_two").alias("_high")))
    sums = narrow.groupBy("conv", "_pid").agg(F.bit_xor("_low").alias("_run_low"), F.bit_xor("_high").alias("_run_high"))
    before = Window.partitionBy("conv").orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    carried = stash(sums.select("conv", "_pid", *[F.coalesce(F.bit_xor(f"_run_{c}").over(before), F.lit(0)).alias(f"_carry_{c}") for c in ("low", "high")]))
    inside = Window.partitionBy("conv", "_pid").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    out = narrow.withColumns({f"_in_{c}": F.bit_xor(f"_{c}").over(inside) for c in ("low", "high")}).join(carried, ["conv", "_pid"])
    return out.select("conv", "place", *[F.col(f"_in_{c}").bitwiseXOR(F.col(f"_carry_{c}")).alias(c) for c in ("low", "high")])


def maximal(turns: DataFrame) -> DataFrame:
    """The turns (with place and n_turns) of conversations that no longer one begins with; of equal ones the smallest conv stays.

    Conversations are chosen by their hashes alone; the texts are read once, for those that stay.
    """
    rows, runs = placed_turns(turns)
    prefixes = finished(lambda: turn_prefixes(rows, runs))
    lengths = prefixes.groupBy("conv").agg(F.max("place").alias("n_turns"))
    sized = prefixes.join(lengths, "conv")
    key = ["place", "low", "high"]
    whole = sized.where(F.col("place") == F.col("n_turns")).groupBy(*key).agg(F.min("conv").alias("conv"))
    proper = sized.where(F.col("place") < F.col("n_turns")).select(*key).distinct()
    kept = stash(runs.join(whole.join(proper, key, "left_anti").select("conv", F.col("place").alias("n_turns")), "conv"))
    discard(prefixes)
    return rows.drop("_one", "_two").join(kept, ["conv", "_pid"]).select("conv", "turn", "role", "text", place().alias("place"), "n_turns")


def chatml(role: Column, text: Column) -> Column:
    """One turn in a chat template."""
    return F.concat(F.lit("<|im_start|>"), F.coalesce(role, F.lit("user")), F.lit("\n"), F.coalesce(text, F.lit("")), F.lit("<|im_end|>\n"))


def format_conversations(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", render=chatml) -> DataFrame:
    """(conv, piece, n_pieces, n_turns, rendered) for the maximal conversations.

    Equal rows count once, as logs repeat them. Turns go by turn number (null first), ties by role and text.
    A null role is rendered as user and a null text as empty, but they are not equal to those; rows with a
    null conversation are left out. A conversation that is a proper prefix of another one, or equal to one
    with a smaller id, is dropped. Pieces hold TURNS_PER_PIECE turns, so that no row grows without bound;
    joining a conversation's pieces in order gives its whole text. Other columns are not looked at.
    """
    turns = df.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"))
    turns = turns.where(F.col("conv").isNotNull()).distinct()
    rows = maximal(turns).withColumn("piece", F.floor((F.col("place") - 1) / TURNS_PER_PIECE).cast("int"))
    parts = F.sort_array(F.collect_list(F.struct("place", render(F.col("role"), F.col("text")).alias("shown"))))
    out = rows.groupBy("conv", "piece", "n_turns").agg(parts.alias("parts"))
    rendered = F.array_join(F.transform("parts", lambda p: p["shown"]), "")
    n_pieces = F.ceil(F.col("n_turns") / TURNS_PER_PIECE).cast("int")
    return out.select(F.col("conv").alias(conv), "piece", n_pieces.alias("n_pieces"), "n_turns", rendered.alias("rendered"))
