"""Output folders and names that overwrite nothing."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window
from pyspark.sql.types import NumericType

from ..functions.paths import parent
from ..sources.stash import stash

#: A base has itself and so many numbered names; rows beyond that fail.
MOST = 9999
#: Groups of names that can meet are dealt to so many steps.
STEPS = 4096


def output_folder(path: Column, folder: str | None = None) -> Column:
    """The chosen folder, else the one the input lies in."""
    return F.coalesce(F.lit(folder), parent(path))


def _greedy(rows: Iterator[tuple[str, bool]]) -> Iterator[str | None]:
    """The first free name for each base in order; a base that exists already only takes its name."""
    taken: set[str] = set()
    start: dict[str, int] = {}
    for base, exists in rows:
        if exists:
            taken.add(base)
            yield None
            continue
        k = start.get(base, 0)
        while k <= MOST and (name := f"{base}-{k}" if k else base) in taken:
            k += 1
        start[base] = k
        if k > MOST:
            yield None
        else:
            taken.add(name)
            yield name


def assign_names(df: DataFrame, folder: str = "out_dir", base: str = "base", extension: str = "out_ext", order: str = "idx", existing: DataFrame | None = None) -> DataFrame:
    """Adds `out_name` (with the extension) to each row; null where MOST numbered names are taken.

    Rows take the first free name of `base`, `base-1`, `base-2`, ... in the order of `order`, within
    their folder and extension. existing: (folder, base, extension) of files that are there already.
    Nulls in the three columns count as empty.

    A row can only lose its name to a repeated or existing base from which numbers lead to it over bases that
    are there: with two rows `scan`, one of them may take `scan-1`, which pushes a row `scan-1` on to
    `scan-1-1`, but not `scan-7-1` unless there is a base `scan-7`, nor a number beyond MOST. Rows that no such
    base leads to keep their names, and a repeated base that leads to no other numbers its rows by rank; both
    are plain columns. Only the rest is numbered one after the other, a group for each base that others are
    reached from; many groups make a step of a task. No base has more than MOST + 1 rows that can get a name;
    those are found by a ranked limit that works before the shuffle, so a name that a third of all rows share
    does not come to one task.
    """
    where = [F.coalesce(F.col(c), F.lit("")) for c in (folder, base, extension)]
    # Read several times below, and narrow: written once, so that what df is made of is not made again each time. Rows
    # get numbers of their own, as `order` may repeat or be null; the caller's columns are packed, so no name clashes.
    packed = stash(df.select(F.monotonically_increasing_id().alias("_num"), F.struct("*").alias("_row"), F.col(order).alias("_idx"), *[w.alias(n) for w, n in zip(where, ("_dir", "_base", "_ext"), strict=True)]))
    key = ["_dir", "_base", "_ext"]
    rows = packed.select("_num", "_idx", *key)
    rank = F.row_number().over(Window.partitionBy(*key).orderBy("_idx", "_num"))
    able = rows.withColumn("_rank", rank).where(F.col("_rank") <= MOST + 1).withColumn("_there", F.lit(False))
    if existing is not None:
        there = existing.select(*[F.coalesce(F.col(c), F.lit("")).alias(n) for c, n in zip((folder, base, extension), key, strict=True)])
        # Not made distinct: a union of two sides that are hashed by the same keys loses that partitioning's promise in Spark 4.1.
        able = able.unionByName(there.select(F.lit(0).cast("long").alias("_num"), _filler(df, order).alias("_idx"), *key, F.lit(0).alias("_rank"), F.lit(True).alias("_there")))

    # The bases a number further up each time, as long as they are there; the topmost crowded one of them is the root.
    bases = able.groupBy(*key).agg((F.count_if(~F.col("_there")) + F.max("_there").cast("int")).alias("_n"), F.max("_there").alias("_taken"))
    tail = F.regexp_extract("_base", r"((?:-[1-9][0-9]{0,3})+)$", 1)
    numbers = F.split(F.substr(tail, F.lit(2)), "-")
    stem = F.expr("left(_base, length(_base) - length(_tail))")
    chained = bases.withColumn("_tail", tail).withColumn("_stem", stem).withColumn("_numbers", F.when(tail != "", numbers))
    up = F.transform(F.sequence(F.lit(1), F.size("_numbers")), lambda k: F.struct(k.alias("k"), F.array_join(F.concat(F.array("_stem"), F.slice("_numbers", F.lit(1), F.size("_numbers") - k)), "-").alias("base")))
    above = chained.where(F.col("_numbers").isNotNull()).select(*key, F.explode(up).alias("_up")).select(*key, "_up.*")
    known = bases.select("_dir", F.col("_base").alias("base"), "_ext", F.col("_n").alias("n"))
    chains = above.join(known, ["_dir", "base", "_ext"], "left").groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("k", "base", F.coalesce("n", F.lit(0)).alias("n")))).alias("_chain"))  # one entry for each number in a name

    def climb(at: Column, x: Column) -> Column:
        going = at["going"] & (x["n"] > 0)
        return F.struct(going.alias("going"), F.when(going & (x["n"] > 1), x["base"]).otherwise(at["root"]).alias("root"))

    top = F.aggregate("_chain", F.struct(F.lit(True).alias("going"), F.lit(None).cast("string").alias("root")), climb)["root"]
    roots = bases.join(chains, key, "left").select(*key, "_n", "_taken", F.coalesce(top, F.when(F.col("_n") > 1, F.col("_base"))).alias("_root"))
    group = ["_dir", "_root", "_ext"]
    crowds = roots.where(F.col("_root").isNotNull()).groupBy(*group).agg(F.count("*").alias("_bases"))
    placed = stash(able.join(roots, key).join(crowds, group, "left"))

    index = F.col("_rank") - 1 + F.col("_taken").cast("int")
    numbered = F.when(index == 0, F.col("_base")).when(index <= MOST, F.concat_ws("-", "_base", index.cast("string")))
    alone = placed.where(~F.col("_there") & (F.coalesce("_bases", F.lit(1)) == 1)).select("_num", F.when(F.col("_root").isNull(), F.col("_base")).otherwise(numbered).alias("_name"))

    def number(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, rows in pdf.groupby(group, sort=False):
            rows = rows.sort_values(["_there", "_idx", "_num"], ascending=[False, True, True], na_position="first")
            rows["_name"] = list(_greedy(zip(rows["_base"], rows["_there"], strict=True)))
            out.append(rows.loc[~rows["_there"], ["_num", "_name"]])
        return pd.concat(out)

    busy = placed.where(F.col("_bases") > 1).select("_num", "_idx", *key, "_root", "_there", F.pmod(F.xxhash64(*group), F.lit(STEPS)).alias("_step"))
    named = busy.groupBy("_step").applyInPandas(number, "_num long, _name string").unionByName(alone)
    full = _with_extension(F.col("_name"), F.col("_ext"))
    return packed.join(named, "_num", "left").select("_row.*", full.alias("out_name"))


def _filler(df: DataFrame, order: str) -> Column:
    """A value of the order's type where it plays no part; numbers without nulls stay whole numbers in pandas."""
    kind = df.schema[order].dataType
    return F.lit(0 if isinstance(kind, NumericType) else None).cast(kind)


def _with_extension(name: Column, extension: Column) -> Column:
    return F.concat(name, F.when(extension != "", F.concat(F.lit("."), extension)).otherwise(""))


def _ancestors(base: Column) -> Column:
    """A base and what it is without its last number, its last two, and so on."""
    tail = F.regexp_extract(base, _NUMBERS, 1)
    sizes = F.transform(F.regexp_extract_all(tail, F.lit("-[0-9]+"), F.lit(0)), F.length)
    cuts = F.transform(sizes, lambda _, k: F.aggregate(F.slice(F.reverse(sizes), F.lit(1), k + 1), F.lit(0), lambda a, n: a + n))
    return F.concat(F.array(base), F.transform(cuts, lambda n: F.substring(base, F.lit(1), F.length(base) - n)))


_NUMBERS = r"((?:-[1-9][0-9]{0,3})+)$"


def _refill(events: Iterator[tuple[str, str]]) -> Iterator[str | None]:
    """Events in order: `taken` name, `free` name, `take` base. For each take the first free name, for the others null."""
    taken: set[str] = set()
    low: dict[str, int] = {}  # all lower numbers of a base are taken
    for what, name in events:
        if what == "taken":
            taken.add(name)
        elif what == "free":
            taken.discard(name)
            low.pop(name, None)
            low.pop(re.sub(r"-[1-9][0-9]{0,3}$", "", name), None)
        else:
            k = low.get(name, 0)
            while k <= MOST and (found := f"{name}-{k}" if k else name) in taken:
                k += 1
            low[name] = k
            if k <= MOST:
                taken.add(found)
                yield found
                continue
        yield None


def fallback_names(df: DataFrame, kept: str = "kept_original", folder: str = "out_dir", base: str = "base", own_ext: str = "ext", planned: str = "out_name", order: str = "idx", existing: DataFrame | None = None, extension: str = "out_ext") -> DataFrame:
    """Replaces `planned` (a name with `extension`) for the rows whose original is kept: their bytes go under an extension of their own, `own_ext`.

    In the order of `order` each kept row gives its planned name back and takes the first of `base`, `base-1`, ... with
    its own extension that is free: neither a file that is there (existing, as for assign_names), nor a planned
    name that was not given back yet, nor taken by a kept row before. Null where MOST numbered names are taken. Rows
    that are not kept (or null), or have no planned name, stay as they are. Rows equal in `order` go one after the
    other; a null order comes first, null folders, bases and extensions count as empty.

    A name given back matters to its own folder and extension only, so these are apart from each other. There, a kept
    row takes its base itself unless that base, or one that numbers lead on to it from, is taken or wanted twice; all
    such rows are plain columns. Only the rest goes through a loop, with the names that it can meet, a group for each
    base without its numbers.
    """
    text = {c: F.coalesce(F.col(c), F.lit("")) for c in (folder, base, own_ext, extension)}
    packed = stash(df.select(F.monotonically_increasing_id().alias("num"), F.struct("*").alias("row"), F.col(order).alias("idx"), text[folder].alias("dir"), text[base].alias("base"), text[own_ext].alias("own"), text[extension].alias("ext"), F.col(planned).alias("planned"), (F.coalesce(F.col(kept), F.lit(False)) & F.col(planned).isNotNull()).alias("kept")))
    name = F.expr("left(planned, length(planned) - if(ext = '', 0, 1 + length(ext)))")
    rows = packed.select("num", "idx", "dir", "base", "own", "ext", "kept", "planned").withColumn("name", name)
    stays = (F.col("own") == F.col("ext")) & (F.col("name") == F.col("base"))  # gives its name back and takes it again
    takes = rows.where(F.col("kept") & ~stays).select("num", "idx", "dir", F.col("own").alias("ext"), "base")
    taken = rows.where(F.col("planned").isNotNull()).select("dir", "ext", "name")
    if existing is not None:
        there = existing.select(*[F.coalesce(F.col(c), F.lit("")).alias(n) for c, n in zip((folder, base, extension), ("dir", "name", "ext"), strict=True)])
        taken = taken.unionByName(there)
    taken = taken.distinct()
    freed = rows.where(F.col("kept") & ~stays).select("num", "idx", "dir", "ext", "name")

    space = ["dir", "ext"]
    wanted = takes.groupBy(*space, "base").agg(F.count("*").alias("n")).join(taken.withColumnRenamed("name", "base").withColumn("there", F.lit(True)), [*space, "base"], "left")
    crowded = wanted.where((F.col("n") > 1) | F.col("there")).select(*space, F.col("base").alias("above"))
    reached = takes.select(*space, "base").distinct().select(*space, "base", F.explode(_ancestors(F.col("base"))).alias("above"))
    busy = stash(reached.join(crowded, [*space, "above"], "left_semi").select(*space, "base").distinct())
    alone = takes.join(busy, [*space, "base"], "left_anti").select("num", F.col("base").alias("name"))

    def of_busy(names: DataFrame) -> DataFrame:
        """Names that a busy base may take: the base, or the base and a number."""
        near = names.withColumn("near", F.explode(F.array_distinct(F.slice(_ancestors(F.col("name")), 1, 2))))
        return near.join(busy.withColumnRenamed("base", "near"), [*space, "near"], "left_semi").drop("near").distinct()

    events = of_busy(taken).select(F.lit(0).cast("long").alias("num"), _filler(df, order).alias("idx"), *space, "name", F.lit(0).alias("what"))
    events = events.unionByName(of_busy(freed).select("num", "idx", *space, "name", F.lit(1).alias("what")))
    events = events.unionByName(takes.join(busy, [*space, "base"], "left_semi").select("num", "idx", *space, F.col("base").alias("name"), F.lit(2).alias("what")))
    stem = F.regexp_replace("name", _NUMBERS, "")
    group = ["dir", "ext", "stem"]
    # What is taken comes first, then the rows in order, each giving back before it takes.
    events = events.withColumns({"stem": stem, "late": F.col("what") > 0}).withColumn("step", F.pmod(F.xxhash64(*group), F.lit(STEPS)))

    def refill(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, g in pdf.groupby(group, sort=False):
            g = g.sort_values(["late", "idx", "num", "what"], na_position="first")
            g["name"] = list(_refill(zip(g["what"].map({0: "taken", 1: "free", 2: "take"}), g["name"], strict=True)))
            out.append(g.loc[g["what"] == 2, ["num", "name"]])
        return pd.concat(out)

    found = events.groupBy("step").applyInPandas(refill, "num long, name string").unionByName(alone).withColumn("taken", F.lit(True))
    final = F.when(F.col("taken"), _with_extension(F.col("name"), F.col("own"))).otherwise(F.col("planned"))
    out = packed.join(found, "num", "left").select("row", final.alias("final"))
    return out.select(*[F.col("final").alias(c) if c == planned else F.col("row").getField(c).alias(c) for c in df.columns])
