"""Mixing sources to target weights by Pareto order sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import packed, stash, unpacked, with_position

#: Bits of the ranking's bins at each of two levels in which the last document taken is searched; only one bin of the
#: second level, a millionth of a source, is ever sorted.
BITS = 10
#: Inclusion odds within a source grow as a document's size, in whole powers of two, to this power; 0 gives all the same.
TILT = 0.5
#: What the operator adds.
ADDED = ("size", "source_size", "target", "inclusion", "copies")


def source_targets(sizes: DataFrame, weights: list[float], share: float, most: float) -> DataFrame:
    """Adds `target` to a table (source, source_size): share of all sizes, split by weight, none above most * source_size.

    Sources in code-point order, null last, get the weights in turn. What a source cannot take is dealt
    again to the others by weight until none is above its limit; each round is one aggregate, and the
    driver sees two sums.
    """
    ordered = with_position(sizes, [F.col("source").asc_nulls_last()], "_place")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_place") % len(weights) + 1).cast("int"))
    table = stash(ordered.select("source", "source_size", weight.alias("_w"), (F.col("source_size") * F.lit(float(most))).alias("_cap")))
    total = table.agg(F.sum("source_size")).first()[0] or 0
    level, full = 0.0, None
    while True:
        over = F.lit(False) if full is None else (F.col("_w") * F.lit(level) >= F.col("_cap"))
        row = table.agg(F.sum(F.when(over, F.col("_cap")).otherwise(0.0)), F.sum(F.when(over, 0.0).otherwise(F.col("_w"))), F.count_if(over)).first()
        if full is not None and row[2] == full or not row[1]:
            break
        level, full = (share * total - row[0]) / row[1], row[2]
    return table.select("source", "source_size", F.least(F.col("_w") * F.lit(level), F.col("_cap")).alias("target"))


def inclusion_levels(rows: DataFrame, plan: DataFrame, tilt: float) -> DataFrame:
    """Adds `_level` to plan (_of, _rest, ...): a document of size class c has the odds 2 ** (_level + tilt * c).

    The level is the one at which the expected words of a source's sample are its rest. It is found by halving
    an interval over the words in each size class, of which a source has 63 at most.
    """
    classes = rows.where(F.col("size") > 0).groupBy("_source", "_class").agg(F.sum("size").alias("words"))
    classes = classes.groupBy(F.col("_source").alias("_in")).agg(F.collect_list(F.struct("_class", F.col("words").cast("double").alias("words"))).alias("_classes"))
    joined = plan.join(classes, F.col("_of").eqNullSafe(F.col("_in")), "left")

    def halved(at: Column, _: Column) -> Column:
        middle = (at["lo"] + at["hi"]) / 2
        found = F.aggregate("_classes", F.lit(0.0), lambda had, c: had + c["words"] / (1 + F.pow(F.lit(2.0), -(middle + tilt * c["_class"]))))
        few = found < F.col("_rest")
        return F.struct(F.when(few, middle).otherwise(at["lo"]).alias("lo"), F.when(few, at["hi"]).otherwise(middle).alias("hi"))

    level = F.aggregate(F.sequence(F.lit(1), F.lit(60)), F.struct(F.lit(-200.0).alias("lo"), F.lit(200.0).alias("hi")), halved)
    return joined.withColumn("_level", F.when(F.col("_classes").isNotNull(), level["lo"])).drop("_in", "_classes")


def _cut(rows: DataFrame, place: Column, rest: Column, to: str) -> DataFrame:
    """For each source the bin in which its remaining words are met, and the words before it."""
    bins = rows.groupBy("_of", place.alias("_bin")).agg(F.sum("size").alias("_words"), F.max(rest).alias("_left"))
    before = F.coalesce(F.sum("_words").over(Window.partitionBy("_of").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    met = bins.withColumn("_before", before).where((F.col("_before") < F.col("_left")) & (F.col("_before") + F.col("_words") >= F.col("_left")))
    return stash(met.select(F.col("_of").alias(f"{to}_of"), F.col("_bin").alias(f"{to}_bin"), F.col("_before").alias(f"{to}_before")))


def pareto_mix(df: DataFrame, size: Column, source: Column, order: list[Column], weights: list[float], share: float, most: float, seed: int = 29, tilt: float = TILT) -> DataFrame:
    """Adds `size`, `source_size`, `target`, `inclusion` and `copies`: how often the mix repeats each document.

    A source with target t and size s is due t / s copies. The whole part is certain for each of its
    documents. For the rest a document's inclusion odds are p / (1 - p) = level * 2 ** (tilt * c) with c the
    whole part of its size's binary logarithm, so that longer documents are likelier; the source's level makes
    the expected words of the sample the words that remain. Documents rank by U / (1 - U) divided by these
    odds, with U a uniform number drawn from `order`, the seed and the size, and the first ones in that order
    are taken until the remaining words are met as nearly as whole documents allow. A source's size in the
    mix thus misses its target by half a document at most, and p (`inclusion`) is very nearly the frequency
    with which a document gets its additional copy.

    Size null counts as 0, source null is a source of its own, and rows equal in `order` and size are
    interchangeable. Documents of size 0 get the certain copies only (inclusion 0). An empty table gives an
    empty result. Columns size, source_size, target, inclusion and copies are replaced, all others kept whatever
    their names. Reruns give the same
    rows, whatever the partitioning.
    """
    own = unpacked(df, *ADDED)
    by = {f"_by{k}": c for k, c in enumerate(order)}
    draw = F.xxhash64(F.lit(seed), *by, F.col("size"))
    uniform = (F.shiftrightunsigned(draw, 12).cast("double") + 0.5) / float(1 << 52)
    rows = df.select(packed(df, *ADDED), F.coalesce(size, F.lit(0)).cast("long").alias("size"), source.alias("_source"), *[c.alias(n) for n, c in by.items()])
    rows = stash(rows.withColumns({"_u": uniform, "_class": F.length(F.bin("size")) - 1}))
    targets = source_targets(rows.groupBy(F.col("_source").alias("source")).agg(F.sum("size").alias("source_size")), weights, share, most)
    due = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    plan = targets.withColumn("_sure", F.floor(due)).withColumn("_rest", F.col("target") - F.col("_sure") * F.col("source_size"))
    plan = stash(inclusion_levels(rows, plan.withColumnRenamed("source", "_of"), tilt))
    odds = F.when((F.col("_rest") > 0) & (F.col("size") > 0), F.pow(F.lit(2.0), F.col("_level") + tilt * F.col("_class")))
    # The key has no upper bound; x / (1 + x) keeps its order and lies in 0 to 1.
    x = F.col("_u") / (1 - F.col("_u")) / F.col("_odds")
    place = F.when(F.col("_odds").isNotNull(), F.floor(F.col("_key") * (1 << 2 * BITS)).cast("long"))
    ranked = rows.join(plan, F.col("_source").eqNullSafe(F.col("_of"))).withColumn("_odds", odds).withColumn("_key", x / (1 + x)).withColumn("_place", place)

    open_rows = ranked.where(F.col("_odds").isNotNull())
    high = F.shiftright("_place", BITS)
    coarse = _cut(open_rows, high, F.col("_rest"), "_c")
    inside = open_rows.join(coarse, F.col("_of").eqNullSafe(F.col("_c_of")) & (high == F.col("_c_bin")))
    fine = _cut(inside, F.col("_place"), F.col("_rest") - F.col("_c_before"), "_f")
    cut = coarse.join(fine, F.col("_c_of").eqNullSafe(F.col("_f_of")))
    cut = stash(cut.select(F.col("_c_of").alias("_cut_of"), F.col("_f_bin").alias("_cut"), (F.col("_c_before") + F.col("_f_before")).alias("_before")))

    joined = ranked.join(cut, F.col("_source").eqNullSafe(F.col("_cut_of")), "left")
    last = F.coalesce(F.col("_place") == F.col("_cut"), F.lit(False))
    run = F.col("_before") + F.sum("size").over(Window.partitionBy("_of").orderBy("_key", *by, "size").rowsBetween(Window.unboundedPreceding, 0))
    # Taken if that brings the sum nearer to the target than leaving it out.
    at_cut = joined.where(last).withColumn("_extra", 2 * (F.col("_rest") - run) >= -F.col("size"))
    others = joined.where(~last).withColumn("_extra", F.coalesce(F.col("_place") < F.col("_cut"), F.lit(False)))
    out = others.unionByName(at_cut).withColumn("copies", F.col("_sure").cast("long") + F.col("_extra").cast("long"))
    return out.select(*own, "size", "source_size", "target", F.coalesce(F.col("_odds") / (1 + F.col("_odds")), F.lit(0.0)).alias("inclusion"), "copies")
