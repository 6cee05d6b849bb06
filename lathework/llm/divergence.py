"""How far the sources of each language differ in their use of terms.

Probabilities are whole numbers of billionths with five occurrences added to each term, so all sums are exact. The
divergence of two sources is a sum over all kept terms of a language, most of which a source does not use. So a pair
starts at V times its difference at a count of zero, and an inverted index of term postings only emits corrections:

* one source uses a term, the other is taken not to: these depend on the count alone, so the terms of a source that
  are used equally often give one correction together;
* both use it: a posting meets the other postings of its term, and what the two corrections above got wrong is added.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded, slices, stash, words_of

#: A term is a run of ASCII letters, A-Z in lower case, and of all signs beyond ASCII; in UTF-8 the bytes of
#: a term map to themselves or to lower case, and all others to a space.
TERM_BYTES = bytes(ord(chr(b).lower()) if chr(b).isalpha() else 32 for b in range(128)) + bytes(range(128, 256))
#: Bytes of text whose terms are counted at once.
COUNTED_BYTES = 4 << 20
COUNTS = "lang string, source string, term string, n long, docs long"
#: Occurrences added to each term, and what a probability of one is written as.
ADDED, ONE = 5, 1_000_000_000


def probability(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(ONE * (count + ADDED) / (total + ADDED * terms)) without rounding; 0 where there are no terms."""
    whole = (count + ADDED).cast("decimal(20,0)") * F.lit(ONE).cast("decimal(10,0)")
    share = F.call_function("div", whole, (total + ADDED * terms).cast("decimal(20,0)"))
    return F.when(terms > 0, share + 1).otherwise(F.lit(0)).cast("long")


def terms_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All terms of the texts in order, and where each text's terms start (one more entry than texts)."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    ends = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = bytes(memoryview(texts.buffers()[2] or b"")[ends[0] : ends[-1]]).translate(TERM_BYTES)
    return words_of(pa.Array.from_buffers(pa.large_string(), len(texts), [None, pa.py_buffer(ends - ends[0]), pa.py_buffer(data)]))


def _counted(part: pa.RecordBatch) -> pa.RecordBatch:
    """Columns COUNTS of rows (lang, source, text)."""
    words, starts = terms_of(part.column("text"))
    words = words.dictionary_encode()
    known = max(1, len(words.dictionary))
    sides = [part.column(c).dictionary_encode() for c in ("lang", "source")]
    lang, source = (np.asarray(s.indices, dtype=np.int64) for s in sides)
    width = max(1, len(sides[1].dictionary))
    doc = np.repeat(np.arange(part.num_rows), np.diff(starts))
    held, n = np.unique(doc * known + np.asarray(words.indices, dtype=np.int64), return_counts=True)
    row = held // known
    cells, which = np.unique((lang[row] * width + source[row]) * known + held % known, return_inverse=True)
    group, term = cells // known, cells % known
    columns = [sides[0].dictionary.take(pa.array(group // width)), sides[1].dictionary.take(pa.array(group % width)), words.dictionary.take(pa.array(term)).cast(pa.string())]
    return pa.RecordBatch.from_arrays([*columns, *(pa.array(np.bincount(which, w, len(cells)).astype(np.int64)) for w in (n, None))], names=["lang", "source", "term", "n", "docs"])


def term_counts(df: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, term, n, docs): occurrences of each term in each group, and the documents that hold it.

    Counted for some MB of text at a time, then in each task, before the shuffle.
    """
    rows = df.select(F.coalesce(F.col(lang), F.lit("")).alias("lang"), F.coalesce(F.col(source), F.lit("")).alias("source"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", COUNTED_BYTES):
                yield _counted(part)

    return bounded(rows).mapInArrow(run, COUNTS).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def divergence_audit(df: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least_docs: int = 30, top: int = 50) -> DataFrame:
    """(lang, source, part, item, value, rank): for each group (lang, source), how it differs from the rest of its language.

    Part `pair`: each other source of the language, by the summed difference of all kept terms' probabilities. Part
    `term`: the `top` terms that the group uses more than its language does, by the difference. Kept terms are those
    in at least `least_docs` documents of their language. Ranks go from 1 by value, largest first, then by the item's
    bytes, so ties have one order.

    Null texts, languages and sources count as empty; a group without terms is compared all the same; a language
    without kept terms has pairs of value 0 and no terms; repeated rows count each; no other column of df is read.
    An empty table gives no rows. Nothing grows with a group's documents but counts: a source that holds a third of
    all rows is one posting a term, like any other, and ranks are cut before their shuffle.
    """
    counts = stash(term_counts(df, text, lang, source))
    same = Window.partitionBy("lang", "term")
    totals = {"lang_docs": F.sum("docs").over(same), "lang_n": F.sum("n").over(same), "head": F.row_number().over(same.orderBy("source")) == 1}
    index = stash(counts.withColumns(totals).where(F.col("lang_docs") >= least_docs).drop("docs", "lang_docs"))

    used = index.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count_if("head").alias("heads"))
    whole = used.groupBy("lang").agg(F.sum("total").alias("lang_total"), F.sum("heads").alias("terms"))
    groups = df.select(F.coalesce(F.col(lang), F.lit("")).alias("lang"), F.coalesce(F.col(source), F.lit("")).alias("source")).distinct()
    zero = F.lit(0).cast("long")
    groups = groups.join(used.drop("heads"), ["lang", "source"], "left").join(whole, "lang", "left").select("lang", "source", *[F.coalesce(c, zero).alias(c) for c in ("total", "lang_total", "terms")])
    groups = stash(groups.withColumn("p0", probability(zero, F.col("total"), F.col("terms"))))

    posting = index.join(groups, ["lang", "source"]).withColumn("p", probability(F.col("n"), F.col("total"), F.col("terms")))
    return _pairs(posting, groups).unionByName(_terms(posting, top))


def _pairs(posting: DataFrame, groups: DataFrame) -> DataFrame:
    """The ranked part `pair`. Each two sources are summed once, the smaller one as a, the other as b."""
    low, high = groups.select("lang", F.col("source").alias("a"), F.col("p0").alias("a0"), "terms"), groups.select("lang", F.col("source").alias("b"), F.col("p0").alias("b0"))
    start = low.join(high, "lang").where(F.col("a") < F.col("b")).select("lang", "a", "b", (F.col("terms") * F.abs(F.col("a0") - F.col("b0"))).alias("d"))

    # One uses a term: by the source and the count, of which there are few.
    alike = posting.groupBy("lang", "source", "p", "p0").agg(F.count("*").alias("m"))
    other = groups.select("lang", F.col("source").alias("other"), F.col("p0").alias("other0"))
    change = F.abs(F.col("p") - F.col("other0")) - F.abs(F.col("p0") - F.col("other0"))
    single = alike.join(other, "lang").where((F.col("source") != F.col("other")) & (change != 0)).select("lang", F.least("source", "other").alias("a"), F.greatest("source", "other").alias("b"), (F.col("m") * change).alias("d"))

    # Both use it: the postings of a term meet.
    x = posting.select("lang", "term", F.col("source").alias("a"), F.col("p").alias("pa"), F.col("p0").alias("a0"))
    y = posting.select("lang", "term", F.col("source").alias("b"), F.col("p").alias("pb"), F.col("p0").alias("b0"))
    rest = F.abs(F.col("pa") - F.col("pb")) - F.abs(F.col("pa") - F.col("b0")) - F.abs(F.col("a0") - F.col("pb")) + F.abs(F.col("a0") - F.col("b0"))
    double = x.join(y, ["lang", "term"]).where((F.col("a") < F.col("b")) & (rest != 0)).select("lang", "a", "b", rest.alias("d"))

    summed = start.unionByName(single).unionByName(double).groupBy("lang", "a", "b").agg(F.sum("d").alias("value"))
    sides = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    both = summed.select("lang", "value", sides.alias("side")).select("lang", "side.source", F.lit("pair").alias("part"), "side.item", "value")
    return both.withColumn("rank", _rank())


def _terms(posting: DataFrame, top: int) -> DataFrame:
    """The ranked part `term`."""
    more = F.col("p") - probability(F.col("lang_n"), F.col("lang_total"), F.col("terms"))
    ranked = posting.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), more.alias("value")).where("value > 0")
    return ranked.withColumn("rank", _rank()).where(F.col("rank") <= top)


def _rank() -> Column:
    return F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")).cast("int")
