"""A corpus pipeline: quality rules, near-duplicates, private data, mixing to target weights, packing."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lathework.llm import minhash, mixing, packing, private_data, quality
from lathework.llm.common import discard, finished, stash, word_count
from lathework.llm.queries import MIX_MOST, MIX_SHARE, MIX_WEIGHTS, TOKENIZER

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def numbered(docs: DataFrame) -> DataFrame:
    """A stash of the documents' columns with a number for each row, `_number`, as ids may be null or repeated."""
    return stash(docs.select(*COLUMNS).withColumn("_number", F.monotonically_increasing_id()))


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects.

    Null and empty texts have too few words and go. Texts of any length are judged whole, and a rule's border
    itself passes. Repeated rows get the same verdict and all stay or go; nulls in other columns play no part. All
    stages leave out columns other than those of documents, and give an empty table for an empty one.
    """
    return quality.cascade(docs.select(*COLUMNS), keep_rejected=False).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest id, null last.

    Rows are documents of their own, whatever their ids: repeated rows and equal texts without an id are a
    group as well; of rows that are equal in all columns any one stays. Texts without words are groups of their
    own but for rows of equal id and text. Texts of any length are compared whole.
    """
    docs = numbered(docs)
    groups = minhash.near_duplicates(docs, key="_number").where("n_shingles > 0").select("_number", F.col("component_id").alias("_group"))
    ranks = docs.select("_number", F.struct(F.col("doc_id").isNull(), "doc_id", F.xxhash64(*COLUMNS), "_number").alias("_rank"), "doc_id", F.xxhash64("text").alias("_hash"))
    placed = ranks.join(groups, "_number", "left")
    alone = F.col("_group").isNull()
    by = [F.col("_group"), F.when(alone, F.col("doc_id")), F.when(alone, F.col("_hash"))]
    kept = placed.groupBy(*[c.alias(f"_by{k}") for k, c in enumerate(by)]).agg(F.min("_rank").alias("_rank")).select("_rank._number")
    # Fewer rows go than stay, so the texts are joined with those that go.
    gone = stash(ranks.select("_number").join(stash(kept), "_number", "left_anti"))
    return docs.join(gone, "_number", "left_anti").select(*COLUMNS)


def redact_private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with each span of personal data replaced by its kind.

    Null and empty texts stay as they are, with n_chars null or 0; long texts are scanned whole, repeated rows
    each, and of spans that overlap one replacement is made. The other columns do not change.
    """
    out = private_data.detect_private_data(docs.select(*COLUMNS))
    return out.withColumns({"text": F.col("redacted"), "n_chars": F.length("redacted").cast("long")}).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it. Only sizes are ranked; texts are joined to what was taken.

    Null and empty texts have size 0 and come as often as is certain for their source; a null source is one of its
    own. Rows are sampled one by one, also those that share an id or have none; equal rows have equal odds and are
    told apart at random places only. A very long text is taken whole or not, so a source misses its target by
    half of it at most.
    """
    docs = numbered(docs)
    sizes = docs.select("_number", "doc_id", "source", word_count(F.col("text")).alias("n"), F.xxhash64("text").alias("_hash"))
    # Rows draw by id and text, so that those with a null or repeated id are sampled one by one.
    mixed = mixing.pareto_mix(sizes, F.col("n"), F.col("source"), [F.col("doc_id"), F.col("_hash")], MIX_WEIGHTS, MIX_SHARE, MIX_MOST)
    rows = docs.join(stash(mixed.select("_number", "copies").where("copies > 0")), "_number")
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*COLUMNS)


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in windows of 4096 tokens.

    A null or empty text is the end token alone; a text of any length is cut into whole windows; repeated rows
    are packed each, with their doc_id, which may be null.
    """
    return packing.pack(docs.select("doc_id", "text"), public_tokenizers.path(TOKENIZER), window=4096, end_id=2)


STAGES = [
    ("quality", drop_low_quality),
    ("near_duplicates", drop_near_duplicates),
    ("private_data", redact_private_data),
    ("mixing", mix_sources),
    ("packing", pack_documents),
]

#: Near-duplicate groups and packing have no equivalent in SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result but the last is written in the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        before, docs = docs, finished(lambda stage=stage, docs=docs: stage(spark, docs, sf_dir))
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
