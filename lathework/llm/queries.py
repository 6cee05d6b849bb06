"""The queries of this subpackage: each applies one operator, with its production parameters, to a whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, conversations, divergence, html_text, lattice, minhash, mixing, packing, private_data, quality, secret_scan, sharding, token_counts
from .common import word_count

#: Production parameters.
TOKENIZER = "word_bpe_49k.json"
TOKENIZER_A, TOKENIZER_B = "byte_bpe_50k.json", "piece_bpe_32k.model"
SHARDS = 40
MIX_WEIGHTS = [5.0, 2.0, 1.0]
MIX_SHARE, MIX_MOST = 1.5, 2.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    raw = F.encode(F.coalesce("text", F.lit("")), "utf-8")
    rows = docs.select("doc_id", (F.octet_length(raw).cast("long") + 16).alias("size"), F.crc32(raw).alias("text_crc32"))
    out = sharding.shard_rows(rows, SHARDS)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = conversations.format_conversations(table(spark, sf_dir, "conversations"))
    return out.withColumn("n_chars", F.length("rendered").cast("long"))


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    report = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    out = quality.cascade(docs, report=report, keep_text=False)
    return out.select("doc_id", *report, "base_failed", "kept")  # which rule was first to reject depends on the costs measured


def op5_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.near_vectors(table(spark, sf_dir, "embeddings"), least=0.95)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.count_tokens(docs, public_tokenizers.path(TOKENIZER), limit=2048, keep_text=False)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", word_count(F.col("text")).alias("n"))
    out = mixing.pareto_mix(docs, F.col("n"), F.col("source"), [F.col("doc_id")], MIX_WEIGHTS, MIX_SHARE, MIX_MOST)
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source", "inclusion", "copies")


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack(docs, public_tokenizers.path(TOKENIZER), window=4096, end_id=2)


def op10_private_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = private_data.detect_private_data(docs, keep_text=False)
    counts = [private_data.count_of(F.col("pii"), k.name).alias(f"n_{k.name}") for k in private_data.BASE]
    return out.select("doc_id", *counts, private_data.base_digest(F.col("pii")).alias("base_sha256"), private_data.written(F.col("pii")).alias("spans"), F.size("pii").cast("long").alias("n_spans"), private_data.count_of(F.col("pii"), "secret").alias("n_secret"))


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence_audit(table(spark, sf_dir, "documents"))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    aligned = alignment.align_tokens(docs, public_tokenizers.path(TOKENIZER_A), public_tokenizers.path(TOKENIZER_B), keep_text=False, keep_groups=False, derive=alignment.summarized, derived=alignment.SUMMARY)
    return alignment.score_links(aligned).withColumnRenamed("written_sha256", "groups_sha256")


def op13_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = secret_scan.scan_secrets(docs, keep_text=False)
    spans = F.col("secrets")
    counts = [private_data.count_of(spans, k).alias(f"n_{k}") for k in secret_scan.BASE]
    return out.select("doc_id", *counts, secret_scan.base_digest(spans).alias("base_sha256"), secret_scan.written(spans).alias("spans"), F.size(spans).cast("long").alias("n_spans"))


QUERIES = {f.__name__: f for f in (op1_sharding, op2_conversations, op3_html_text, op4_quality, op5_lattice, op6_token_counts, op7_mixing, op8_minhash, op9_packing, op10_private_data, op11_divergence, op12_alignment, op13_secrets)}
ORACLES = {
    "op2_conversations": """
WITH turns AS (
  SELECT DISTINCT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS place,
    count(*) OVER (PARTITION BY conv_id) AS n_turns
  FROM turns
), prefixes AS (
  SELECT conv_id, place, n_turns, list(struct_pack(r := role, t := text)) OVER (PARTITION BY conv_id ORDER BY place) AS prefix FROM placed
), whole AS (
  SELECT min(conv_id) AS conv_id, prefix FROM prefixes WHERE place = n_turns GROUP BY prefix
), kept AS (
  SELECT conv_id FROM whole WHERE NOT EXISTS (SELECT 1 FROM prefixes p WHERE p.place < p.n_turns AND p.prefix = whole.prefix)
), pieces AS (
  SELECT conv_id, ((place - 1) // 256)::INT AS piece, any_value(ceil(n_turns / 256.0)::INT) AS n_pieces, any_value(n_turns) AS n_turns,
    string_agg('<|im_start|>' || coalesce(role, 'user') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10), '' ORDER BY place) AS rendered
  FROM placed SEMI JOIN kept USING (conv_id) GROUP BY ALL
)
SELECT conv_id, piece, n_pieces, n_turns, rendered, length(rendered) AS n_chars FROM pieces
""",
    # All rules decide together, so the verdict is the same in any order of the cascade.
    "op4_quality": r"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
split AS (
  SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM texts
), windows AS (
  SELECT doc_id, k, w[k:k + 2] AS key FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS k FROM split)
), marked AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (
    SELECT doc_id, unnest([k, k + 1, k + 2]) AS p FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, key) AS found FROM windows) WHERE found > 1
  ) GROUP BY doc_id
), counted AS (
  SELECT doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
    length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
    coalesce(marked.n, 0) AS n_repeat_words, len(lines) AS n_lines,
    len(list_filter(w, lambda x: length(x) > 1 AND upper(x) = x AND lower(x) <> x)) AS n_shouted
  FROM split LEFT JOIN marked USING (doc_id)
), judged AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counted
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 10 * n_symbols > n_words OR word_chars < 2 * n_words OR word_chars > 12 * n_words
    OR (n_dup_lines >= 3 AND 10 * n_dup_lines > 3 * n_lines) OR 2 * n_shouted > n_words) AS kept FROM judged
""",
    # Every pair of vectors is compared, without hashing.
    "op5_lattice": r"""
WITH RECURSIVE given AS (
  SELECT vec_id, CASE WHEN len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
    THEN embedding::DOUBLE[] END AS v FROM embeddings
), links AS (
  SELECT x.vec_id AS a, y.vec_id AS b FROM given x JOIN given y ON x.vec_id <> y.vec_id AND len(x.v) = len(y.v) AND list_cosine_similarity(x.v, y.v) >= 0.95
), reached AS (
  SELECT vec_id AS a, vec_id AS b FROM given UNION SELECT reached.a, links.b FROM reached JOIN links ON links.a = reached.b
)
SELECT vec_id, (SELECT count(*) FROM links WHERE links.a = vec_id)::BIGINT AS n_links, min(b) AS component_id, vec_id = min(b) AS kept FROM reached JOIN given ON given.vec_id = reached.a GROUP BY vec_id
""",
    # Shingle sets are joined on the shingles themselves.
    "op8_minhash": r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda k: array_to_string(w[k:k + 4], ' '))) AS shingle FROM words WHERE len(w) > 0
), sized AS (
  SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id
), shared AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n_both FROM sets x JOIN sets y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM shared JOIN sized p ON p.doc_id = a JOIN sized q ON q.doc_id = b WHERE 100 * n_both >= 75 * (p.n + q.n - n_both)
), reached AS (
  SELECT doc_id AS a, doc_id AS b FROM words UNION SELECT reached.a, links.b FROM reached JOIN links ON links.a = reached.b
)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept
FROM words LEFT JOIN sized USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reached GROUP BY a) USING (doc_id)
""",
    # Every pair and every term are compared, without an index.
    "op11_divergence": r"""
WITH docs AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS k,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents),
tokens AS (SELECT lang, source, k, unnest(t) AS term FROM docs),
kept AS (SELECT lang, term FROM tokens GROUP BY ALL HAVING count(DISTINCT k) >= 30),
groups AS (SELECT DISTINCT lang, source FROM docs),
cells AS (SELECT g.lang, g.source, kept.term FROM groups g JOIN kept USING (lang)),
counts AS (SELECT cells.*, coalesce(n, 0) AS n FROM cells LEFT JOIN (SELECT lang, source, term, count(*) AS n FROM tokens GROUP BY ALL) USING (lang, source, term)),
p AS (SELECT *, (1 + 1000000000::HUGEINT * (n + 5) // (sum(n) OVER g + 5 * count(*) OVER g))::BIGINT AS p FROM counts WINDOW g AS (PARTITION BY lang, source)),
q AS (SELECT lang, term, (1 + 1000000000::HUGEINT * (n + 5) // (sum(n) OVER g + 5 * count(*) OVER g))::BIGINT AS q FROM (SELECT lang, term, sum(n) AS n FROM counts GROUP BY ALL) WINDOW g AS (PARTITION BY lang)),
pairs AS (SELECT g.lang, g.source, 'pair' AS part, o.source AS item, coalesce(d.value, 0)::BIGINT AS value FROM groups g JOIN groups o ON o.lang = g.lang AND o.source <> g.source
  LEFT JOIN (SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p)) AS value FROM p x JOIN p y USING (lang, term) GROUP BY ALL) d ON d.lang = g.lang AND d.source = g.source AND d.item = o.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, p - q AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item))::INT AS rank FROM (FROM pairs UNION ALL FROM terms)) WHERE part = 'pair' OR rank <= 50
""",
}
