"""Registered queries over the given tables, with their SQL.

The tables hold no images or documents to unlock, so columns of theirs stand in for file names, sizes and
dimensions; each query says which.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import formats, paths, resize, sizes, texts
from ..operators import batch, naming, release
from ..sources import intake


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


# Resize: part, with p_size * 80 as the width and floor(p_retailprice) as the height.
_RULES = {
    "resize_fit": (resize.Resize("fit", 1000, 1000), False, "least(1000 / w, 1000 / h, 1.0::DOUBLE)"),
    "resize_fit_upscale": (resize.Resize("fit", 8000, 8000), True, "least(8000 / w, 8000 / h)"),
    "resize_fit_width_only": (resize.Resize("fit", 2000, None), False, "least(2000 / w, 1.0::DOUBLE)"),
    "resize_longest_side": (resize.Resize("longest", amount=1500), False, "least(1500 / greatest(w, h), 1.0::DOUBLE)"),
    "resize_percent": (resize.Resize("percent", amount=50), False, "0.5::DOUBLE"),
    "resize_exact": (resize.Resize("exact", 800, 900), False, None),
    "resize_none": (resize.Resize(), False, "1.0::DOUBLE"),
}


def _resized(rule: resize.Resize, upscale: bool) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        width, height = F.col("p_size") * 80, F.floor("p_retailprice")
        target = resize.target_size(rule, width, height, upscale)
        return table(spark, sf_dir, "part").select("p_partkey", target.alias("target")).select("p_partkey", F.col("target.width").alias("width"), F.col("target.height").alias("height"))

    return run


for _name, (_rule, _upscale, _scale) in _RULES.items():
    QUERIES[_name] = _resized(_rule, _upscale)
    _size = ("w * s", "h * s") if _scale else ("800", "900")
    ORACLES[_name] = f"""
WITH sized AS (SELECT p_partkey, (p_size * 80)::DOUBLE AS w, floor(p_retailprice)::DOUBLE AS h FROM part),
scaled AS (SELECT *, {_scale or "1.0::DOUBLE"} AS s FROM sized),
made AS (SELECT *, greatest(1, round({_size[0]}))::DOUBLE AS x, greatest(1, round({_size[1]}))::DOUBLE AS y FROM scaled)
SELECT p_partkey, CASE WHEN w > 0 AND h > 0 AND NOT (x = w AND y = h) THEN x END AS width,
  CASE WHEN w > 0 AND h > 0 AND NOT (x = w AND y = h) THEN y END AS height FROM made
"""


# Sizes: documents, with the text's bytes as the original and its bytes with white space collapsed as the new file.
_SIZED = "SELECT doc_id, coalesce(strlen(text), 0)::BIGINT AS original, coalesce(strlen(regexp_replace(text, '[ \\t\\n\\r]+', ' ', 'g')), 0)::BIGINT AS new FROM documents"


def _sized(spark: SparkSession, sf_dir: str) -> DataFrame:
    short = F.regexp_replace("text", r"[ \t\n\r]+", " ")
    return table(spark, sf_dir, "documents").select("doc_id", intake.file_size(F.octet_length("text")).alias("original"), intake.file_size(F.octet_length(short)).alias("new"))


_LABEL = """CASE WHEN {n} = 1 THEN '1 byte' WHEN {n} < 1000 THEN {n} || ' bytes' WHEN {n} < 1000000 THEN (({n} + 500) // 1000) || ' KB'
 WHEN {n} < 1000000000 THEN (({n} + 50000) // 100000 // 10) || '.' || (({n} + 50000) // 100000 % 10) || ' MB'
 ELSE (({n} + 5000000) // 10000000 // 100) || '.' || lpad((({n} + 5000000) // 10000000 % 100)::VARCHAR, 2, '0') || ' GB' END"""


@query(f"SELECT doc_id, original, new, original > 0 AND new >= original AS kept_original, CASE WHEN original > 0 AND new >= original THEN original ELSE new END AS final FROM ({_SIZED})")
def size_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = sizes.keeps_original(F.col("original"), F.col("new"), F.lit(False))
    return _sized(spark, sf_dir).select("doc_id", "original", "new", kept.alias("kept_original"), F.when(kept, F.col("original")).otherwise(F.col("new")).alias("final"))


@query(f"SELECT doc_id, CASE WHEN original > 0 THEN (original - new)::DOUBLE / original ELSE 0 END AS saved FROM ({_SIZED})")
def saved_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sized(spark, sf_dir).select("doc_id", sizes.saved_fraction(F.col("original"), F.col("new")).alias("saved"))


_SAVINGS = f"""(SELECT *, CASE WHEN NOT (original > 0 AND new > 0) THEN base WHEN p = 0 THEN base || ' (about the same)'
  ELSE base || ' (' || p || CASE WHEN new < original THEN '% smaller)' ELSE '% larger)' END END AS label
FROM (SELECT *, {_LABEL.format(n="original")} || ' → ' || {_LABEL.format(n="new")} AS base,
  CASE WHEN original > 0 THEN abs(round((original - new)::DOUBLE / original * 100))::BIGINT END AS p FROM ({_SIZED})))"""


@query(f"SELECT doc_id, label FROM {_SAVINGS}")
def size_savings_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sized(spark, sf_dir).select("doc_id", sizes.savings_label(F.col("original"), F.col("new")).alias("label"))


@query(
    f"""SELECT doc_id, doc_id || '.png · ' || label AS convert,
  CASE WHEN original > 0 AND new >= original THEN 'Already optimal — copied unchanged (' || {_LABEL.format(n="original")} || ')' ELSE label END AS compress,
  original || '×' || (original + 1) || ' → ' || new || '×' || (new + 1) || ' px · ' || label AS resize,
  'Unlocked · ' || new || CASE WHEN new = 1 THEN ' page' ELSE ' pages' END || ' → ' || doc_id || '.pdf' AS unlock FROM {_SAVINGS}"""
)
def detail_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The detail line of each tool; sizes stand for dimensions and pages too."""
    old, new, key = F.col("original"), F.col("new"), F.col("doc_id").cast("string")
    return _sized(spark, sf_dir).select(
        "doc_id",
        texts.convert_detail(F.concat(key, F.lit(".png")), old, new).alias("convert"),
        texts.compress_detail(sizes.keeps_original(old, new, F.lit(False)), old, new).alias("compress"),
        texts.resize_detail(old, old + 1, new, new + 1, old, new).alias("resize"),
        texts.unlock_detail(new, F.concat(key, F.lit(".pdf"))).alias("unlock"),
    )


@query(f"SELECT doc_id, {_LABEL.format(n='n')} AS label FROM (SELECT doc_id, n_chars * n_chars * 37 AS n FROM documents)")
def byte_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """n_chars squared, times 37, stands for bytes."""
    return table(spark, sf_dir, "documents").select("doc_id", sizes.byte_label(F.col("n_chars") * F.col("n_chars") * 37).alias("label"))


@query(
    """SELECT doc_id, CASE WHEN n <> 0 THEN CASE WHEN n >= 10485760 THEN ((2 * n + 1048576) // 2097152)::VARCHAR
  ELSE ((20 * n + 1048576) // 2097152 // 10) || '.' || ((20 * n + 1048576) // 2097152 % 10) END || ' MB' END AS label
FROM (SELECT doc_id, n_chars * 1000 AS n FROM documents)"""
)
def mb_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """n_chars times 1000 stands for bytes."""
    return table(spark, sf_dir, "documents").select("doc_id", sizes.download_label(F.col("n_chars") * 1000).alias("label"))


# Intake: pages, with the url up to ? or # and a made-up extension, as the path.
_EXTS = ["png", "JPG", "heic", "gif", "txt", "pdf", "Jpeg", ""]
_PATHS = "SELECT page_id AS idx, regexp_replace(url, '[?#].*$', '') || '/img' || (page_id % 7) || ['.png', '.JPG', '.heic', '.gif', '.txt', '.pdf', '.Jpeg', ''][page_id % 8 + 1] AS path FROM pages"


def _paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    ends = F.array(*[F.lit(f".{e}" if e else "") for e in _EXTS])
    ext = F.element_at(ends, (F.col("page_id") % 8 + 1).cast("int"))
    return table(spark, sf_dir, "pages").select(F.col("page_id").alias("idx"), F.concat(F.regexp_replace("url", "[?#].*$", ""), F.lit("/img"), (F.col("page_id") % 7).cast("string"), ext).alias("path"))


@query(f"SELECT idx, path, lower(regexp_extract(path, '[^/]\\.([^./]*)$', 1)) AS ext FROM ({_PATHS}) WHERE lower(regexp_extract(path, '[^/]\\.([^./]*)$', 1)) IN ('png', 'jpg')")
def intake_extension_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intake.with_extension(_paths(spark, sf_dir), ["PNG", "jpg"]).select("idx", "path", paths.extension(F.col("path")).alias("ext"))


_READ = ", ".join(f"'{e}'" for e in formats.READABLE)


@query(
    f"""SELECT idx, ext, ext IN ({_READ}) AS readable, ext = 'pdf' AS is_pdf, coalesce(CASE ext WHEN 'png' THEN 'png' WHEN 'jpg' THEN 'jpeg' WHEN 'heic' THEN 'heic' WHEN 'tiff' THEN 'tiff' WHEN 'webp' THEN 'webp' END, 'png') AS format,
  regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir, regexp_extract(path, '/(img[0-9])[^/]*$', 1) AS base
FROM (SELECT *, lower(regexp_extract(path, '[^/]\\.([^./]*)$', 1)) AS ext FROM ({_PATHS}))"""
)
def intake_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Path parts, the readable and document predicates, and the format by extension."""
    ext, path = paths.extension(F.col("path")), F.col("path")
    return _paths(spark, sf_dir).select(
        "idx",
        ext.alias("ext"),
        formats.is_readable(ext).alias("readable"),
        (ext == "pdf").alias("is_pdf"),
        formats.inferred_format(F.lit(None).cast("string"), ext).alias("format"),
        paths.parent(path).alias("dir"),
        paths.base_name(path).alias("base"),
    )


@query("SELECT doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS k FROM documents) WHERE k = 1")
def intake_dedupe_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents, with the text as the key and doc_id as the order."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.sha2("text", 256).alias("key"))
    return intake.first_of_each(docs, F.col("key"), "doc_id").select("doc_id", "source")


# Batches: events, of which those with type error have failed.
def _outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    failure = F.when(F.col("event_type") == "error", "failed")
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("idx"), F.col("event_type").alias("input"), F.col("props").alias("output"), failure.alias("failure"), "user_id")


@query(
    """SELECT user_id, d AS n_done, f AS n_failed, d::DOUBLE / (d + f) AS done_fraction,
  CASE WHEN f = 0 THEN 'Done — ' || d || ' file' || CASE WHEN d = 1 THEN '' ELSE 's' END WHEN d = 0 THEN 'Failed — ' || f || ' file' || CASE WHEN f = 1 THEN '' ELSE 's' END
  ELSE d || ' done, ' || f || ' failed' END AS summary
FROM (SELECT user_id, count(*) FILTER (event_type <> 'error') AS d, count(*) FILTER (event_type = 'error') AS f FROM events GROUP BY user_id)"""
)
def batch_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batch.batch_summary(_outcomes(spark, sf_dir), "user_id")


@query("SELECT event_id AS idx, event_type AS path FROM events WHERE event_type = 'error'")
def retry_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batch.retry_queue(_outcomes(spark, sf_dir))


@query("SELECT event_id AS idx, event_type AS input, user_id FROM events")
def batch_restore_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batch.in_order(_outcomes(spark, sf_dir)).select("idx", "input", "user_id")


@query("SELECT user_id, arg_min(props, event_id) AS output FROM events WHERE event_type <> 'error' GROUP BY user_id")
def first_success(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batch.first_success(_outcomes(spark, sf_dir), "user_id")


@query("SELECT user_id, count(*) || CASE WHEN count(*) = 1 THEN ' file' ELSE ' files' END AS label FROM events GROUP BY user_id")
def queue_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batch.queue_label(_outcomes(spark, sf_dir), "user_id")


@query("SELECT user_id, count(*) FILTER (event_type = 'error') AS n_locked, count(*) FILTER (event_type <> 'error') AS n_open FROM events GROUP BY user_id")
def locked_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failed events stand for locked files."""
    return batch.locked_count(_outcomes(spark, sf_dir), F.col("failure").isNotNull(), "user_id")


# Releases: lineitem, with its integers as version numbers; labels, bump, explicit version and the tag's form go by l_partkey and l_suppkey.
_LABELS = ("", "docs", "patch", "minor", "release:major", "docs release:minor", "minor major", "majority xminor", None)
_BUMPS = (None, "", "patch", "minor", "major", "junk")


def _listed(values: tuple[str | None, ...]) -> str:
    return "[" + ", ".join("NULL" if v is None else f"'{v}'" for v in values) + "]"


@query(
    f"""WITH given AS (
  SELECT l_orderkey, l_linenumber, {_listed(_LABELS)}[l_partkey % {len(_LABELS)} + 1] AS labels, {_listed(_BUMPS)}[l_suppkey % {len(_BUMPS)} + 1] AS bump,
    CASE l_partkey % 11 WHEN 0 THEN '7.' || l_linenumber || '.0' WHEN 1 THEN '7.x' WHEN 2 THEN NULL ELSE '' END AS explicit,
    CASE l_partkey % 13 WHEN 0 THEN NULL WHEN 1 THEN 'v1.2' WHEN 2 THEN '' WHEN 3 THEN l_linenumber || '.' || l_suppkey || '.' || l_partkey
      ELSE 'v' || l_linenumber || '.' || l_suppkey || '.' || l_partkey END AS tag
  FROM lineitem
), asked AS (
  SELECT *, CASE WHEN list_has_any(string_split(coalesce(labels, ''), ' '), ['major', 'release:major']) THEN 'major'
    WHEN list_has_any(string_split(coalesce(labels, ''), ' '), ['minor', 'release:minor']) THEN 'minor'
    WHEN coalesce(bump, '') = '' THEN 'patch' ELSE bump END AS kind,
    regexp_extract(coalesce(tag, ''), '^v?([0-9]+)\\.([0-9]+)\\.([0-9]+)$', ['x', 'y', 'z']) AS p
  FROM given
)
SELECT l_orderkey, l_linenumber,
  CASE WHEN coalesce(explicit, '') <> '' THEN CASE WHEN regexp_full_match(explicit, '[0-9]+\\.[0-9]+\\.[0-9]+') THEN explicit END
    WHEN coalesce(tag, '') = '' THEN '1.0.0' WHEN p.x = '' THEN NULL
    WHEN kind = 'major' THEN (try_cast(p.x AS BIGINT) + 1) || '.0.0' WHEN kind = 'minor' THEN p.x || '.' || (try_cast(p.y AS BIGINT) + 1) || '.0'
    WHEN kind = 'patch' THEN p.x || '.' || p.y || '.' || (try_cast(p.z AS BIGINT) + 1) END AS version,
  CASE WHEN coalesce(explicit, '') <> '' THEN CASE WHEN NOT regexp_full_match(explicit, '[0-9]+\\.[0-9]+\\.[0-9]+') THEN 'bad version' END
    WHEN coalesce(tag, '') = '' THEN NULL WHEN p.x = '' THEN 'bad latest tag' WHEN kind NOT IN ('major', 'minor', 'patch') THEN 'bad bump' END AS error
FROM asked"""
)
def next_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    part, number = F.col("l_partkey"), F.concat_ws(".", "l_linenumber", "l_suppkey", "l_partkey")
    labels = F.get(F.array(*map(F.lit, _LABELS)), (part % len(_LABELS)).cast("int"))
    bump = F.get(F.array(*map(F.lit, _BUMPS)), (F.col("l_suppkey") % len(_BUMPS)).cast("int"))
    explicit = F.when(part % 11 == 0, F.concat(F.lit("7."), F.col("l_linenumber").cast("string"), F.lit(".0"))).when(part % 11 == 1, "7.x").when(part % 11 == 2, None).otherwise("")
    tag = F.when(part % 13 == 0, None).when(part % 13 == 1, "v1.2").when(part % 13 == 2, "").when(part % 13 == 3, number).otherwise(F.concat(F.lit("v"), number))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", labels.alias("labels"), bump.alias("bump"), explicit.alias("explicit"), tag.alias("tag"))
    return release.with_next_version(rows, F.col("tag"), F.col("labels"), F.col("bump"), F.col("explicit")).select("l_orderkey", "l_linenumber", "version", "error")


@query("SELECT event_id, replace(tag, 'v', '') AS previous FROM (SELECT event_id, CASE WHEN event_id % 5 = 0 THEN '' ELSE 'v1.' || (event_id % 9) || '.' || user_id END AS tag FROM events)")
def previous_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The version before a release; a fifth of the rows has no tag yet."""
    tag = F.when(F.col("event_id") % 5 != 0, F.concat(F.lit("v1."), (F.col("event_id") % 9).cast("string"), F.lit("."), F.col("user_id").cast("string")))
    return table(spark, sf_dir, "events").select("event_id", release.previous_version(tag).alias("previous"))


@query("SELECT count(*) AS build FROM orders")
def build_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders stand for commits; one row is the operator's result."""
    return release.build_number(table(spark, sf_dir, "orders"))


@query("SELECT 'v' || x || '.' || y || '.' || z AS tag FROM (SELECT p_size AS x, p_partkey % 97 AS y, p_partkey AS z FROM part) ORDER BY x DESC, y DESC, z DESC LIMIT 1")
def version_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest of tags made of part's numbers; one row is the operator's result."""
    tags = table(spark, sf_dir, "part").select(F.concat(F.lit("v"), F.concat_ws(".", "p_size", F.col("p_partkey") % 97, "p_partkey")).alias("tag"))
    return release.latest_tag(tags)


@query("SELECT part.p_partkey AS version, CASE WHEN p_size > 25 THEN 'new' ELSE 'old' END AS origin FROM part")
def feed_carry_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part as the old feed, its larger half as the new one."""
    from ..sources.feed import carried_forward

    old = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("version"), F.lit("old").alias("origin"), "p_size")
    return carried_forward(old.drop("p_size"), old.where("p_size > 25").select("version", F.lit("new").alias("origin")))


@query("""SELECT page_id, replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') AS escaped, sha256(html) AS checksum FROM pages""")
def html_escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", texts.html_escape(F.col("html")).alias("escaped"), release.checksum(F.col("html").cast("binary")).alias("checksum"))


@query("SELECT event_id, try_cast(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS side, 0::BIGINT AS bad, 'v' || event_id || ' ' || event_type AS filled FROM events")
def text_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers typed into a field, and a template filled in."""
    made = texts.filled(F.lit("v__VERSION__ __BUILD__"), {"VERSION": F.col("event_id"), "BUILD": F.col("event_type")})
    return table(spark, sf_dir, "events").select("event_id", texts.whole_number(F.regexp_extract("props", "([0-9]+)", 1)).alias("side"), texts.whole_number(F.col("event_type"), 0).alias("bad"), made.alias("filled"))


# Names: part, with p_name as the base and p_type as the folder; no base ends in a number.
@query("SELECT p_partkey, p_name || CASE WHEN k > 1 THEN '-' || (k - 1) ELSE '' END || '.png' AS out_name FROM (SELECT *, row_number() OVER (PARTITION BY p_type, p_name ORDER BY p_partkey) AS k FROM part)")
def collision_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_name", F.lit("png").alias("ext"))
    return naming.assign_names(rows, "p_type", "p_name", "ext", "p_partkey").select("p_partkey", "out_name")


@query("SELECT p_partkey, greatest(least(p_size / 25.0::DOUBLE, 1), 0)::DOUBLE AS quality FROM part")
def quality_clamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p_size in twenty-fifths as the quality of a jpeg."""
    return table(spark, sf_dir, "part").select("p_partkey", formats.clamped_quality(F.col("p_size") / 25.0, F.lit("jpeg")).alias("quality"))


@query(
    """SELECT event_id, CASE event_type WHEN 'error' THEN 'Couldn''t write to “' || user_id || '”.' WHEN 'click' THEN 'This PDF has no password.' ELSE '“' || user_id || '” files aren''t supported here.' END AS message,
  CASE WHEN event_type = 'click' THEN 'You can open and save it normally — nothing to remove.' END AS hint FROM events"""
)
def error_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event types stand for error codes, users for the subjects."""
    code: Column = F.when(F.col("event_type") == "error", "writeFailed").when(F.col("event_type") == "click", "notEncrypted").otherwise("unsupportedInput")
    return table(spark, sf_dir, "events").select("event_id", texts.error_message(code, F.col("user_id").cast("string")).alias("message"), texts.recovery_hint(code).alias("hint"))
