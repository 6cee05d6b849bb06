"""Registered queries of the image, batch, intake and release operators that need files; part's columns make the files' first bytes."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import formats, paths, sizes
from ..functions.resize import Resize
from ..operators import batch, naming, release
from ..operators.headers import declared_size
from ..operators.metadata import NESTED, with_metadata
from ..sources import feed, file_sink, intake
from ..sources.stash import shared_folder
from . import image_job
from .queries import _LABEL, _PATHS, _paths, query, table

# Images: part, with p_size * 80 as the width and floor(p_retailprice) as the height; the kind goes by p_partkey.
_KINDS = ("png", "gif", "bmp", "jpg", "tiff", "webp", "heic", "raf", "txt", "PNG")


def _hex(n: Column, digits: int) -> Column:
    return F.lpad(F.hex(n.cast("long")), digits, "0")


def _little(n: Column, digits: int) -> Column:
    big = _hex(n, digits)
    return F.concat(*[F.substring(big, k, 2) for k in range(digits - 1, 0, -2)])


def _images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(idx, path, length, content): whole headers, but for every eleventh file, whose content is cut after three bytes."""
    w, h = F.col("w"), F.col("h")
    ispe = [F.concat(F.lit("0000001469737065" + "00000000"), _hex(x, 8), _hex(y, 8)) for x, y in ((F.lit(64), F.lit(64)), (w, h))]  # a tile and the whole
    heads = {
        "png": F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), _hex(w, 8), _hex(h, 8)),
        "gif": F.concat(F.lit("474946383961"), _little(w, 4), _little(h, 4)),
        "bmp": F.concat(F.lit("424D" + "00" * 16), _little(w, 8), _little(h, 8)),
        "jpg": F.concat(F.lit("FFD8FFE000046162FFC0000B08"), _hex(h, 4), _hex(w, 4), F.lit("00" * 8)),
        "tiff": F.concat(F.lit("49492A00080000000200" + "000104000100" + "0000"), _little(w, 8), F.lit("010103000100" + "0000"), _little(h, 4), F.lit("0000")),
        "webp": F.concat(F.lit("5249464600000000574542505650385800000000" + "00000000"), _little(w - 1, 6), _little(h - 1, 6)),
        "heic": F.concat(F.lit("0000001066747970686569630000000000000044" + "6D657461" + "00000000" + "00000038" + "69707270" + "00000030" + "6970636F"), *ispe),
        "raf": F.lit("46554A4946494C4D4343442D524157"),
        "txt": F.lit("68656C6C6F"),
    }
    kind = F.lower("kind")
    content = F.coalesce(*[F.when(kind == k, c) for k, c in heads.items()])
    content = F.when(F.col("idx") % 11 == 0, F.substring(content, 1, 6)).otherwise(content)
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("idx"), (F.col("p_size") * 80).alias("w"), F.floor("p_retailprice").alias("h"), F.get(F.array(*map(F.lit, _KINDS)), (F.col("p_partkey") % len(_KINDS)).cast("int")).alias("kind"))
    path = F.concat(F.lit("/in/"), (F.col("idx") % 7).cast("string"), F.lit("/p"), F.col("idx").cast("string"), F.lit("."), F.col("kind"))
    files = rows.select("idx", path.alias("path"), (F.col("idx") * 1000).cast("long").alias("length"), F.unhex(content).alias("content"))
    return files.repartition("idx")  # as from a scan: what uses the content does not repeat how it was made


_IMAGES = f"""(SELECT p_partkey AS idx, p_size * 80 AS w, floor(p_retailprice)::BIGINT AS h, [{", ".join(f"'{k}'" for k in _KINDS)}][p_partkey % {len(_KINDS)} + 1] AS kind, p_partkey % 11 = 0 AS cut FROM part)"""
#: Which of them declare a size: BMP and GIF and the like by their own headers, RAF only once it is decoded.
_SIZED = "kind NOT IN ('raf', 'txt') AND NOT cut"


@query(
    f"""SELECT idx, CASE WHEN {_SIZED} THEN w END AS width, CASE WHEN {_SIZED} THEN h END AS height, kind = 'raf' AND NOT cut AS undeclared,
  CASE WHEN NOT cut THEN CASE lower(kind) WHEN 'png' THEN 'png' WHEN 'jpg' THEN 'jpeg' WHEN 'tiff' THEN 'tiff' WHEN 'webp' THEN 'webp' WHEN 'heic' THEN 'heic' END WHEN kind = 'jpg' THEN 'jpeg' END AS magic FROM {_IMAGES}"""
)
def image_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes and formats read from the first bytes of nine kinds of files; three bytes are enough to tell a JPEG."""
    rows = _images(spark, sf_dir).select("idx", declared_size(F.col("content")).alias("size"), formats.magic_format(F.col("content")).alias("magic"))
    return rows.select("idx", "size.width", "size.height", "size.undeclared", "magic")


def _tag(order: str, tag: int, value: Column | int, kind: int = 4, count: int = 1) -> Column:
    """An entry of an image directory, in the byte order II or MM."""
    write = _little if order == "II" else _hex
    value = value if isinstance(value, Column) else F.lit(value)
    body = write(value, 8) if kind in (4, 5) or count > 1 else F.concat(write(value, 4), F.lit("0000"))
    return F.concat(write(F.lit(tag), 4), write(F.lit(kind), 4), write(F.lit(count), 8), body)


def _tags(order: str, *entries: Column, onward: int = 0) -> Column:
    write = _little if order == "II" else _hex
    return F.concat(write(F.lit(len(entries)), 4), *entries, write(F.lit(onward), 8))


def _camera_heads(w: Column, h: Column) -> dict[str, Column]:
    """Heads whose first directory or largest image isn't the one that counts, or whose pixels lie on their side."""
    two, four = "II", "MM"
    start = {"II": F.lit("49492A0008000000"), "MM": F.lit("4D4D002A00000008")}

    def item(kind: str, *parts: Column, version: bool = True) -> Column:
        body = F.concat(F.lit("00000000" if version else ""), *parts)
        return F.concat(_hex(8 + F.length(body) / 2, 8), F.lit(kind.encode().hex().upper()), body)

    properties = item("ipco", item("ispe", _hex(w * 2, 8), _hex(h * 2, 8)), item("ispe", _hex(w, 8), _hex(h, 8)), item("irot", F.lit("03"), version=False), version=False)
    links = item("ipma", F.lit("00000002" + "0001" + "01" + "81" + "0002" + "02" + "02" + "83"))  # item 1: the larger; item 2: the other, turned
    orientation = F.concat(start["MM"], _tags(four, _tag(four, 274, 6, 3)))
    return {
        # A thumbnail, and the image below it.
        "dng": F.concat(start["II"], _tags(two, _tag(two, 254, 1), _tag(two, 256, 256, 3), _tag(two, 257, 171, 3), _tag(two, 330, 62)), _tags(two, _tag(two, 254, 0), _tag(two, 256, w), _tag(two, 257, h))),
        # A thumbnail, and below it a preview and the image, by two places.
        "nef": F.concat(start["MM"], _tags(four, _tag(four, 254, 1), _tag(four, 256, 160, 3), _tag(four, 257, 120, 3), _tag(four, 330, 62, 4, 2)), _hex(F.lit(70), 8), _hex(F.lit(112), 8), _tags(four, _tag(four, 254, 1), _tag(four, 256, w * 3), _tag(four, 257, h * 3)), _tags(four, _tag(four, 254, 0), _tag(four, 256, w), _tag(four, 257, h))),
        # A first directory without a size that tells the orientation.
        "arw": F.concat(start["II"], _tags(two, _tag(two, 274, 8, 3), _tag(two, 330, 38)), _tags(two, _tag(two, 256, w), _tag(two, 257, h))),
        # The image first, and then larger frames.
        "cr2": F.concat(F.lit("49492A001000000043520200" + "00000000"), _tags(two, _tag(two, 256, w), _tag(two, 257, h), onward=46), _tags(two, _tag(two, 256, w * 2), _tag(two, 257, h * 2))),
        "tiff": F.concat(start["MM"], _tags(four, _tag(four, 256, w), _tag(four, 257, h), _tag(four, 274, 6, 3))),
        "jpg": F.concat(F.lit("FFD8FFE1"), _hex(8 + F.length(orientation) / 2, 4), F.lit("457869660000"), orientation, F.lit("FFC0000B08"), _hex(h, 4), _hex(w, 4), F.lit("00" * 8)),
        "heic": F.concat(F.lit("000000106674797068656963" + "00000000"), item("meta", item("pitm", F.lit("0002")), item("iprp", properties, links, version=False))),
    }


_CAMERA = ("dng", "nef", "arw", "cr2", "tiff", "jpg", "heic")


@query(
    f"""SELECT idx, CASE WHEN turned THEN h ELSE w END AS width, CASE WHEN turned THEN w ELSE h END AS height, CASE WHEN kind = 'arw' THEN 8 WHEN turned THEN 6 ELSE 1 END AS orientation
FROM (SELECT *, kind IN ('arw', 'tiff', 'jpg', 'heic') AS turned FROM (SELECT p_partkey AS idx, p_size * 80 AS w, floor(p_retailprice)::BIGINT AS h, [{", ".join(f"'{k}'" for k in _CAMERA)}][p_partkey % {len(_CAMERA)} + 1] AS kind FROM part))"""
)
def camera_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of camera files by their directories, of files that lie on their side, and of HEIF files by their primary item."""
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("idx"), (F.col("p_size") * 80).cast("long").alias("w"), F.floor("p_retailprice").alias("h"), F.get(F.array(*map(F.lit, _CAMERA)), (F.col("p_partkey") % len(_CAMERA)).cast("int")).alias("kind"))
    heads = _camera_heads(F.col("w"), F.col("h"))
    files = rows.select("idx", F.unhex(F.coalesce(*[F.when(F.col("kind") == k, c) for k, c in heads.items()])).alias("content")).repartition("idx")
    return files.select("idx", declared_size(F.col("content")).alias("size")).select("idx", "size.width", "size.height", "size.orientation")


def _planned(options: image_job.Options):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        plan = image_job.plan_images(_images(spark, sf_dir), options)
        return plan.select("idx", "format", "quality", "strip_metadata", "out_name", "target.width", "target.height", "out_dir", "error_code")

    return run


_PLAN = f"""(SELECT *, CASE WHEN kind = 'txt' THEN 'unsupportedInput' WHEN cut THEN 'decodeFailed' WHEN format NOT IN ('png', 'jpeg', 'tiff') THEN 'unsupportedOutput' END AS error_code
FROM (SELECT *, CASE lower(kind) WHEN 'jpg' THEN 'jpeg' WHEN 'tiff' THEN 'tiff' WHEN 'webp' THEN 'webp' WHEN 'heic' THEN 'heic' ELSE 'png' END AS format FROM {_IMAGES}))"""


def _plan_sql(fmt: str, quality: str, strip: str, suffix: str, scale: str) -> str:
    """SQL of a plan: fmt is the output format for `format`, scale the factor of the sides (null: none)."""
    return f"""
WITH planned AS (SELECT * REPLACE ({fmt} AS format) FROM {_PLAN}),
coded AS (SELECT *, CASE WHEN kind = 'txt' THEN 'unsupportedInput' WHEN cut THEN 'decodeFailed' WHEN format NOT IN ('png', 'jpeg', 'tiff') THEN 'unsupportedOutput' END AS code, {scale} AS s FROM planned),
made AS (SELECT *, greatest(1, round(w * s))::DOUBLE AS x, greatest(1, round(h * s))::DOUBLE AS y FROM coded)
SELECT idx, format, CASE WHEN format IN ('png', 'tiff') THEN NULL ELSE {quality}::DOUBLE END AS quality, {strip} AS strip_metadata,
  CASE WHEN code IS NULL THEN 'p' || idx || '{suffix}.' || CASE format WHEN 'jpeg' THEN 'jpg' ELSE format END END AS out_name,
  CASE WHEN {_SIZED} AND s IS NOT NULL AND NOT (x = w AND y = h) THEN x END AS width, CASE WHEN {_SIZED} AND s IS NOT NULL AND NOT (x = w AND y = h) THEN y END AS height,
  '/in/' || (idx % 7) AS out_dir, code AS error_code FROM made"""


_PLANS = {
    "plan_resize": (image_job.resize_options(Resize("fit", 1000, 1000)), _plan_sql("format", "0.9", "false", "-resized", "least(1000 / w, 1000 / h, 1.0::DOUBLE)")),
    "plan_convert": (image_job.replace(image_job.CONVERT, fmt="jpeg"), _plan_sql("'jpeg'", "0.9", "false", "", "NULL::DOUBLE")),
    "plan_compress_lossless": (image_job.COMPRESS_LOSSLESS, _plan_sql("format", "1.0", "true", "-compressed", "NULL::DOUBLE")),
    "plan_compress_lossy": (image_job.COMPRESS_LOSSY, _plan_sql("'jpeg'", "0.75", "true", "-compressed", "NULL::DOUBLE")),
}
for _name, (_options, _sql) in _PLANS.items():
    _run = _planned(_options)
    _run.__name__ = _name
    query(_sql)(_run)


_SAVED = f"""{_LABEL.format(n="old")} || ' → ' || {_LABEL.format(n="new")} || CASE WHEN p = 0 THEN ' (about the same)' ELSE ' (' || p || CASE WHEN new < old THEN '% smaller)' ELSE '% larger)' END END"""


@query(
    f"""WITH done AS (SELECT *, idx * 1000 AS old, (idx * 1000 * (idx % 5 + 7)) // 10 AS made, error_code IS NULL AND idx % 13 <> 0 AS ok FROM {_PLAN}),
guarded AS (SELECT *, ok AND made >= old AS kept FROM done),
final AS (SELECT *, CASE WHEN kept THEN old WHEN idx % 13 <> 0 THEN made END AS new, abs(round((old - made)::DOUBLE / nullif(old, 0) * 100))::BIGINT AS p FROM guarded)
SELECT idx, CASE WHEN ok THEN '/in/' || (idx % 7) || '/p' || idx || '-compressed.' || CASE WHEN kept THEN lower(kind) WHEN format = 'jpeg' THEN 'jpg' ELSE format END END AS output,
  CASE WHEN kept THEN 'Already optimal — copied unchanged (' || {_LABEL.format(n="old")} || ')' WHEN ok THEN {_SAVED} END AS detail,
  coalesce(error_code, CASE WHEN idx % 13 = 0 THEN 'encodeFailed' END) AS error_code, kept AS kept_original, ok AND NOT kept AS metadata_stripped FROM final"""
)
def finish_compress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lossless compression once sizes are known: seven to eleven tenths of the original; every thirteenth file was not written."""
    plan = image_job.plan_images(_images(spark, sf_dir), image_job.COMPRESS_LOSSLESS)
    made = F.floor(F.col("original_bytes") * (F.col("idx") % 5 + 7) / 10).cast("long")
    written = plan.where(F.col("error_code").isNull() & (F.col("idx") % 13 != 0)).select("idx", made.alias("new_bytes"))
    out = image_job.finish_images(plan, written, image_job.COMPRESS_LOSSLESS)
    return out.select("idx", "output", "detail", "error_code", "kept_original", "metadata_stripped")


@query("SELECT doc_id, (doc_id % 3 <> 0) AND old > 0 AND new >= old AS kept_original FROM (SELECT doc_id, n_chars AS old, n_chars + doc_id % 7 - 3 AS new FROM documents)")
def size_guard_resized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The guard on sizes around the original's; a third of the files was resized and never goes back."""
    kept = sizes.keeps_original(F.col("n_chars"), F.col("n_chars") + F.col("doc_id") % 7 - 3, F.col("doc_id") % 3 == 0)
    return table(spark, sf_dir, "documents").select("doc_id", kept.alias("kept_original"))


@query("SELECT p_partkey, '/out/' || (p_partkey % 3) AS chosen, '/in/' || (p_partkey % 7) AS beside FROM part")
def output_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat(F.lit("/in/"), (F.col("p_partkey") % 7).cast("string"), F.lit("/x.png"))
    parts = [table(spark, sf_dir, "part").where(F.col("p_partkey") % 3 == k).select("p_partkey", naming.output_folder(path, f"/out/{k}").alias("chosen"), naming.output_folder(path).alias("beside")) for k in range(3)]
    return parts[0].union(parts[1]).union(parts[2])


@query(
    """SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'tiff=t' ELSE 'exif=' || event_type || ',gps=' || user_id END AS carried, '' AS stripped FROM events"""
)
def metadata_carried(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kept keys of a metadata map, with a null one and an orientation that must not come along."""
    text = F.lit(None).cast("string")
    some = F.create_map(F.lit("orientation"), F.lit("6"), F.lit("gps"), F.col("user_id").cast("string"), F.lit("exif"), F.col("event_type"), F.lit("iptc"), text)
    other = F.create_map(F.lit("tiff"), F.lit("t"), F.lit("maker"), F.lit("m"))
    metadata = F.when(F.col("event_id") % 4 == 0, other).otherwise(some)

    def shown(strip: bool) -> Column:
        entries = F.sort_array(F.map_entries(image_job.carried_metadata(metadata, F.lit(strip))))
        return F.array_join(F.transform(entries, lambda e: F.concat_ws("=", e["key"], e["value"])), ",")

    return table(spark, sf_dir, "events").select("event_id", shown(False).alias("carried"), shown(True).alias("stripped"))


_SHOWN = "'exif.34855=' || p_size || ',gps.1=N,gps.6=' || p_partkey || '/10,tiff.271=abc'"


@query(
    f"""SELECT p_partkey AS idx, CASE p_partkey % 4 WHEN 3 THEN '' ELSE CASE p_partkey % 4 WHEN 1 THEN 'dpiHeight.=72,' ELSE '' END || 'dpiWidth.=' || CASE p_partkey % 4 WHEN 1 THEN '72' ELSE (p_size * 3)::VARCHAR END || ',' || {_SHOWN} || ',tiff.282=' || (p_size * 3) || '/1,tiff.296=2' END AS carried,
  '' AS stripped, CASE WHEN p_partkey % 4 < 3 THEN '6' END AS orientation FROM part"""
)
def metadata_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is carried over from JPEG, PNG and TIFF heads with exposure and place, and from files that have none."""
    order, size, key = "MM", F.col("p_size").cast("long"), F.col("p_partkey")
    first = _tags(order, _tag(order, 271, 0x61626300, 2, 4), _tag(order, 274, 6, 3), _tag(order, 282, 86, 5), _tag(order, 296, 2, 3), _tag(order, 34665, 94), _tag(order, 34853, 112))
    below = [_hex(size * 3, 8), F.lit("00000001"), _tags(order, _tag(order, 34855, size, 3)), _tags(order, _tag(order, 1, 0x4E000000, 2, 2), _tag(order, 6, 142, 5)), _hex(key, 8), F.lit("0000000A")]
    tags = F.concat(F.lit("4D4D002A00000008"), first, *below)
    size_of = F.length(tags) / 2
    heads = {
        0: tags,
        1: F.concat(F.lit("FFD8FFE1"), _hex(8 + size_of, 4), F.lit("457869660000"), tags, F.lit("FFE000104A46494600010201004800480000" + "FFDA")),
        2: F.concat(F.lit("89504E470D0A1A0A0000000D49484452" + "00" * 17), _hex(size_of, 8), F.lit("65584966"), tags, F.lit("00" * 4)),
        3: F.lit("474946383961"),
    }
    content = F.unhex(F.coalesce(*[F.when(key % 4 == k, c) for k, c in heads.items()]))
    rows = with_metadata(table(spark, sf_dir, "part").select(key.alias("idx"), content.alias("content")).repartition("idx"), to="found")

    def shown(strip: bool) -> Column:
        parts = F.map_entries(image_job.carried_metadata(F.col("found"), F.lit(strip), NESTED))
        lines = F.flatten(F.transform(parts, lambda p: F.transform(F.map_entries(p["value"]), lambda t: F.concat(p["key"], F.lit("."), t["key"], F.lit("="), t["value"]))))
        return F.array_join(F.array_sort(lines), ",")

    return rows.select("idx", shown(False).alias("carried"), shown(True).alias("stripped"), F.col("found")["orientation"][""].alias("orientation"))


# Batches.
def _job(row: dict) -> tuple[str | None, str | None]:
    if row["path"] == "error":
        raise batch.JobError("wrongPassword", "Incorrect password.")
    if row["idx"] % 17 == 0:
        raise ValueError("odd")
    return f"{row['path']}-{row['idx']}.out", "ok"


@query(
    """SELECT event_id AS idx, event_type AS input, CASE WHEN ok THEN event_type || '-' || event_id || '.out' END AS output, CASE WHEN ok THEN 'ok' END AS detail,
  CASE WHEN event_type = 'error' THEN 'Incorrect password.' WHEN NOT ok THEN 'odd' END AS failure, CASE WHEN event_type = 'error' THEN 'wrongPassword' WHEN NOT ok THEN 'unexpected' END AS error_code
FROM (SELECT *, event_type <> 'error' AND event_id % 17 <> 0 AS ok FROM events)"""
)
def batch_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A job for each event, some of which raise."""
    rows = table(spark, sf_dir, "events").select(F.col("event_id").cast("long").alias("idx"), F.col("event_type").alias("path"))
    return batch.run_jobs(rows, _job)


def _later(row: dict) -> tuple[str | None, str | None]:
    """Errors fail, but for a third of them, which work the second time."""
    if row["path"] == "error" and (row["attempt"] < 2 or row["idx"] % 3):
        raise batch.JobError("wrongPassword", "Incorrect password.")
    return f"{row['idx']}.{row['attempt']}", "ok"


@query(
    """SELECT event_id AS idx, event_type AS input, CASE WHEN bad AND event_id % 3 <> 0 THEN 'wrongPassword' END AS error_code, CASE WHEN NOT bad AND half THEN 1 WHEN bad AND half AND event_id % 3 = 0 THEN 2 ELSE 2 + (bad AND event_id % 3 <> 0)::INT END AS attempt,
  CASE WHEN NOT bad THEN 1 WHEN event_id % 3 = 0 THEN 1 + half::INT ELSE 2 + half::INT END AS runs FROM (SELECT *, event_type = 'error' AS bad, event_id % 2 = 0 AS half FROM events)"""
)
def batch_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch of which half was run before it was broken off, started again over all events, and once more for what failed."""
    rows = table(spark, sf_dir, "events").select(F.col("event_id").cast("long").alias("idx"), F.col("event_type").alias("path"))
    folder = f"{shared_folder(spark)}/ledger-{uuid.uuid4().hex}"
    for some in (rows.where("idx % 2 = 0"), rows, rows):
        out = batch.run_recorded(some, _later, folder)
    return out.select("idx", "input", "error_code", "attempt", "runs")


@query("SELECT event_id AS idx, event_type AS input, '' AS output, '' AS detail, '' AS failure, '' AS error_code FROM events WHERE false")
def batch_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").where("event_id IS NULL").select(F.col("event_id").cast("long").alias("idx"), F.col("event_type").alias("path"))
    return batch.run_jobs(rows, _job)


# Intake.
@query(f"SELECT min(idx) AS idx, path FROM ({_PATHS}) WHERE path NOT IN (SELECT path FROM ({_PATHS}) WHERE idx % 10 = 3) GROUP BY path")
def intake_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First of each path, without those that a queue holds; the queue writes its paths in another way."""
    rows = _paths(spark, sf_dir)
    queue = rows.where(F.col("idx") % 10 == 3).select(F.regexp_replace("path", r"/([^/]*)$", "/./x/../$1").alias("path"))
    return intake.queued(rows, queue).select("idx", "path")


@query(f"SELECT idx, path FROM ({_PATHS})")
def intake_any_extension(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intake.with_extension(_paths(spark, sf_dir), [])


@query(f"SELECT idx, path FROM ({_PATHS}) WHERE path <> (SELECT path FROM ({_PATHS}) WHERE idx = (SELECT min(page_id) FROM pages))")
def intake_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The queue without its first path."""
    rows = _paths(spark, sf_dir)
    return intake.without(rows, rows.agg(F.min_by("path", "idx")).first()[0])


@query(f"SELECT idx, CASE WHEN lower(regexp_extract(path, '[^/]\\.([^./]*)$', 1)) <> 'pdf' THEN 'unsupportedInput' END AS error_code FROM ({_PATHS})")
def document_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _paths(spark, sf_dir).select("idx", formats.document_error(paths.extension(F.col("path"))).alias("error_code"))


# Releases.
@query(
    """SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'fallback' WHEN 1 THEN 'https://x/' || o_orderkey || '.dmg' WHEN 2 THEN 'https://x/B.DMG' ELSE 'fallback' END AS url,
  CASE WHEN o_orderkey % 4 = 1 THEN o_custkey WHEN o_orderkey % 4 = 2 THEN 7 END AS size FROM orders"""
)
def release_downloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Release records without assets, with one, with several, and broken ones."""
    key = F.col("o_orderkey").cast("string")
    one = F.concat(F.lit('{"tag_name":"v1","assets":[{"name":"a.zip","browser_download_url":"z","size":1},{"name":"a.dmg","browser_download_url":"https://x/'), key, F.lit('.dmg","size":'), F.col("o_custkey").cast("string"), F.lit("}]}"))
    two = F.lit('{"assets":[{"name":"B.DMG","browser_download_url":"https://x/B.DMG","size":7},{"name":"c.dmg","browser_download_url":"no","size":8}]}')
    kind = F.col("o_orderkey") % 4
    payload = F.when(kind == 0, F.lit('{"tag_name":"v0","assets":[]}')).when(kind == 1, one).when(kind == 2, two).otherwise("not json")
    return table(spark, sf_dir, "orders").select("o_orderkey", feed.release_download(payload, "fallback").alias("found")).select("o_orderkey", "found.*")


@query(
    """SELECT o_orderkey, epoch(o_orderdate::TIMESTAMP)::BIGINT + 16 * 3600 + 4 * 60 - (o_orderkey % 3 - 1) * 19800 AS published, o_orderkey % 3 <> 1 AS unsigned FROM orders"""
)
def feed_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Publication times with three offsets, and entries without a signature."""
    zone = F.get(F.array(F.lit("-0530"), F.lit("+0000"), F.lit("+0530")), (F.col("o_orderkey") % 3).cast("int"))
    text = F.concat(F.lit("Xxx, "), F.date_format("o_orderdate", "d MMM yyyy"), F.lit(" 16:04:00 "), zone)
    signature = F.when(F.col("o_orderkey") % 3 == 1, "abc").when(F.col("o_orderkey") % 3 == 2, "")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.unix_seconds(feed.feed_time(text)).alias("published"), signature.alias("signature"))
    bare = feed.unsigned(rows).select("o_orderkey", F.lit(True).alias("unsigned"))
    return rows.join(bare, "o_orderkey", "left").select("o_orderkey", "published", F.coalesce("unsigned", F.lit(False)).alias("unsigned"))


# Versions of any form: lineitem and part, with numbers of more digits than 64 bits hold.
_LONG = "9223372036854775807"
_ODD_TAGS = ("v1.2.99999999999999999999", f"v1.2.{_LONG}", f"v{_LONG}.0.7", "v01.2.09", "v2.0.0-rc1", "v2.0.0\n")
_ODD_GIVEN = ("", "2.0.0\n", "3.0.99999999999999999999")


def _chr(values: tuple[str, ...]) -> str:
    return "[" + ", ".join("'" + v.replace("\n", "' || chr(10) || '") + "'" for v in values) + "]"


@query(
    f"""WITH given AS (SELECT l_orderkey, l_linenumber, {_chr(_ODD_TAGS)}[l_partkey % {len(_ODD_TAGS)} + 1] AS tag, {_chr(_ODD_GIVEN)}[l_orderkey % {len(_ODD_GIVEN)} + 1] AS explicit, ['major', 'minor', 'patch'][l_suppkey % 3 + 1] AS kind FROM lineitem),
parts AS (SELECT *, regexp_full_match(substr(tag, 2), '[0-9]+\\.[0-9]+\\.[0-9]+') AS formed, string_split(substr(tag, 2), '.') AS p FROM given),
raised AS (SELECT *, CASE WHEN formed THEN [try(p[1]::BIGINT + 1)::VARCHAR, try(p[2]::BIGINT + 1)::VARCHAR, try(p[3]::BIGINT + 1)::VARCHAR] END AS r FROM parts),
bumped AS (SELECT *, CASE WHEN formed THEN CASE kind WHEN 'major' THEN r[1] || '.0.0' WHEN 'minor' THEN p[1] || '.' || r[2] || '.0' ELSE p[1] || '.' || p[2] || '.' || r[3] END END AS b FROM raised)
SELECT l_orderkey, l_linenumber, CASE WHEN explicit = '' THEN b WHEN regexp_full_match(explicit, '[0-9]+\\.[0-9]+\\.[0-9]+') THEN explicit END AS version,
  CASE WHEN explicit <> '' THEN CASE WHEN NOT regexp_full_match(explicit, '[0-9]+\\.[0-9]+\\.[0-9]+') THEN 'bad version' END WHEN NOT formed THEN 'bad latest tag' WHEN b IS NULL THEN 'number too long' END AS error FROM bumped"""
)
def next_version_odd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The version after tags with numbers that are too long, with leading zeros, with a pre-release, and with a line end; explicit ones as odd."""

    def pick(values: tuple[str, ...], by: str) -> Column:
        return F.get(F.array(*map(F.lit, values)), (F.col(by) % len(values)).cast("int"))

    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    out = release.with_next_version(rows, pick(_ODD_TAGS, "l_partkey"), F.lit(None).cast("string"), pick(("major", "minor", "patch"), "l_suppkey"), pick(_ODD_GIVEN, "l_orderkey"))
    return out.select("l_orderkey", "l_linenumber", "version", "error")


_TAG = "'v' || (p_partkey % 7) || '.' || p_size || '.' || p_partkey || CASE WHEN p_partkey % 3 = 0 THEN '00000000000000000000' ELSE '' END || CASE WHEN p_partkey % 2 = 0 THEN '-rc' || (p_partkey % 13) ELSE '' END"


@query(
    f"""SELECT p_brand, arg_max(tag, key) AS latest FROM (SELECT p_brand, {_TAG} AS tag, struct_pack(x := p_partkey % 7, y := p_size, z := (p_partkey || CASE WHEN p_partkey % 3 = 0 THEN '00000000000000000000' ELSE '' END)::HUGEINT, rc := CASE WHEN p_partkey % 2 = 0 THEN p_partkey % 13 ELSE -1 END) AS key FROM part) GROUP BY p_brand"""
)
def version_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest tag of each brand's; numbers have up to 26 digits, and half of the tags are pre-releases."""
    key = F.col("p_partkey")
    number = F.concat(key.cast("string"), F.when(key % 3 == 0, "0" * 20).otherwise(""), F.when(key % 2 == 0, F.concat(F.lit("-rc"), (key % 13).cast("string"))).otherwise(""))
    tags = table(spark, sf_dir, "part").select("p_brand", F.concat(F.lit("v"), F.concat_ws(".", key % 7, "p_size", number)).alias("tag"))
    return tags.groupBy("p_brand").agg(F.max_by("tag", release.version_order(F.col("tag"))).alias("latest"))


# Files: documents' texts, each in a folder by its source.
@query("SELECT coalesce(source, 'none') || '/' || doc_id || '.txt' AS name, strlen(coalesce(text, ''))::BIGINT AS length, sha256(coalesce(text, '')) AS checksum FROM documents WHERE doc_id % 10 <> 9")
def file_sink_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts written as files in a fresh folder and read back; every tenth is a job that failed, which leaves none."""
    folder = f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"
    name = F.concat_ws("/", F.coalesce("source", F.lit("none")), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    content = F.when(F.col("doc_id") % 10 != 9, F.encode(F.coalesce("text", F.lit("")), "utf-8"))
    file_sink.write_files(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), folder, name, content)
    found = intake.read_files(spark, folder)
    short = F.substring_index("path", f"{folder.rsplit('/', 1)[1]}/", -1)
    return found.select(short.alias("name"), "length", release.checksum(F.col("content")).alias("checksum"))


# Names after the size guard: part, of which every second row keeps its original; several share a base, some bases end in
# numbers, and some names are there before.
def guarded_rows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    key = F.col("p_partkey")
    exts = F.array(*map(F.lit, ("png", "jpg", "gif")))
    base = F.concat(F.lit("f"), (F.floor(key / 4) % 500).cast("string"), F.when(key % 6 == 1, F.concat(F.lit("-"), (key % 3 + 1).cast("string"))).when(key % 6 == 2, "-1-2").otherwise(""))
    rows = table(spark, sf_dir, "part").select(key.alias("idx"), F.concat(F.lit("/out/"), (key % 2).cast("string")).alias("out_dir"), base.alias("base"), F.get(exts, (key % 3).cast("int")).alias("ext"), F.get(exts, (F.floor(key / 3) % 2).cast("int")).alias("out_ext"), (key % 2 == F.floor(key / 8) % 2).alias("kept_original"))
    there = rows.where("idx % 10 = 0").select("out_dir", "base", F.col("ext").alias("out_ext"))
    return rows, there


@query()
def fallback_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Planned names, then those of the originals that are kept."""
    rows, there = guarded_rows(spark, sf_dir)
    planned = naming.assign_names(rows, existing=there).withColumn("planned", F.col("out_name"))
    return naming.fallback_names(planned, existing=there).select("idx", "out_dir", "planned", "out_name")


# Folders: a file for every part, in folders by the key, some without an extension and some with two.
_LISTED = "CASE p_partkey % 4 WHEN 0 THEN '' WHEN 1 THEN '.png' WHEN 2 THEN '.tar.gz' ELSE '.JPG' END"


@query("SELECT p_partkey % 40 AS folder, CASE p_partkey % 4 WHEN 2 THEN p_partkey || '.tar' ELSE p_partkey::VARCHAR END AS base, CASE p_partkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'png' WHEN 2 THEN 'gz' ELSE 'JPG' END AS ext FROM part")
def existing_listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The names in all output folders, listed by the tasks; two folders do not exist."""
    root = f"{shared_folder(spark)}/there-{uuid.uuid4().hex}"
    rows = table(spark, sf_dir, "part").select("p_partkey")
    folder = (F.col("p_partkey") % 40).cast("string")
    file_sink.write_files(rows, root, F.concat(folder, F.lit("/"), F.col("p_partkey").cast("string"), F.expr(_LISTED)), F.lit(b""))
    wanted = rows.select(F.concat(F.lit(f"{root}/"), (F.col("p_partkey") % 42).cast("string")).alias("out_dir"))
    found = intake.existing_names(wanted)
    return found.select(F.substring_index("out_dir", "/", -1).cast("long").alias("folder"), "base", F.col("out_ext").alias("ext"))


# A feed polled three times: the first poll finds the orders with an even key, the second one every third order, of which some
# are known, and the third one nothing. Files hold the entries of 200 keys.
@query("SELECT '1.0.' || o_orderkey AS version, CASE WHEN o_orderkey % 3 = 0 THEN 'second' ELSE 'first' END AS title, 'https://x/' || o_orderkey || '.dmg' AS url, (CASE WHEN o_orderkey % 3 = 0 THEN 2 ELSE 1 END * o_orderkey)::BIGINT AS length, epoch(o_orderdate::TIMESTAMP)::BIGINT AS published FROM orders WHERE o_orderkey % 2 = 0 OR o_orderkey % 3 = 0")
def feed_polled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All releases after three polls of a folder of feeds; those that the second feeds leave out are carried forward."""
    root = f"{shared_folder(spark)}/feed-{uuid.uuid4().hex}"
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    key = F.col("o_orderkey").cast("string")
    for turn, (title, every) in enumerate((("first", 2), ("second", 3)), 1):
        item = F.format_string(f"<item><title>{title}</title><pubDate>%s +0000</pubDate><sparkle:shortVersionString>1.0.%s</sparkle:shortVersionString><enclosure url=\"https://x/%s.dmg\" length=\"%s\"/></item>", F.date_format("o_orderdate", "EEE, d MMM yyyy HH:mm:ss"), key, key, (F.col("o_orderkey") * turn).cast("string"))
        feeds = orders.where(F.col("o_orderkey") % every == 0).groupBy(F.floor(F.col("o_orderkey") / 200).alias("file")).agg(F.array_join(F.collect_list(item), "\n").alias("items"))
        text = F.concat(F.lit("<rss xmlns:sparkle=\"urn:x\"><channel>\n"), "items", F.lit("</channel></rss>"))
        file_sink.write_files(feeds, f"{root}/in", F.concat(F.lit(f"{title}-"), F.col("file").cast("string"), F.lit(".xml")), text)
        feed.poll_feed(spark, f"{root}/in", f"{root}/state")
    found = feed.poll_feed(spark, f"{root}/in", f"{root}/state")  # nothing new
    return found.select("version", "title", "url", "length", F.unix_seconds("published").alias("published"))
