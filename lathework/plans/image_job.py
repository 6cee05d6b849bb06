"""The image tools as plans: what is to be written for each file, and the result once its size is known."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.formats import WRITABLE, clamped_quality, display_name, file_extension, inferred_format, is_readable, magic_format
from ..functions.paths import base_name, extension, file_name, joined, raw_extension
from ..functions.resize import Resize, target_size
from ..functions.sizes import keeps_original
from ..functions.texts import compress_detail, convert_detail, error_message, resize_detail
from ..operators.headers import declared_size
from ..operators.naming import assign_names, fallback_names, output_folder
from ..sources.intake import existing_names
from ..sources.stash import stash


@dataclass(frozen=True)
class Options:
    """One record for a whole batch. fmt None keeps each file's own format."""

    fmt: str | None = None
    quality: float = 0.9
    resize: Resize = field(default_factory=Resize)
    allow_upscale: bool = False
    strip_metadata: bool = False
    suffix: str = ""
    folder: str | None = None
    guard: bool = False
    writable: tuple[str, ...] = WRITABLE


#: The metadata that a rewritten file keeps. Orientation is not among it, as it goes into the pixels.
METADATA_KEPT = ("exif", "tiff", "iptc", "gps", "dpiWidth", "dpiHeight")
#: The tools with their titles and categories.
TOOLS = (("pdf-unlock", "Remove PDF Password", "PDF"), ("heic-convert", "Convert Image Format", "Images"), ("compress", "Compress Images", "Images"), ("resize", "Resize Images", "Images"))
#: The settings that define the tools.
CONVERT = Options(quality=0.9)
COMPRESS_LOSSLESS = Options(quality=1.0, strip_metadata=True, suffix="-compressed", guard=True)
COMPRESS_LOSSY = Options(fmt="jpeg", quality=0.75, strip_metadata=True, suffix="-compressed", guard=True)
RESIZE = Options(quality=0.9, suffix="-resized")


def resize_options(rule: Resize, allow_upscale: bool = False) -> Options:
    """Exact boxes may always grow an image."""
    return replace(RESIZE, resize=rule, allow_upscale=allow_upscale or rule.kind == "exact")


def carried_metadata(metadata: Column, strip: Column, kind: str = "map<string,string>") -> Column:
    """What of a metadata map (of type `kind`, by text) goes into the new file: the kept keys, or nothing if it is to be stripped."""
    kept = F.map_filter(metadata, lambda key, value: key.isin(*METADATA_KEPT) & value.isNotNull() & ~strip)
    return F.coalesce(kept, F.from_json(F.lit("{}"), kind))


def tools_in(spark: SparkSession, category: str) -> DataFrame:
    """The tools of a category, in their order."""
    return spark.createDataFrame(TOOLS, "id string, title string, category string").where(F.col("category") == category)


def files_there(files: DataFrame, options: Options) -> DataFrame:
    """What lies in the output folders of a batch before it runs, to be given to plan_images and finish_images as `existing`."""
    return stash(existing_names(files.select(output_folder(F.col("path"), options.folder).alias("out_dir"))))


def plan_images(files: DataFrame, options: Options, existing: DataFrame | None = None, look: bool = False) -> DataFrame:
    """One row for each file (idx, path, length, content): format, quality, sizes, output name, or why it fails.

    Checks come in the order extension, header, output format, name; the first that fails gives
    error_code and failure. Names are given in the plan, before anything is written, so that two files of a
    batch never get the same one. The content is read for the header only and not carried along. A file
    of a kind that declares no size is planned without one, and is not resized. With `look`, the output folders are
    listed first (files_there), so that no file there is overwritten; give that table as `existing` instead where
    finish_images needs it as well.
    """
    if look and existing is None:
        existing = files_there(files, options)
    path = F.col("path")
    ext = extension(path)
    # Content of other files never leaves the JVM: a function of Python's runs on all rows that reach it.
    content = F.when(is_readable(ext), F.col("content"))
    rows = files.select("idx", "path", F.coalesce("length", F.lit(0)).cast("long").alias("original_bytes"), ext.alias("ext"), magic_format(F.col("content")).alias("magic"), declared_size(content).alias("size"))
    rows = rows.withColumn("format", F.coalesce(F.lit(options.fmt), inferred_format(F.col("magic"), F.col("ext"))))
    unread = F.col("size.width").isNull() & ~F.col("size.undeclared")
    code = F.when(~is_readable(F.col("ext")), "unsupportedInput").when(unread, "decodeFailed").when(~F.col("format").isin(*options.writable), "unsupportedOutput")
    rows = rows.withColumn("error_code", code)
    target = target_size(options.resize, F.col("size.width"), F.col("size.height"), options.allow_upscale)
    rows = rows.withColumns({"target": target, "quality": clamped_quality(F.lit(options.quality), F.col("format")), "strip_metadata": F.lit(options.strip_metadata), "out_dir": output_folder(path, options.folder), "base": F.concat(base_name(path), F.lit(options.suffix)), "out_ext": file_extension(F.col("format"))})
    rows = stash(rows)  # headers are read once
    good = assign_names(rows.where(F.col("error_code").isNull()), existing=existing)
    out = good.unionByName(rows.where(F.col("error_code").isNotNull()).withColumn("out_name", F.lit(None).cast("string")))
    code = F.coalesce("error_code", F.when(F.col("out_name").isNull(), "writeFailed"))
    subject = F.when(code == "unsupportedInput", raw_extension(path)).when(code == "unsupportedOutput", display_name(F.col("format"))).otherwise(file_name(path))
    failure = error_message(code, subject)
    return out.withColumns({"error_code": code, "failure": failure}).drop("magic")


def finish_images(plan: DataFrame, written: DataFrame, options: Options, existing: DataFrame | None = None) -> DataFrame:
    """Outcomes of a plan, given written (idx, new_bytes): the size guard, the details, and the failures.

    Where the guard puts the original back, sizes are the original's, the file keeps its own extension and
    metadata_stripped is false, for its bytes are copied as they are. Its name is found anew (fallback_names), so give
    the files that were there before the batch, as to plan_images. A planned file that was not written has failed.
    """
    rows = plan.join(written.select("idx", "new_bytes"), "idx", "left")
    code = F.coalesce("error_code", F.when(F.col("new_bytes").isNull(), "encodeFailed"))
    kept = F.coalesce(keeps_original(F.col("original_bytes"), F.col("new_bytes"), F.col("target").isNotNull(), options.guard), F.lit(False)) & code.isNull()
    rows = rows.withColumns({"failure": F.coalesce("failure", error_message(code, display_name(F.col("format")))), "error_code": code, "kept_original": kept})
    if options.guard:
        rows = fallback_names(rows, existing=existing)
    lost = F.col("kept_original") & F.col("out_name").isNull()
    code = F.coalesce("error_code", F.when(lost, "writeFailed"))
    rows = rows.withColumns({"failure": F.coalesce("failure", F.when(lost, error_message(F.lit("writeFailed"), file_name(F.col("path"))))), "error_code": code, "kept_original": F.col("kept_original") & ~lost})
    new = F.when(F.col("kept_original"), F.col("original_bytes")).otherwise(F.col("new_bytes"))
    rows = rows.withColumns({"out_name": F.when(code.isNull(), F.col("out_name")), "new_bytes": new})
    sizes = [F.col("size.width"), F.col("size.height"), F.coalesce("target.width", "size.width"), F.coalesce("target.height", "size.height")]
    if options.resize.active():
        detail = resize_detail(*sizes, F.col("original_bytes"), F.col("new_bytes"))
    elif options.guard:
        detail = compress_detail(F.col("kept_original"), F.col("original_bytes"), F.col("new_bytes"))
    else:
        detail = convert_detail(F.col("out_name"), F.col("original_bytes"), F.col("new_bytes"))
    output = joined(F.col("out_dir"), F.col("out_name"))
    ok = F.col("failure").isNull()
    return rows.select("idx", F.col("path").alias("input"), F.when(ok, output).alias("output"), F.when(ok, detail).alias("detail"), "failure", "error_code", "original_bytes", "new_bytes", "kept_original", (F.col("strip_metadata") & ~F.col("kept_original") & ok).alias("metadata_stripped"))
