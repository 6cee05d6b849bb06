"""Image formats: attributes, what can be read and written, and the format a file is written in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Format, name shown, file extension, whether it keeps every pixel.
FORMATS = (
    ("png", "PNG", "png", True),
    ("jpeg", "JPEG", "jpg", False),
    ("heic", "HEIC", "heic", False),
    ("tiff", "TIFF", "tiff", True),
    ("webp", "WebP", "webp", False),
)
#: Extensions accepted as input.
READABLE = ("heic", "heif", "png", "jpg", "jpeg", "tiff", "tif", "gif", "bmp", "webp", "avif", "dng", "cr2", "nef", "arw", "orf", "raf")
#: Formats that this runtime's codecs write.
WRITABLE = ("png", "jpeg", "tiff")


def format_table(spark: SparkSession, writable: tuple[str, ...] = WRITABLE) -> DataFrame:
    """One row for each format: its attributes, and whether it can be written here."""
    rows = [(f, shown, ext, lossless, not lossless, f in writable) for f, shown, ext, lossless in FORMATS]
    return spark.createDataFrame(rows, "format string, display_name string, file_extension string, is_lossless boolean, supports_quality boolean, can_encode boolean")


def lossy_choices(spark: SparkSession, writable: tuple[str, ...] = WRITABLE) -> DataFrame:
    """The formats with a quality that can be written here."""
    return format_table(spark, writable).where(F.col("can_encode") & ~F.col("is_lossless"))


def _pick(fmt: Column, field: int) -> Column:
    pairs = [F.lit(x) for row in FORMATS for x in (row[0], row[field])]
    return F.element_at(F.create_map(*pairs), fmt)


def display_name(fmt: Column) -> Column:
    return _pick(fmt, 1)


def file_extension(fmt: Column) -> Column:
    return _pick(fmt, 2)


def is_lossless(fmt: Column) -> Column:
    return _pick(fmt, 3)


def is_readable(extension: Column) -> Column:
    """Whether an extension, in any case, is accepted as an image; false for null."""
    return F.coalesce(F.lower(extension).isin(*READABLE), F.lit(False))


def document_error(extension: Column) -> Column:
    """Null for the extension of a document that can be unlocked, in any case; else the code of its error."""
    return F.when(F.coalesce(F.lower(extension) == "pdf", F.lit(False)), F.lit(None).cast("string")).otherwise("unsupportedInput")


def magic_format(content: Column) -> Column:
    """The format that a file's first bytes tell; null if none of ours."""
    head = F.hex(F.substring(content, 1, 12))
    return (
        F.when(head.startswith("89504E470D0A1A0A"), "png")
        .when(head.startswith("FFD8FF"), "jpeg")
        .when(head.startswith("49492A00") | head.startswith("4D4D002A"), "tiff")
        .when(head.startswith("52494646") & head.endswith("57454250"), "webp")
        .when(F.substring(head, 9, 16).isin("6674797068656963", "6674797068656978"), "heic")
    )


def extension_format(extension: Column) -> Column:
    """The format whose own extension this is; `jpeg`, `tif` and `heif` are none."""
    pairs = [F.lit(x) for row in FORMATS for x in (row[2], row[0])]
    return F.element_at(F.create_map(*pairs), F.lower(extension))


def inferred_format(magic: Column, extension: Column) -> Column:
    """The container's format, else that of the extension, else png."""
    return F.coalesce(magic, extension_format(extension), F.lit("png"))


def clamped_quality(quality: Column, fmt: Column) -> Column:
    """Quality within 0 to 1; null for formats without one."""
    return F.when(~is_lossless(fmt), F.greatest(F.least(quality, F.lit(1.0)), F.lit(0.0)))
