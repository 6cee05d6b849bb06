"""Byte sizes: savings, labels, and the guard that never lets a file grow."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MEBIBYTE = 1_048_576


def saved_fraction(original: Column, new: Column) -> Column:
    """(original - new) / original, negative if the file grew; 0 where the original is not positive."""
    return F.when(original > 0, (original - new) / original).otherwise(F.lit(0.0))


def byte_label(n: Column) -> Column:
    """Decimal units: whole bytes and KB, MB with one decimal, GB with two, halves upwards; null for null.

    The unit is that of the unrounded number, so 999,999 is 1000 KB.
    """
    n = n.cast("long")
    tenths = F.floor((n + 50_000) / 100_000).cast("long")
    hundredths = F.floor((n + 5_000_000) / 10_000_000).cast("long")
    return (
        F.when(n == 1, "1 byte")
        .when(n < 1_000, F.concat(n.cast("string"), F.lit(" bytes")))
        .when(n < 1_000_000, F.concat(F.floor((n + 500) / 1_000).cast("string"), F.lit(" KB")))
        .when(n < 1_000_000_000, F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"), F.lit(" MB")))
        .when(n.isNotNull(), F.concat(F.floor(hundredths / 100).cast("string"), F.lit("."), F.lpad((hundredths % 100).cast("string"), 2, "0"), F.lit(" GB")))
    )


def savings_label(original: Column, new: Column) -> Column:
    """`A → B (p% smaller|larger)`; without the bracket if a size is not positive, and `about the same` at 0%."""
    base = F.concat(byte_label(original), F.lit(" → "), byte_label(new))
    delta = (original - new) / original.cast("double")
    percent = F.abs(F.round(delta * 100)).cast("long")
    change = F.concat(base, F.lit(" ("), percent.cast("string"), F.when(delta > 0, F.lit("% smaller)")).otherwise(F.lit("% larger)")))
    return F.when(~((original > 0) & (new > 0)), base).when(percent == 0, F.concat(base, F.lit(" (about the same)"))).otherwise(change)


def download_label(n: Column) -> Column:
    """Binary MB for download buttons: whole from 10 on, else one decimal; null for null and 0."""
    n = n.cast("long")
    tenths = F.floor((20 * n + MEBIBYTE) / (2 * MEBIBYTE)).cast("long")
    whole = F.floor((2 * n + MEBIBYTE) / (2 * MEBIBYTE)).cast("string")
    small = F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"))
    return F.when(n != 0, F.concat(F.when(n >= 10 * MEBIBYTE, whole).otherwise(small), F.lit(" MB")))


def keeps_original(original: Column, new: Column, resized: Column, guard: bool = True) -> Column:
    """Whether the size guard puts the original back: it is on, nothing was resized, and the new file is not smaller."""
    return F.lit(guard) & (original > 0) & (new >= original) & ~resized
