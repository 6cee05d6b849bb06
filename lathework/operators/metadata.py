"""Metadata of image files, read from the tag directories in their first bytes."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .headers import HEAD

NESTED = "map<string,map<string,string>>"
ENTRIES = T.ArrayType(T.StructType([T.StructField(c, T.StringType()) for c in ("part", "tag", "value")]))
#: Tags that point to directories of their own, and the resolution's.
PARTS = {34665: "exif", 34853: "gps"}
ORIENTATION, WIDE, HIGH, UNIT = 274, 282, 283, 296
#: Bytes and struct letters of the types of a tag's values.
TYPES = {1: (1, "B"), 2: (1, "s"), 3: (2, "H"), 4: (4, "I"), 5: (8, "II"), 6: (1, "b"), 7: (1, "s"), 8: (2, "h"), 9: (4, "i"), 10: (8, "ii")}
#: Bytes of a value from which on it is left out; maker's notes and thumbnails are longer.
LONGEST = 4096

_Entry = tuple[str, str, str]


def _value(data: bytes, order: str, kind: int, count: int, at: int) -> str | None:
    size, letters = TYPES[kind]
    if count * size > LONGEST or at + count * size > len(data):
        return None
    raw = data[at : at + count * size]
    if kind == 2:
        return raw.split(b"\0")[0].decode("utf-8", "replace")
    if kind == 7:
        return raw.hex()
    numbers = struct.unpack(order + letters * count, raw)
    if len(letters) == 2:
        return ",".join(f"{a}/{b}" for a, b in zip(numbers[::2], numbers[1::2], strict=True))
    return ",".join(map(str, numbers))


def _directory(data: bytes, at: int, part: str) -> Iterator[_Entry]:
    """The entries of a directory, and of those that it points to. What lies beyond the data is left out."""
    order = "<" if data[:2] == b"II" else ">"
    if at < 8 or at + 2 > len(data):
        return
    for k in range(struct.unpack_from(order + "H", data, at)[0]):
        place = at + 2 + 12 * k
        if place + 12 > len(data):
            return
        tag, kind, count = struct.unpack_from(order + "HHI", data, place)
        if kind not in TYPES or not count:
            continue
        inline = count * TYPES[kind][0] <= 4
        where = place + 8 if inline else struct.unpack_from(order + "I", data, place + 8)[0]
        if part == "tiff" and tag in PARTS:
            yield from _directory(data, struct.unpack_from(order + "I", data, place + 8)[0], PARTS[tag])
            continue
        value = _value(data, order, kind, count, where)
        if value is not None:
            yield part, str(tag), value


def _tags(data: bytes) -> Iterator[_Entry]:
    """A block in the form of a TIFF file. The orientation is apart, and the resolution in dots an inch besides."""
    if data[:4] not in (b"II*\0", b"MM\0*") or len(data) < 8:
        return
    found = list(_directory(data, struct.unpack_from("<I" if data[:2] == b"II" else ">I", data, 4)[0], "tiff"))
    own = {int(tag): value for part, tag, value in found if part == "tiff"}
    for part, tag, value in found:
        yield ("orientation", "", value) if part == "tiff" and int(tag) == ORIENTATION else (part, tag, value)
    scale = {"2": 1.0, "3": 2.54}.get(own.get(UNIT, "2"))
    for tag, name in ((WIDE, "dpiWidth"), (HIGH, "dpiHeight")):
        a, _, b = own.get(tag, "").partition("/")
        if scale and b.isdigit() and int(b):
            yield name, "", str(round(int(a) / int(b) * scale))


def _dots(wide: int, high: int, scale: float) -> Iterator[_Entry]:
    yield from (("dpiWidth", "", str(round(wide * scale))), ("dpiHeight", "", str(round(high * scale))))


def _captions(data: bytes) -> Iterator[_Entry]:
    """The IPTC data sets among a block of resources; repeated ones are joined by semicolons."""
    at, found = 0, {}
    while data[at : at + 4] == b"8BIM" and at + 12 <= len(data):
        number = int.from_bytes(data[at + 4 : at + 6])
        start = at + 6 + (data[at + 6] + 2) // 2 * 2
        size = int.from_bytes(data[start : start + 4])
        body = data[start + 4 : start + 4 + size]
        k = 0
        while number == 0x0404 and k + 5 <= len(body) and body[k] == 0x1C:
            n = int.from_bytes(body[k + 3 : k + 5])
            if n > LONGEST:
                break
            found.setdefault(f"{body[k + 1]}:{body[k + 2]}", []).append(body[k + 5 : k + 5 + n].decode("utf-8", "replace"))
            k += 5 + n
        at = start + 4 + (size + 1) // 2 * 2
    yield from (("iptc", tag, ";".join(values)) for tag, values in found.items())


def _jpeg(data: bytes) -> Iterator[_Entry]:
    at = 2
    while at + 4 <= len(data) and data[at] == 0xFF and data[at + 1] not in (0xDA, 0xD9):
        if data[at + 1] == 0xFF:
            at += 1
            continue
        body = data[at + 4 : at + 2 + int.from_bytes(data[at + 2 : at + 4])]
        if data[at + 1] == 0xE0 and body[:5] == b"JFIF\0" and len(body) >= 12 and body[7] in (1, 2):
            yield from _dots(int.from_bytes(body[8:10]), int.from_bytes(body[10:12]), 1.0 if body[7] == 1 else 2.54)
        elif data[at + 1] == 0xE1 and body[:6] == b"Exif\0\0":
            yield from _tags(body[6:])
        elif data[at + 1] == 0xED and body[:14] == b"Photoshop 3.0\0":
            yield from _captions(body[14:])
        at += 2 + max(2, int.from_bytes(data[at + 2 : at + 4]))


def _png(data: bytes) -> Iterator[_Entry]:
    at = 8
    while at + 8 <= len(data):
        size, kind = int.from_bytes(data[at : at + 4]), data[at + 4 : at + 8]
        body = data[at + 8 : at + 8 + size]
        if kind == b"eXIf":
            yield from _tags(body)
        elif kind == b"pHYs" and len(body) == 9 and body[8] == 1:
            yield from _dots(int.from_bytes(body[:4]), int.from_bytes(body[4:8]), 0.0254)
        at += 12 + size


def metadata_entries(data: bytes | None) -> list[_Entry]:
    """(part, tag, value) of a file's first bytes, the last one of each part and tag; none for other kinds of files."""
    data = data or b""
    read = _jpeg if data[:2] == b"\xff\xd8" else _png if data[:8] == b"\x89PNG\r\n\x1a\n" else _tags
    return [(*key, value) for key, value in {(part, tag): value for part, tag, value in read(data)}.items()]


@F.pandas_udf(ENTRIES)
def _entries(heads: pd.Series) -> pd.Series:
    return pd.Series([[dict(zip(("part", "tag", "value"), e, strict=True)) for e in metadata_entries(h)] for h in heads])


def with_metadata(df: DataFrame, content: str = "content", to: str = "metadata") -> DataFrame:
    """Adds the metadata of each file as a map of maps: tiff, exif, gps and iptc by their tags' numbers, orientation, dpiWidth and dpiHeight under ''.

    Only the first HEAD bytes of JPEG, PNG and TIFF files are read; a value that lies beyond them, or is longer than
    LONGEST bytes, is left out. Texts are read up to their first zero, fractions are written as a/b, several values
    with commas, bytes in hex. Other files, broken ones and null have an empty map. A column `to` is replaced.
    """
    found = F.col(to)
    parts = F.array_distinct(F.transform(found, lambda e: e["part"]))
    nested = F.map_from_arrays(parts, F.transform(parts, lambda p: F.map_from_entries(F.transform(F.filter(found, lambda e: e["part"] == p), lambda e: F.struct(e["tag"], e["value"])))))
    return df.withColumn(to, _entries(F.substring(F.col(content), 1, HEAD))).withColumn(to, nested)
