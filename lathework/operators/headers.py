"""Declared pixel sizes of image files, read from their headers."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: width and height are those of the image as it is shown, null where the header is not whole. undeclared: the file is an image
#: of a kind whose size is known only once it is decoded. more: the size lies beyond the bytes that were given. orientation: how
#: the stored pixels lie, 1 to 8 as EXIF counts; 5 to 8 lie on their side.
SIZE = T.StructType([T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType()), T.StructField("undeclared", T.BooleanType()), T.StructField("more", T.BooleanType()), T.StructField("orientation", T.IntegerType())])
#: Bytes of a file that are looked at first; the whole file goes to Python only where its size lies further on.
HEAD = 1 << 16
#: Image directories of a file that are looked at.
DIRECTORIES = 64

_Found = tuple[int | None, int | None, bool, bool, int]
_NOTHING: _Found = (None, None, False, False, 1)
_MORE: _Found = (None, None, False, True, 1)
#: Tags of an image directory.
SUBFILE, WIDTH, HEIGHT, ORIENTATION, SUBDIRECTORIES = 254, 256, 257, 274, 330


def _found(width: int, height: int, orientation: int = 1) -> _Found:
    if not (0 < width < 1 << 31 and 0 < height < 1 << 31):
        return _NOTHING
    orientation = orientation if 1 <= orientation <= 8 else 1
    return (height, width, False, False, orientation) if orientation > 4 else (width, height, False, False, orientation)


def _jpeg(data: bytes) -> _Found:
    at, orientation = 2, 1
    while at + 9 <= len(data) and data[at] == 0xFF:
        kind = data[at + 1]
        if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):  # a frame header
            return _found(int.from_bytes(data[at + 7 : at + 9]), int.from_bytes(data[at + 5 : at + 7]), orientation)
        if kind == 0xFF or 0xD0 <= kind <= 0xD8 or kind == 1:  # filling and markers without a body
            at += 1 if kind == 0xFF else 2
        else:
            end = at + 2 + int.from_bytes(data[at + 2 : at + 4])
            if kind == 0xE1 and data[at + 4 : at + 10] == b"Exif\0\0":
                tags, _ = _directory(data[at + 10 : end], None) or ({}, 0)
                orientation = tags.get(ORIENTATION, [1])[0]
            at = end
    return _MORE if at + 9 > len(data) else _NOTHING


def _directory(data: bytes, at: int | None) -> tuple[dict[int, list[int]], int | None] | None:
    """The tags that matter of the image directory at a place (None: the first one), and the place of the next (None: beyond the data); None if it isn't whole."""
    if data[:2] not in (b"II", b"MM") or len(data) < 8:
        return None
    end = "<" if data[:2] == b"II" else ">"
    if at is None:
        at = struct.unpack_from(end + "I", data, 4)[0]
    if at < 8 or at + 2 > len(data):
        return None
    entries = struct.unpack_from(end + "H", data, at)[0]
    after = at + 2 + 12 * entries
    if after > len(data):
        return None
    tags = {}
    for k in range(entries):
        place = at + 2 + 12 * k
        tag, kind, count = struct.unpack_from(end + "HHI", data, place)
        if tag not in (SUBFILE, WIDTH, HEIGHT, ORIENTATION, SUBDIRECTORIES) or kind not in (3, 4, 13) or not 1 <= count <= DIRECTORIES:
            continue
        form, size = ("H", 2) if kind == 3 else ("I", 4)
        place = place + 8 if count * size <= 4 else struct.unpack_from(end + "I", data, place + 8)[0]
        if place + count * size > len(data):
            return None
        tags[tag] = list(struct.unpack_from(f"{end}{count}{form}", data, place))
    return tags, struct.unpack_from(end + "I", data, after)[0] if after + 4 <= len(data) else None


def _tiff(data: bytes) -> _Found:
    """The full image of the first frame that has one.

    A frame is a directory of the chain with its subdirectories, the form of most camera files: there the first
    directory is often a thumbnail, which says so, and the full image, the largest that isn't marked as reduced or as
    a mask, is one below. A file of reduced images only has the size of the largest. The first directory tells how the
    pixels lie, unless the image's own does.
    """
    following, seen, reduced = None, set(), []
    first = 1
    while len(seen) < DIRECTORIES:
        read = _directory(data, following)
        if read is None:
            return _MORE
        tags, onward = read
        if following is None:
            first = tags.get(ORIENTATION, [1])[0]
        frame = [tags]
        for at in tags.get(SUBDIRECTORIES, []):
            if at in seen:
                continue
            seen.add(at)
            below = _directory(data, at)
            if below is None:
                return _MORE
            frame.append(below[0])
        sizes = [(t[WIDTH][0] * t[HEIGHT][0], t[WIDTH][0], t[HEIGHT][0], t.get(ORIENTATION, [first])[0], t.get(SUBFILE, [0])[0] & ~2) for t in frame if WIDTH in t and HEIGHT in t]
        full = [x for x in sizes if x[4] == 0 and x[0]]
        if full:
            return _found(*max(full, key=lambda x: x[0])[1:4])
        reduced += [x for x in sizes if x[4] == 1]
        if onward is None:
            return _MORE
        if not onward or onward in seen:
            break
        seen.add(onward)
        following = onward
    return _found(*max(reduced, key=lambda x: x[0])[1:4]) if reduced else _NOTHING


def _webp(data: bytes) -> _Found:
    kind = data[12:16]
    if kind == b"VP8X" and len(data) >= 30:
        return _found(1 + int.from_bytes(data[24:27], "little"), 1 + int.from_bytes(data[27:30], "little"))
    if kind == b"VP8L" and len(data) >= 25 and data[20] == 0x2F:
        bits = int.from_bytes(data[21:25], "little")
        return _found(1 + (bits & 0x3FFF), 1 + (bits >> 14 & 0x3FFF))
    if kind == b"VP8 " and len(data) >= 30 and data[23:26] == b"\x9d\x01\x2a":
        return _found(int.from_bytes(data[26:28], "little") & 0x3FFF, int.from_bytes(data[28:30], "little") & 0x3FFF)
    return _NOTHING


def _boxes(data: bytes, at: int, end: int) -> list[tuple[bytes, int, int]]:
    """Kind, start and end of the content of each box; one that is not whole is the last."""
    out = []
    while at + 8 <= end:
        size, kind, head = int.from_bytes(data[at : at + 4]), data[at + 4 : at + 8], 8
        if size == 1 and at + 16 <= end:
            size, head = int.from_bytes(data[at + 8 : at + 16]), 16
        if size == 0:
            size = end - at
        if size < head:
            break
        out.append((kind, at + head, at + size))
        at += size
    return out


def _associations(body: bytes) -> dict[int, list[int]]:
    """The places of each item's properties, from 1 on, by an ipma box's content."""
    wide_id, wide_place = body[0] > 0, body[3] & 1
    out: dict[int, list[int]] = {}
    at = 8
    for _ in range(int.from_bytes(body[4:8])):
        size = 4 if wide_id else 2
        item, n = int.from_bytes(body[at : at + size]), body[at + size] if at + size < len(body) else 0
        at += size + 1
        step = 2 if wide_place else 1
        mask = 0x7FFF if wide_place else 0x7F
        if at + n * step > len(body):
            break
        out.setdefault(item, []).extend(int.from_bytes(body[at + k * step : at + (k + 1) * step]) & mask for k in range(n))
        at += n * step
    return out


#: Quarter turns against the clock of a HEIF item, as orientations.
TURNS = (1, 8, 3, 6)


def _heif(data: bytes) -> _Found:
    """The primary item of a HEIC or AVIF file, turned as its properties say; without one, the largest image."""
    for kind, start, end in _boxes(data, 0, len(data)):
        if kind != b"meta":
            continue
        if end > len(data):
            return _MORE
        primary, properties, of_item = None, [], {}
        for part, a, b in _boxes(data, start + 4, end):
            if part == b"pitm" and b - a >= 6:
                primary = int.from_bytes(data[a + 4 : a + 6] if data[a] == 0 else data[a + 4 : a + 8])
            for inner, c, d in _boxes(data, a, b) if part == b"iprp" else []:
                if inner == b"ipco":
                    properties = [(name, data[x:y]) for name, x, y in _boxes(data, c, d)]
                elif inner == b"ipma" and d - c >= 8:
                    for item, places in _associations(data[c:d]).items():
                        of_item.setdefault(item, []).extend(places)
        own = [properties[k - 1] for k in of_item.get(primary, []) if 0 < k <= len(properties)]
        sizes = [struct.unpack_from(">II", body, 4) for name, body in own if name == b"ispe" and len(body) >= 12]
        if sizes:
            turns = [body[0] & 3 for name, body in own if name == b"irot" and body]
            return _found(*sizes[0], TURNS[turns[0] if turns else 0])
        sizes = [struct.unpack_from(">II", body, 4) for name, body in properties if name == b"ispe" and len(body) >= 12]
        return _found(*max(sizes, key=lambda s: s[0] * s[1])) if sizes else _NOTHING
    return _MORE if _boxes(data, 0, len(data))[-1:] else _NOTHING


def image_header(data: bytes | None) -> _Found:
    """What the first bytes of a file declare: width, height, undeclared, more, orientation."""
    data = data or b""
    if data[:8] == b"\x89PNG\r\n\x1a\n" and len(data) >= 24:
        return _found(int.from_bytes(data[16:20]), int.from_bytes(data[20:24]))
    if data[:4] == b"GIF8" and len(data) >= 10:
        return _found(int.from_bytes(data[6:8], "little"), int.from_bytes(data[8:10], "little"))
    if data[:2] == b"BM" and len(data) >= 26:
        return _found(int.from_bytes(data[18:22], "little", signed=True), abs(int.from_bytes(data[22:26], "little", signed=True)))
    if data[:2] == b"\xff\xd8":
        return _jpeg(data)
    if data[:4] in (b"II*\0", b"MM\0*", b"IIRO", b"IIRS", b"MMOR"):
        return _tiff(data)
    if data[:4] == b"RIFF" and data[8:12] == b"WEBP":
        return _webp(data)
    if data[4:8] == b"ftyp":
        return _heif(data)
    if data[:15] == b"FUJIFILMCCD-RAW":
        return None, None, True, False, 1
    return _NOTHING


def image_size(data: bytes | None) -> tuple[int | None, int | None]:
    """Width and height that a whole file declares; nulls where it does not."""
    return image_header(data)[:2]


@F.pandas_udf(SIZE)
def _read(heads: pd.Series) -> pd.DataFrame:
    found = pd.DataFrame([image_header(h) for h in heads], columns=["width", "height", "undeclared", "more", "orientation"])
    return found.astype({"width": "Int32", "height": "Int32", "undeclared": "bool", "more": "bool", "orientation": "int32"})


def declared_size(content: Column) -> Column:
    """struct<width, height, undeclared, orientation> of each file's content, of which HEAD bytes go to Python unless the size lies beyond."""
    first = _read(F.substring(content, 1, HEAD))
    whole = _read(F.when(first["more"] & (F.octet_length(content) > HEAD), content))
    sides = [F.coalesce(first[c], whole[c]).alias(c) for c in ("width", "height")]
    return F.struct(*sides, (first["undeclared"] | whole["undeclared"]).alias("undeclared"), F.when(first["more"], whole["orientation"]).otherwise(first["orientation"]).alias("orientation"))
