"""Near-duplicate documents by an inverted join of MinHash signature coordinates.

A signature has COORDINATES minima of hashed word shingles. Two documents are candidates if MATCHES of
their coordinates agree, which is a count-threshold join over the lists (coordinate, value) -> documents.

* Prefix: documents that agree in MATCHES of their coordinates share one among any
  COORDINATES - MATCHES + 1 of each, if both take them by one order. Rarest values come first in it, so a
  document's values of its own fill its prefix and it is posted only where another one can be met.
* Skip: values in very long lists come last, so most of these lists are in no prefix and are never merged;
  whether they agree is read off the signatures of the candidates that the short lists gave.
* Documents with equal shingle sets are one. Each document is first compared with one other, the centre of
  most of its lists. Only lists that hold several components after that are merged: their members are
  compared across components in tiles of bounded size, many small tiles to a task's step; long lists are
  cut by ranges of shingle counts, and only ranges whose counts allow a link meet. A pair is compared in
  the first list that both its documents are posted in. The likeliest pairs go first, one for
  each two components at most. The last round tests all pairs above the match threshold that may still
  join components. It does so inside the tiles, to which the texts of documents in such pairs are brought,
  so that the pairs, which may be very many among texts just below the similarity, are never rows.

Minima are 64 bits wide: with 32, documents without a shingle in common would meet ever more often as
their number grows. Every link is confirmed on the full shingle sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from .common import arrow_schema, bounded, discard, in_steps, slices, stash, tile_rows, tile_sides, tiles_of, words_of
from .components import Union, labelled

#: At a similarity of 0.75 a pair agrees in 24 coordinates on average; fewer than 12 has odds of 1.5 in a million.
COORDINATES, MATCHES = 32, 12
#: Words to a shingle, and the similarity (in hundredths) that makes a link.
WORDS, SIMILAR = 5, 75
#: Coordinates of the whole signature, which checks candidates, and how many of them must agree: at 0.75 fewer have odds
#: of 4 in 100 000.
CHECKED, CHECKED_MATCHES = 256, 164
#: Documents on each side of a tile, and rows that one step of a task takes on average (a tile's at least).
TILE, STEP_ROWS = 512, 1024
#: Bytes of text on each side of a tile, and in a step, where texts are compared (one text at least).
STEP_BYTES = 4 << 20
#: Pairs of a tile that are compared at a time.
BLOCK = 1 << 13
#: Bands that sizes as far apart as a link allows span, and how far apart their bands may be (one more, for rounding).
BANDS, REACH = 4, 5
#: Agreeing coordinates that make a pair likely; such pairs are tried before the rest.
LIKELY = 194

#: Places in `slot` for the coordinate; the other bits are of the value.
_PLACE = 63
_STEP = np.uint64(0x9E3779B97F4A7C15)
_RNG = np.random.default_rng(8)
_XOR = _RNG.integers(0, 1 << 64, CHECKED, dtype=np.uint64)
_TIMES = _RNG.integers(0, 1 << 63, CHECKED, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mixed(h: np.ndarray, by: int = 0) -> np.ndarray:
    """A bijection of 64-bit numbers that looks random."""
    h = h ^ np.uint64(by)
    for shift, times in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(times)
    return h ^ (h >> np.uint64(33))


def shingles(texts: pa.Array, width: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the distinct shingles of each text, sorted, and where each text's hashes start.

    A-Z count as a-z. A text with fewer words than `width` has its whole sequence as one shingle, a text
    without words has none.
    """
    words, starts = words_of(texts)
    n = np.diff(starts)
    if not len(words):
        return np.empty(0, dtype=np.uint64), np.zeros(len(starts), dtype=np.int64)
    encoded = words.dictionary_encode()
    known = pd.util.hash_array(pc.ascii_lower(encoded.dictionary).to_numpy(zero_copy_only=False), categorize=False)
    ids = known[np.asarray(encoded.indices)]
    span = np.minimum(n, width)
    count = np.where(n > 0, n - span + 1, 0)
    doc = np.repeat(np.arange(len(n)), count)
    first = np.repeat(starts[:-1] - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
    h = span[doc].astype(np.uint64)
    for k in range(width):
        at = first + k
        if k < int(span.min(initial=width)):
            h = h * _STEP + ids[at]
        else:
            inside = k < span[doc]
            h[inside] = h[inside] * _STEP + ids[at[inside]]
    h = _mixed(h)
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[new], np.concatenate([[0], np.cumsum(np.bincount(doc[new], minlength=len(n)))])


SIGNED = T.StructType(
    [
        T.StructField("n_shingles", T.LongType()),
        T.StructField("low", T.LongType()),
        T.StructField("high", T.LongType()),
        T.StructField("slots", T.BinaryType()),
        T.StructField("sketch", T.BinaryType()),
    ]
)


def sign(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, number of shingles, 128 bits that stand for the whole shingle set, `slots` and `sketch` (null without shingles).

    slots: a 64-bit number for each of the first COORDINATES minima, the coordinate in its low bits. sketch:
    32 bits of each of those, and one byte of each other minimum. Bytes agree wherever minima do, and once in
    256 times elsewhere, so that checking them loses nothing.
    """
    schema = T.StructType([df.schema[key]] + SIGNED.fields)
    to = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                h, starts = shingles(part.column(text))
                n = np.diff(starts)
                full = n > 0
                at = starts[:-1][full]
                listed = np.empty((len(at), COORDINATES), dtype=np.uint64)
                others = np.empty((len(at), CHECKED - COORDINATES), dtype=np.uint8)
                low, high = np.zeros(len(n), dtype=np.int64), np.zeros(len(n), dtype=np.int64)
                if len(at):
                    short = (h >> np.uint64(32)).astype(np.uint32)
                    for k in range(CHECKED):
                        if k < COORDINATES:
                            least = np.minimum.reduceat((h ^ _XOR[k]) * _TIMES[k], at)
                            listed[:, k] = (_mixed(least, k) & ~np.uint64(_PLACE)) | np.uint64(k)
                        else:
                            others[:, k - COORDINATES] = np.minimum.reduceat((short ^ _XOR[k].astype(np.uint32)) * _TIMES[k].astype(np.uint32), at).astype(np.uint8)
                    low[full] = np.add.reduceat(_mixed(h, 1), at).view(np.int64)
                    high[full] = np.bitwise_xor.reduceat(_mixed(h, 2), at).view(np.int64)
                sketch = np.hstack([(listed >> np.uint64(8)).astype("<u4").view(np.uint8).reshape(len(at), 4 * COORDINATES), others])
                columns = [part.column(key), pa.array(n), pa.array(low), pa.array(high)]
                for rows, name in ((listed.astype("<u8").view(np.uint8).reshape(len(at), 8 * COORDINATES), "slots"), (sketch, "sketch")):
                    each = iter(rows)
                    columns.append(pa.array([next(each).tobytes() if f else None for f in full], to.field(name).type))
                yield pa.RecordBatch.from_arrays(columns, schema=to)

    return bounded(df.select(key, text)).mapInArrow(run, schema)


def posted(reps: DataFrame) -> DataFrame:
    """(rep, slot) for each listed coordinate."""
    to = pa.schema([("rep", pa.int64()), ("slot", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slots = np.frombuffer(b"".join(batch.column("slots").to_pylist()), dtype="<i8")
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.asarray(batch.column("rep")), COORDINATES)), pa.array(slots)], schema=to)

    return bounded(reps.select("rep", "slots")).mapInArrow(run, "rep long, slot long")


def lists(reps: DataFrame) -> DataFrame:
    """(rep, slot, posted, centre) for the slots in each document's prefix where another one is posted too.

    posted: a bit for each coordinate that the document has rows for. centre: the member that shares its
    values with most documents, which in a group of edited copies is the one they stem from.
    """
    every = posted(reps)
    shared = stash(every.groupBy("slot").agg(F.count("*").alias("count")).where(F.col("count") > 1))
    met = every.join(shared, "slot").groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("count", "slot"))).alias("met"))  # COORDINATES entries at most
    # The values of its own come first, and fill COORDINATES - size(met) places.
    left = F.size("met") - (MATCHES - 1)
    chosen = met.where(left > 0).select("rep", F.slice("met", F.lit(1), left).alias("met"))
    bits = F.aggregate("met", F.lit(0).cast("long"), lambda had, x: had.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), x["slot"].bitwiseAND(_PLACE).cast("int"))))
    often = F.aggregate("met", F.lit(0).cast("long"), lambda had, x: had + x["count"])
    rank = often * F.lit(1 << 16) + F.pmod(F.xxhash64("rep"), F.lit(1 << 16))
    rows = stash(chosen.select("rep", bits.alias("posted"), rank.alias("rank"), F.explode("met.slot").alias("slot")))
    discard(shared)
    centres = rows.groupBy("slot").agg(F.count("*").alias("n"), F.max_by("rep", "rank").alias("centre")).where(F.col("n") > 1)
    out = stash(rows.join(centres, "slot").select("rep", "slot", "posted", "centre"))
    discard(rows)
    return out


def _unpacked(sketches: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """32 bits of the listed minima and the bytes of the other ones, a row for each sketch."""
    rows = np.frombuffer(b"".join(sketches), dtype=np.uint8).reshape(len(sketches), 3 * COORDINATES + CHECKED)
    return np.ascontiguousarray(rows[:, : 4 * COORDINATES]).view(np.uint32), rows[:, 4 * COORDINATES :]


def alike(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two sets of shingle hashes, sorted, are similar enough."""
    shared = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * shared >= SIMILAR * (len(x) + len(y) - shared) > 0


def similar(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose shingle sets are similar enough; texts: (rep, text)."""
    both = pairs.join(texts.select(F.col("rep").alias("a"), F.col("text").alias("text_a")), "a").join(texts.select(F.col("rep").alias("b"), F.col("text").alias("text_b")), "b")
    to = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text_b"):
                (h, s), (g, t) = shingles(part.column("text_a")), shingles(part.column("text_b"))
                mask = pa.array([alike(h[s[k] : s[k + 1]], g[t[k] : t[k + 1]]) for k in range(part.num_rows)])
                yield pa.RecordBatch.from_arrays([part.column("a").filter(mask), part.column("b").filter(mask)], schema=to)

    return bounded(both.select("a", "b", "text_a", "text_b")).mapInArrow(confirm, "a long, b long")


def agreeing(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """The pairs (a, b) that agree in MATCHES listed and CHECKED_MATCHES of all coordinates, and whose sizes allow a link."""
    sides = [reps.select(F.col("rep").alias(c), F.col("sketch").alias(f"sketch_{c}"), F.col("n_shingles").alias(f"n_{c}")) for c in "ab"]
    both = pairs.join(sides[0], "a").join(sides[1], "b").where(100 * F.least("n_a", "n_b") >= SIMILAR * F.greatest("n_a", "n_b"))  # else they share too little

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (x, xs), (y, ys) = (_unpacked(batch.column(f"sketch_{c}").to_pylist()) for c in "ab")
            listed = (x == y).sum(axis=1)
            keep = (listed >= MATCHES) & (listed + (xs == ys).sum(axis=1) >= CHECKED_MATCHES)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep))

    return bounded(both.select("a", "b", "sketch_a", "sketch_b")).mapInArrow(count, "a long, b long")


def _across(tile: dict[str, np.ndarray], least: int, forest: bool) -> np.ndarray:
    """(matches, a, b, component of a, of b) of the pairs of one tile that agree in `least` coordinates and lie in different components.

    With `forest` only those that join components which the pairs with more agreement have not joined.
    """
    at = int(tile["slot"][0]) & _PLACE
    rep, of, size, bits, listed, others = (tile[c] for c in ("rep", "component", "n_shingles", "posted", "listed", "others"))
    rows, cols, one = tile_sides(tile)
    if one:  # those outside the tile's largest component against all
        known, often = np.unique(of, return_counts=True)
        main = known[often.argmax()]
        rows = np.flatnonzero(of != main)
    found = [np.empty((0, 5), dtype=np.int64)]
    step = max(1, BLOCK // max(1, len(cols)))
    for lo in range(0, len(rows) if len(cols) else 0, step):
        some = rows[lo : lo + step]
        a, b = np.repeat(some, len(cols)), np.tile(cols, len(some))
        ok = (of[a] != of[b]) & (100 * np.minimum(size[a], size[b]) >= SIMILAR * np.maximum(size[a], size[b]))
        if one:
            ok &= (of[b] == main) | (rep[a] < rep[b])
        if "part" in tile:  # a piece of a larger tile, which has sides of its own
            ok &= tile["whole"][a] | (tile["part"][a] != tile["part"][b])
        a, b = a[ok], b[ok]
        agree = listed[a] == listed[b]
        matches = agree.sum(axis=1)
        both = (bits[a] & bits[b])[:, None] >> np.arange(COORDINATES) & 1 > 0
        ok = (matches >= MATCHES) & ((agree & both).argmax(axis=1) == at)  # the first list that has both
        a, b, matches = a[ok], b[ok], matches[ok]
        matches = matches + (others[a] == others[b]).sum(axis=1)
        ok = matches >= least
        a, b = a[ok], b[ok]
        found.append(np.stack([matches[ok], rep[a], rep[b], of[a], of[b]], axis=1))
    pairs = np.concatenate(found)
    if forest and len(pairs):
        joined, order = Union(), np.argsort(-pairs[:, 0], kind="stable")
        pairs = pairs[[k for k in order.tolist() if joined.joins(int(pairs[k, 3]), int(pairs[k, 4]))]]
    return pairs


TILED = ["slot", "i", "j", "side", "rep", "component", "n_shingles", "posted"]


def _read(pdf: pd.DataFrame, names: list[str]) -> dict[str, np.ndarray]:
    columns = {c: pdf[c].to_numpy() for c in names}
    columns["listed"], columns["others"] = _unpacked(pdf["sketch"].tolist())
    return columns


def _likeliest(pdf: pd.DataFrame) -> pd.DataFrame:
    """Likely pairs of all tiles of a step, as many as join components there."""
    m, a, b, x, y = np.concatenate([_across(tile, LIKELY, True) for tile in tiles_of(_read(pdf, TILED), ["slot"])]).T
    return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b), "matches": m, "x": np.minimum(x, y), "y": np.maximum(x, y)})


def _involved(pdf: pd.DataFrame) -> pd.DataFrame:
    """The documents of each tile of a step that are in a candidate pair there."""
    found = []
    for tile in tiles_of(_read(pdf, TILED), ["slot"]):
        pairs = _across(tile, CHECKED_MATCHES, False)
        here = np.isin(tile["rep"], pairs[:, 1:3])
        found.append(pd.DataFrame({c: tile[c][here] for c in TILED}))
    return pd.concat(found)


def _confirmed(pdf: pd.DataFrame) -> pd.DataFrame:
    """Links that connect whatever the candidate pairs of each tile connect, by their full shingle sets."""
    columns = _read(pdf, [*TILED, "tile", "whole", "part"])
    batch = pa.record_batch([pa.array(pdf["text"], pa.large_string())], ["text"])
    sets = []
    for part in slices(batch, "text"):
        h, starts = shingles(part.column(0))
        sets += [h[starts[k] : starts[k + 1]] for k in range(part.num_rows)]
    columns["row"] = np.arange(len(pdf))
    out = [np.empty((0, 2), dtype=np.int64)]
    for tile in tiles_of(columns, ["slot", "tile"]):
        row, joined = dict(zip(tile["rep"].tolist(), tile["row"].tolist(), strict=True)), Union()
        pairs = _across(tile, CHECKED_MATCHES, False)
        for _, a, b, x, y in pairs[np.argsort(-pairs[:, 0], kind="stable")].tolist():
            if joined.top(x) != joined.top(y) and alike(sets[row[a]], sets[row[b]]):
                joined.joins(x, y)
                out.append(np.array([[min(a, b), max(a, b)]]))
    return pd.DataFrame(np.concatenate(out), columns=["a", "b"])


def _band(size: Column) -> Column:
    """Numbers bands of sizes. Sizes that allow a link lie at most REACH bands apart."""
    return F.floor(F.log(size) * (BANDS / math.log(100 / SIMILAR))).cast("int")


def cut(bands: dict[int, list[tuple[int, int]]], tile: int) -> list[tuple[int, int, int, int, int, int, int, int]]:
    """Blocks of one list: (main, band, first, blocks, low, high, low_main, high_main) for each band and kind.

    bands: for main = 0 (members outside the largest component) and 1 (members of it) the bands with their
    numbers of members. Bands in order share a block until it holds `tile` members; a larger band has several
    blocks, from `first` on, to be dealt at random. Blocks of main are numbered after the other ones. The
    blocks to compare with, of bands within reach, are low to high and low_main to high_main; two of main
    never meet.
    """
    placed, ranges = [], {0: [], 1: []}
    for main in (0, 1):
        start, held = len(ranges[0]) if main else 0, 0
        for band, n in sorted(bands.get(main, [])):
            blocks = -(-n // tile)
            if blocks == 1 and held and held + n <= tile:
                held += n
                ranges[main][-1] = (ranges[main][-1][0], band)
                placed.append((main, band, start + len(ranges[main]) - 1, 1))
            else:
                held = n if blocks == 1 else 0
                placed.append((main, band, start + len(ranges[main]), blocks))
                ranges[main] += [(band, band)] * blocks
    reached = {}
    for main, start in ((0, 0), (1, len(ranges[0]))):
        for low, high in set(ranges[0] + ranges[1]):
            near = [k + start for k, (x, y) in enumerate(ranges[main]) if x - high <= REACH and low - y <= REACH]
            reached[main, low, high] = (near[0], near[-1]) if near else (0, -1)
    out = []
    for main, band, first, blocks in placed:
        of = ranges[main][first - (len(ranges[0]) if main else 0)]
        out.append((main, band, first, blocks, *reached[0, *of], *((0, -1) if main else reached[1, *of])))
    return out


CUT = "slot long, main int, band int, first int, blocks int, low int, high int, low_main int, high_main int"


def _cuts(pdf: pd.DataFrame) -> pd.DataFrame:
    bands: dict[int, list[tuple[int, int]]] = {}
    for main, band, n in pdf[["main", "band", "n"]].itertuples(index=False):
        bands.setdefault(int(main), []).append((int(band), int(n)))
    return pd.DataFrame([(pdf["slot"].iloc[0], *row) for row in cut(bands, TILE)], columns=[c.split()[0] for c in CUT.split(", ")])


def tiled(listed: DataFrame, parts: DataFrame, reps: DataFrame) -> DataFrame:
    """Tiles of the lists that hold several components, dealt to steps: TILED, sketch and step.

    A list of TILE members or fewer is one tile. A longer one is cut into blocks by ranges of size, and only
    blocks whose sizes allow a link meet. Cuts are made from the counts of its bands, of which there are at
    most as many as sizes have digits to base 100 / SIMILAR, times BANDS.
    """
    sized = parts.join(reps.select("rep", "n_shingles"), "rep")
    placed = listed.select("rep", "slot", "posted").join(sized, "rep")
    sizes = placed.groupBy("slot", "component").agg(F.count("*").alias("size"))
    mixed = sizes.groupBy("slot").agg(F.sum("size").alias("n"), F.max(F.struct("size", "component")).alias("top")).where(F.col("n") > F.col("top.size"))
    mixed = stash(mixed.select("slot", F.col("top.component").alias("top"), (F.col("n") > TILE).alias("long")))
    members = placed.join(mixed, "slot").withColumns({"main": (F.col("component") == F.col("top")).cast("int"), "band": _band(F.col("n_shingles"))})
    counts = placed.join(mixed.where("long"), "slot").groupBy("slot", (F.col("component") == F.col("top")).cast("int").alias("main"), _band(F.col("n_shingles")).alias("band")).agg(F.count("*").alias("n"))
    cuts = stash(counts.groupBy("slot").applyInPandas(_cuts, CUT))
    found = members.join(cuts, ["slot", "main", "band"], "left")
    found = found.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in (("first", 0), ("blocks", 1), ("low", 0), ("high", 0), ("low_main", 0), ("high_main", -1))})  # not long
    block = (F.col("first") + F.pmod(F.xxhash64("rep"), F.col("blocks"))).cast("int")
    ranges = [F.when(F.col(high) >= F.col(low), F.sequence(low, high)).otherwise(F.array().cast("array<int>")) for low, high in (("low", "high"), ("low_main", "high_main"))]
    columns = ["slot", "rep", "component", "posted", "n_shingles"]
    met = found.select(*columns, block.alias("block"), F.explode(F.concat(*ranges)).alias("other"))
    rows = stash(met.select(*columns, F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), (F.col("block") > F.col("other")).cast("int").alias("side")))
    discard(mixed, cuts)
    return in_steps(rows, ["slot"], rows.count() // STEP_ROWS).join(reps.select("rep", "sketch"), "rep")


def likely_pairs(listed: DataFrame, parts: DataFrame, reps: DataFrame) -> DataFrame:
    """Likely pairs (a, b) of different components, one for two components at most."""
    found = tiled(listed, parts, reps).groupBy("step").applyInPandas(_likeliest, "a long, b long, matches long, x long, y long")
    return found.groupBy("x", "y").agg(F.max(F.struct("matches", "a", "b")).alias("best")).select("best.a", "best.b")


def remaining_links(listed: DataFrame, parts: DataFrame, reps: DataFrame, texts: DataFrame) -> DataFrame:
    """A stash of links (a, b) that join all components which any candidate pair links."""
    kinds = "slot long, i int, j int, side int, rep long, component long, n_shingles long, posted long"
    found = stash(tiled(listed, parts, reps).groupBy("step").applyInPandas(_involved, kinds))
    sized = found.join(texts.select("rep", F.octet_length("text").alias("bytes")), "rep")
    sized = sized.select("slot", F.xxhash64("slot", "i", "j").alias("tile"), (F.col("i") == F.col("j")).alias("whole"), F.col("side").alias("part"), "rep", "component", "n_shingles", "posted", "bytes")
    key = ["slot", "tile"]
    totals = sized.groupBy(*key).agg(F.sum("bytes").alias("all_bytes"))
    kept = [*key, "whole", "part", "rep", "component", "n_shingles", "posted"]
    rows = stash(tile_rows(sized.join(totals, key), [*kept, "bytes"], F.col("all_bytes"), F.lit(0), F.lit(False), STEP_BYTES))
    steps = (rows.agg(F.sum("bytes")).first()[0] or 0) // STEP_BYTES
    full = in_steps(rows.drop("bytes"), key, steps).join(reps.select("rep", "sketch"), "rep").join(texts, "rep")
    links = stash(full.groupBy("step").applyInPandas(_confirmed, "a long, b long"))
    discard(found, rows)
    return links


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_shingles, component_id, kept) for each row of df.

    Rows are linked if the intersection of their shingle sets is 75 hundredths of the union or more.
    component_id is the smallest key reachable over links, itself included; kept marks the rows whose key
    it is. Rows with equal sets are linked without comparing them. Null texts and texts without words have
    no shingles and are linked with nothing. A null key is never linked and keeps a null component_id; rows
    that share a key are one node. Other columns are not looked at.
    """
    docs = df.select(F.col(key).cast("long").alias("doc"), F.col(text).alias("text"))
    signed = stash(sign(docs, "doc", "text"))
    same = ["n_shingles", "low", "high"]
    classes = stash(signed.where((F.col("n_shingles") > 0) & F.col("doc").isNotNull()).groupBy(*same).agg(F.min("doc").alias("rep")))
    placed = stash(signed.select("doc", *same).join(classes, same, "left").select("doc", "n_shingles", F.when(F.col("doc").isNotNull(), F.coalesce("rep", "doc")).alias("rep")))
    own = classes.select(F.col("rep").alias("doc"), *same)
    reps = stash(signed.join(own, ["doc", *same], "left_semi").select(F.col("doc").alias("rep"), "n_shingles", "slots", "sketch").dropDuplicates(["rep"]))
    discard(signed, classes)
    listed = lists(reps)
    texts = stash(docs.join(listed.select(F.col("rep").alias("doc")).distinct(), "doc", "left_semi").select(F.col("doc").alias("rep"), "text").dropDuplicates(["rep"]))

    # Each document is tried with the one that is the centre of most of its lists.
    hits = listed.where(F.col("rep") != F.col("centre")).groupBy("rep", "centre").agg(F.count("*").alias("hits"))
    tried = hits.groupBy("rep").agg(F.max_by("centre", F.struct("hits", "centre")).alias("centre"))
    first = agreeing(tried.select(F.col("rep").alias("a"), F.col("centre").alias("b")), reps)
    pairs = stash(first.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    links = stash(similar(pairs, texts))

    # Whatever candidates are still apart: first likely ones, then all.
    parts = stash(labelled(reps, links))
    likely = stash(likely_pairs(listed, parts, reps).join(pairs, ["a", "b"], "left_anti"))
    discard(pairs)
    for more in (lambda: stash(similar(likely, texts)), lambda: remaining_links(listed, parts, reps, texts)):
        new, old = more(), (links, parts)
        if new.limit(1).count():
            links = stash(links.union(new))
            parts = stash(labelled(reps, links))
            discard(*old)
        discard(new)
    discard(reps, listed, texts, likely, links)
    out = placed.join(parts, "rep", "left").withColumn("component_id", F.coalesce("component", "doc"))
    return out.select(F.col("doc").alias(key), "n_shingles", "component_id", F.col("doc").eqNullSafe(F.col("component_id")).alias("kept"))
