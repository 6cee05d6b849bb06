"""Near-duplicate vectors by lattice hashing.

Each table projects a unit vector at random onto eight numbers and decodes them to the nearest point of the
lattice E8, whose cells are rounder than any other's in eight dimensions: near vectors mostly share a cell,
far ones hardly ever do. A vector also probes the neighbouring cells that it lies closest to.

Links are needed only to find components, so a cell never lists all its pairs: each vector is compared
with one other first, the centre of most of its cells, and only cells that hold several components after
that are compared across these, in tiles of bounded size, many small ones to a task's step. Tiles hold
vectors in a byte per number, with the error that this makes, so that no pair at or above the least cosine
is lost; what passes is verified in double precision. The likeliest pairs go first, one for each two
components at most; then all that still lie apart. Links never leave a component, so each component's
vectors are then compared once in tiles to count them.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, product

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded, discard, in_steps, stash, tile_rows, tile_sides, tiles_of
from .components import Union, labelled

#: At a cosine of 0.95 a table finds a pair with odds of 0.43, so that eight miss 1 in 100; chains make up for most of those.
TABLES, PROBES = 8, 3
#: Width of a lattice unit in projected distance. Wider cells find more, and hold more vectors that are far apart.
WIDTH = 1.0
#: Vectors on each side of a tile, and rows that one step of a task takes on average (a tile's at least).
TILE, STEP_ROWS = 512, 1024
#: Bytes of vectors, and vectors at most, on each side of a tile in which links are counted; and vectors compared there at a time.
COUNT_BYTES, COUNT_TILE, COUNT_BLOCK = 8 << 20, 4096, 256

#: The 240 shortest vectors of E8: two entries of +-1, or all of +-1/2 with an even number of minus signs.
NEIGHBOURS = np.array(
    [[s if k == i else t if k == j else 0 for k in range(8)] for i, j in combinations(range(8), 2) for s, t in product((-1, 1), repeat=2)]
    + [[x / 2 for x in signs] for signs in product((-1, 1), repeat=8) if np.prod(signs) > 0]
)


def _nearest_d8(y: np.ndarray) -> np.ndarray:
    """The nearest integer points with an even sum."""
    near = np.rint(y)
    odd = np.flatnonzero(near.sum(axis=1) % 2 != 0)
    gap = y[odd] - near[odd]
    worst = np.abs(gap).argmax(axis=1)
    near[odd, worst] += np.where(gap[np.arange(len(odd)), worst] >= 0, 1, -1)
    return near


def nearest_e8(y: np.ndarray) -> np.ndarray:
    """The nearest points of E8, which is D8 and D8 moved by one half in every coordinate."""
    a, b = _nearest_d8(y), _nearest_d8(y - 0.5) + 0.5
    closer = ((y - a) ** 2).sum(axis=1) <= ((y - b) ** 2).sum(axis=1)
    return np.where(closer[:, None], a, b)


def _cell(points: np.ndarray, times: np.ndarray) -> np.ndarray:
    return ((2 * points).astype(np.int64).view(np.uint64) * times).sum(axis=-1, dtype=np.uint64).view(np.int64)


def cells(unit: np.ndarray, tables: int = TABLES, probes: int = PROBES, width: float = WIDTH, seed: int = 3) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each table, every vector's own cell and the cells it probes (n x probes), as hashes."""
    rng = np.random.default_rng([seed, unit.shape[1]])
    for _ in range(tables):
        onto, shift = rng.standard_normal((unit.shape[1], 8)) / width, rng.random(8)
        times = rng.integers(0, 1 << 63, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        y = unit @ onto + shift
        home = nearest_e8(y)
        near = np.argpartition(-(y - home) @ NEIGHBOURS.T, probes, axis=1)[:, :probes]
        yield _cell(home, times), _cell(home[:, None, :] + NEIGHBOURS[near], times)


def _units(lists: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """Rows of equal length and their unit vectors in double precision, for each length."""
    length = np.asarray(lists.value_lengths())
    flat = np.asarray(lists.flatten(), dtype=np.float64)
    start = np.concatenate([[0], np.cumsum(length)])
    out = []
    for d in np.unique(length):
        at = np.flatnonzero(length == d)
        x = flat[start[at][:, None] + np.arange(d)]
        x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow in the squares
        out.append((at, x / np.sqrt((x * x).sum(axis=1, keepdims=True))))
    return out


def unit_vectors(vectors: DataFrame) -> DataFrame:
    """(rep, copies, unit, code, error) of vectors (rep, copies, vector).

    unit: the unit vector's doubles. code: the same in a byte for each number, after a float that they are
    multiplied by; error: the length of what that leaves out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, unit in _units(batch.column("vector")):
                scale = (np.abs(unit).max(axis=1, keepdims=True) / 127).astype("<f4")
                codes = np.rint(unit / scale).astype(np.int8)
                error = np.sqrt(((unit - scale.astype(np.float64) * codes) ** 2).sum(axis=1))
                code = np.hstack([scale.view(np.uint8), codes.view(np.uint8)])
                some = batch.take(pa.array(at))
                yield pa.RecordBatch.from_arrays([some.column("rep"), some.column("copies"), pa.array([x.tobytes() for x in unit.astype("<f8")]), pa.array([x.tobytes() for x in code]), pa.array(error)], names=["rep", "copies", "unit", "code", "error"])

    return bounded(vectors.select("rep", "copies", "vector")).mapInArrow(run, "rep long, copies long, unit binary, code binary, error double")


def _doubles(units: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Rows of equal length and their vectors, for each length."""
    length = np.array([len(u) for u in units])
    return [(at, np.frombuffer(b"".join([units[k] for k in at]), dtype="<f8").reshape(len(at), -1)) for d in np.unique(length) for at in [np.flatnonzero(length == d)]]


def post(vectors: DataFrame, tables: int, probes: int) -> DataFrame:
    """(slot, cell, rep, home): one row for each table, and one for each cell it probes there. A slot is a table and a length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rep = np.asarray(batch.column("rep"))
            for at, unit in _doubles(batch.column("unit").to_pylist()):
                for t, (home, near) in enumerate(cells(unit, tables, probes)):
                    n = len(at) * (1 + probes)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(n, unit.shape[1] * tables + t, dtype=np.int64)), pa.array(np.concatenate([home, near.T.reshape(-1)])), pa.array(np.tile(rep[at], 1 + probes)), pa.array(np.arange(n) < len(at))],
                        names=["slot", "cell", "rep", "home"],
                    )

    return bounded(vectors.select("rep", "unit")).mapInArrow(run, "slot long, cell long, rep long, home boolean")


def linked(pairs: DataFrame, vectors: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) with a cosine of `least` or more. Both must have the same length."""
    sides = [vectors.select(F.col("rep").alias(c), F.col("unit").alias(f"unit_{c}")) for c in "ab"]
    both = pairs.select("a", "b").join(sides[0], "a").join(sides[1], "b").select("a", "b", "unit_a", "unit_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, dtype=bool)
            for (at, x), (_, y) in zip(_doubles(batch.column("unit_a").to_pylist()), _doubles(batch.column("unit_b").to_pylist()), strict=True):
                keep[at] = np.einsum("ij,ij->i", x, y) >= least
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(keep)) for c in "ab"], names=["a", "b"])

    return bounded(both).mapInArrow(run, "a long, b long")


def _across(tile: dict[str, np.ndarray], least: float, likely: float | None) -> list[tuple[int, int, int, int, float]]:
    """(a, b, component of a, of b, cosine by the codes) of the pairs of one tile that may link and lie in different components.

    With `likely` only those of at least that cosine, and of these only the ones that join components which
    likelier pairs have not joined.
    """
    rows, cols, one = tile_sides(tile)
    rep, of, home, error = (tile[c] for c in ("rep", "component", "home", "error"))
    if one:  # those outside the tile's largest component against all
        known, often = np.unique(of, return_counts=True)
        main = known[often.argmax()]
        rows = np.flatnonzero(of != main)
    if not len(rows) or not len(cols):
        return []
    raw = np.frombuffer(b"".join(tile["code"].tolist()), dtype=np.uint8).reshape(len(rep), -1)
    x = np.ascontiguousarray(raw[:, :4]).view("<f4").astype(np.float64) * raw[:, 4:].view(np.int8)
    cosine = x[rows] @ x[cols].T
    apart = (of[rows, None] != of[cols]) & (home[rows, None] | home[cols])
    if one:
        apart &= (of[cols] == main) | (rep[rows, None] < rep[cols])
    # |xy - x'y'| <= |x - x'| |y| + |x'| |y - y'|; a little more for rounding.
    over = error[rows, None] + (1 + error[rows, None]) * error[cols] + 1e-9
    a, b = np.nonzero(apart & (cosine + over >= least if likely is None else cosine >= likely))
    value, a, b = cosine[a, b], rows[a], cols[b]
    found = list(zip(rep[a].tolist(), rep[b].tolist(), of[a].tolist(), of[b].tolist(), value.tolist(), strict=True))
    if likely is not None:
        joined = Union()
        found = [p for p in sorted(found, key=lambda p: -p[4]) if joined.joins(p[2], p[3])]
    return found


def unresolved(posted: DataFrame, parts: DataFrame, vectors: DataFrame, least: float, likely: float | None) -> DataFrame:
    """Pairs (a, b) of different components, within the cells that hold several, that may link; with `likely` one for two components."""
    key = ["slot", "cell"]
    placed = posted.join(parts, "rep")
    sizes = placed.groupBy(*key, "component").agg(F.count("*").alias("size"))
    mixed = sizes.groupBy(*key).agg(F.sum("size").alias("n"), F.max(F.struct("size", "component")).alias("top")).where(F.col("n") > F.col("top.size"))
    mixed = stash(mixed.select(*key, "n", F.col("top.component").alias("main"), F.col("top.size").alias("n_main")))
    members = placed.join(mixed, key)
    rows = stash(tile_rows(members, [*key, "rep", "home", "component"], F.col("n"), F.col("n_main"), F.col("component") == F.col("main"), TILE))
    discard(mixed)
    coded = in_steps(rows, key, rows.count() // STEP_ROWS).join(vectors.select("rep", "code", "error"), "rep")
    names = [*key, "i", "j", "side", "rep", "home", "component", "code", "error"]

    def step(pdf: pd.DataFrame) -> pd.DataFrame:
        found = [p for tile in tiles_of({c: pdf[c].to_numpy() for c in names}, key) for p in _across(tile, least, likely)]
        return pd.DataFrame([(min(a, b), max(a, b), min(x, y), max(x, y), cosine) for a, b, x, y, cosine in found], columns=["a", "b", "x", "y", "cosine"]).astype({"a": "int64", "b": "int64", "x": "int64", "y": "int64", "cosine": "float64"})

    found = stash(coded.groupBy("step").applyInPandas(step, "a long, b long, x long, y long, cosine double"))
    discard(rows)
    if likely is not None:
        return found.groupBy("x", "y").agg(F.max(F.struct("cosine", "a", "b")).alias("best")).select("best.a", "best.b").distinct()
    return found.select("a", "b").distinct()


def links_in(x: np.ndarray, copies: np.ndarray, rows: np.ndarray, cols: np.ndarray, one: bool, least: float) -> tuple[np.ndarray, np.ndarray]:
    """How many vectors each of rows links with among cols, and each of cols among rows, copies counted; with `one` rows are cols and none links with itself."""
    over, under = np.zeros(len(rows)), np.zeros(len(cols))  # doubles hold counts up to 2^53
    for lo in range(0, len(rows), COUNT_BLOCK):
        some = rows[lo : lo + COUNT_BLOCK]
        link = (x[some] @ x[cols].T >= least).astype(np.float64)
        if one:
            link[np.arange(len(some)), lo + np.arange(len(some))] = 0
        over[lo : lo + len(some)] = link @ copies[cols]
        under += copies[some] @ link
    return over.astype(np.int64), under.astype(np.int64)


def counted(parts: DataFrame, vectors: DataFrame, least: float) -> DataFrame:
    """(rep, found): how many vectors of its component each one links with, copies of the others included.

    Counting is quadratic in a component. What is shuffled for it is a member for each block of its
    component, so blocks are as large as a task's memory allows, by the length of the longest vector.
    """
    sizes = stash(parts.groupBy("component").count().where(F.col("count") > 1))
    members = parts.join(sizes, "component")
    longest = vectors.agg(F.max(F.octet_length("unit"))).first()[0] or 1
    tile = max(1, min(COUNT_TILE, COUNT_BYTES // longest))
    rows = stash(tile_rows(members, ["rep", "component"], F.col("count"), F.lit(0), F.lit(False), tile))
    placed = in_steps(rows, ["component"], rows.count() // STEP_ROWS).join(vectors.select("rep", "copies", "unit"), "rep")

    def step(pdf: pd.DataFrame) -> pd.DataFrame:
        reps, found = [], []
        for group in tiles_of({c: pdf[c].to_numpy() for c in ("component", "i", "j", "side", "rep", "copies", "unit")}, ["component"]):
            rows, cols, one = tile_sides(group)
            x = np.frombuffer(b"".join(group["unit"].tolist()), dtype="<f8").reshape(len(group["rep"]), -1)  # links are between equal lengths
            over, under = links_in(x, group["copies"].astype(np.float64), rows, cols, one, least)
            reps.append(group["rep"][rows])
            found.append(over)
            if not one:
                reps.append(group["rep"][cols])
                found.append(under)
        return pd.DataFrame({"rep": np.concatenate(reps), "found": np.concatenate(found)})

    return placed.groupBy("step").applyInPandas(step, "rep long, found long").groupBy("rep").agg(F.sum("found").alias("found"))


def near_vectors(df: DataFrame, key: str = "vec_id", vector: str = "embedding", least: float = 0.95, tables: int = TABLES, probes: int = PROBES) -> DataFrame:
    """(key, n_links, component_id, kept) for each row of df.

    Vectors with a cosine of `least` or more are linked, if the hashing meets a chain between them; none below
    it is. n_links counts the other rows linked directly, component_id is the smallest key reachable, kept
    marks the rows whose key it is. Equal vectors are one while searching and count each. Vectors that are null,
    empty, zero or hold null or non-finite components, and rows with a null key, link with nothing; vectors
    of different length do not link. Keys must be unique for exact counts. Other columns are not looked at.
    """
    rows = df.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    fit = F.coalesce(finite & F.exists("vector", lambda x: x != 0) & F.col("id").isNotNull(), F.lit(False))
    marked = rows.select("id", "vector", fit.alias("fit")).withColumns({"low": F.when(F.col("fit"), F.xxhash64("vector")), "high": F.when(F.col("fit"), F.xxhash64(F.lit(1), "vector"))})
    classes = stash(marked.where("fit").groupBy("low", "high").agg(F.min("id").alias("rep"), F.count("*").alias("copies")))
    placed = stash(marked.join(classes, ["low", "high"], "left").select("id", "rep", "copies", F.when(F.col("id") == F.col("rep"), F.col("vector")).alias("vector")))
    vectors = stash(unit_vectors(placed.where(F.col("id") == F.col("rep")).dropDuplicates(["rep"])))

    posted = stash(post(vectors, tables, probes))
    mask = F.xxhash64("slot")
    own = F.when(F.col("home"), F.col("rep").bitwiseXOR(mask))
    met = posted.groupBy("slot", "cell").agg(F.count("*").alias("n"), F.min(own).bitwiseXOR(mask).alias("centre")).where(F.col("centre").isNotNull() & (F.col("n") > 1))
    kept = stash(posted.join(met.select("slot", "cell", "centre"), ["slot", "cell"]))  # cells of one vector, or that are no vector's own, give no pair
    discard(classes, posted)
    hits = kept.where(F.col("rep") != F.col("centre")).groupBy("rep", "centre").agg(F.count("*").alias("hits"))
    tried = hits.groupBy("rep").agg(F.max_by("centre", F.struct("hits", "centre")).alias("centre"))
    pairs = stash(tried.select(F.least("rep", "centre").alias("a"), F.greatest("rep", "centre").alias("b")).distinct())
    links = stash(linked(pairs, vectors, least))

    # Whatever may link and is still apart: first likely pairs, then all.
    parts, kept_rows = stash(labelled(vectors, links)), kept.drop("centre")
    for likely in (least, None):
        more = stash(unresolved(kept_rows, parts, vectors, least, likely).join(pairs, ["a", "b"], "left_anti"))
        if not more.limit(1).count():
            continue
        old = (pairs, links, parts)
        pairs = stash(pairs.union(more))
        links = stash(links.union(linked(more, vectors, least)))
        parts = stash(labelled(vectors, links))
        discard(*old, more)
    discard(kept, pairs, links)
    found = stash(counted(parts, vectors, least))
    discard(vectors)
    out = placed.drop("vector").join(parts.join(found, "rep", "left"), "rep", "left")
    n = F.coalesce("found", F.lit(0)) + F.coalesce(F.col("copies") - 1, F.lit(0))
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias(key), n.alias("n_links"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))
