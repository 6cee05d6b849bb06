"""Tiles of long lists and large components: every pair that may link meets once, and rows stay far below all tiles."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lathework.llm import lattice, minhash


def band(n):
    return math.floor(math.log(n) * (minhash.BANDS / math.log(100 / minhash.SIMILAR)))


@pytest.mark.parametrize("seed", range(6))
def test_cut_of_bands(seed):
    """Each band meets the bands in reach, in one pair of blocks for two members, and never main with main."""
    rng = random.Random(seed)
    tile = 10
    bands = {m: sorted((b, rng.choice([1, 3, 9, 10, 11, 57])) for b in rng.sample(range(60), rng.randint(0 if seed else 8, 25))) for m in (0, 1)}
    rows = minhash.cut(bands, tile)
    assert sorted((r[0], r[1]) for r in rows) == sorted((m, b) for m in bands for b, _ in bands[m])
    held = {}
    for main, b, first, blocks, *_ in rows:
        n = dict(bands[main])[b]
        assert blocks == -(-n // tile)
        for k in range(first, first + blocks):
            held.setdefault(k, []).append((main, b, n))
    assert set(held) == set(range(len(held)))
    for k, of in held.items():
        assert len({m for m, _, _ in of}) == 1
        assert len(of) == 1 or sum(n for _, _, n in of) <= tile
    met = {k: set() for k in held}
    for main, _, first, blocks, low, high, low_main, high_main in rows:
        others = {*range(low, high + 1), *range(low_main, high_main + 1)}
        for k in range(first, first + blocks):
            assert not met[k] or met[k] == others  # bands of one block agree
            met[k] = others
    for k, others in met.items():
        assert all(k in met[o] for o in others)
        for o in held:
            if held[k][0][0] and held[o][0][0]:
                assert o not in others
            elif any(abs(x[1] - y[1]) <= minhash.REACH for x in held[k] for y in held[o]):
                assert o in others


def test_sizes_that_allow_a_link_are_in_reach(spark):
    sizes = [n for k in range(1, 4000) for n in (3 * k, 4 * k)]
    found = [r[0] for r in spark.createDataFrame([(n,) for n in sizes], "n long").select(minhash._band(F.col("n"))).collect()]
    assert all(0 <= high - low <= minhash.REACH for low, high in zip(found[::2], found[1::2], strict=True))


def test_a_long_list_of_unrelated_members(spark):
    """20,000 documents of 50 to 5,000 shingles that share one value: each meets the sizes near its own."""
    n = 20_000
    rng = np.random.default_rng(2)
    sizes = np.exp(rng.uniform(math.log(50), math.log(5000), n)).astype(int)
    reps = spark.createDataFrame([(k, int(s)) for k, s in enumerate(sizes)], "rep long, n_shingles long").withColumn("sketch", F.lit(b""))
    listed = reps.select("rep", F.lit(5).cast("long").alias("slot"), F.lit(32).cast("long").alias("posted"))
    parts = reps.select("rep", F.when(F.col("rep") < 4000, 0).otherwise(F.col("rep")).cast("long").alias("component"))
    rows = minhash.tiled(listed, parts, reps)
    blocks = n / minhash.TILE
    assert rows.count() < 0.4 * n * blocks
    tiles = rows.groupBy("i", "j").agg(F.sum((F.col("side") == 0).cast("int")).alias("x"), F.sum("side").alias("y"), F.max("component").alias("c"), F.countDistinct("component").alias("k")).collect()
    assert max(max(r["x"], r["y"]) for r in tiles) < 1.5 * minhash.TILE
    assert all(r["k"] > 1 for r in tiles)
    one = {r["rep"]: (r["i"], r["j"], r["side"]) for r in rows.where("i = j").collect()}
    assert len(one) == n - 4000


@pytest.mark.parametrize("one", [True, False])
def test_links_in_a_tile(monkeypatch, one):
    monkeypatch.setattr(lattice, "COUNT_BLOCK", 7)
    rng = np.random.default_rng(4)
    x = rng.standard_normal((50, 4))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    copies = rng.integers(1, 5, 50).astype(float)
    rows, cols = (np.arange(50), np.arange(50)) if one else (np.arange(20), np.arange(20, 50))
    over, under = lattice.links_in(x, copies, rows, cols, one, 0.5)
    want = [[sum(int(copies[b]) for b in there if a != b and x[a] @ x[b] >= 0.5) for a in here] for here, there in ((rows, cols), (cols, rows))]
    assert over.tolist() == want[0] and under.tolist() == want[1]


def test_counting_a_large_component(spark):
    """6,000 vectors of one component: rows are a block's, not a small tile's, and counts are those of brute force."""
    n = 6000
    rng = np.random.default_rng(9)
    x = np.ones(8) + 0.25 * rng.standard_normal((n, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(k, 1 + k % 3, v.tolist()) for k, v in enumerate(x)], "rep long, copies long, vector array<double>")
    vectors = lattice.stash(lattice.unit_vectors(df))
    got = {r["rep"]: r["found"] for r in lattice.counted(df.select("rep", F.lit(0).cast("long").alias("component")), vectors, 0.95).collect()}
    link = x @ x.T >= 0.95
    np.fill_diagonal(link, False)
    want = link @ (1 + np.arange(n) % 3)
    assert [got[k] for k in range(n)] == want.tolist()
