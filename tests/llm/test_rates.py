"""Rates that operators state: inclusion probabilities over many seeds, and recall against brute force."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lathework.llm import lattice, mixing

WEIGHTS, SHARE, MOST = [5.0, 2.0, 1.0], 0.6, 2.0


def test_inclusion_frequencies(spark):
    sizes = (4, 16, 16, 64, 300)
    rows = [(k, sizes[k % 5], "abc"[k % 3]) for k in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, n long, source string").cache()
    drawn, stated, n = Counter(), Counter(), Counter()
    for seed in range(4):
        words, target = Counter(), {}
        for r in mixing.pareto_mix(docs, F.col("n"), F.col("source"), [F.col("doc_id")], WEIGHTS, SHARE, MOST, seed=seed).collect():
            sure = int(r["target"] // r["source_size"])
            key = r["source"], r["size"]
            drawn[key] += r["copies"] - sure
            stated[key] += r["inclusion"]
            n[key] += 1
            words[r["source"]] += r["copies"] * r["size"]
            target[r["source"]] = r["target"]
        assert all(abs(words[s] - target[s]) <= 150 for s in target)
        # The expected words of the sample are the words that remain.
    for s, t in target.items():
        whole = sum(size for _, size, source in rows if source == s)
        assert sum(stated[s, k] * k for k in set(sizes)) / 4 == pytest.approx(t - t // whole * whole)
    for key, k in n.items():
        p = stated[key] / k
        assert abs(drawn[key] / k - p) < 4 * np.sqrt(p * (1 - p) / k) + 0.005
    # Within a source longer documents are likelier.
    for s in "abc":
        p = [stated[s, k] / n[s, k] for k in (4, 16, 64, 300)]
        assert p == sorted(p) and (p[0] in (0, 1) or p[0] < p[-1])


def test_one_size_gives_equal_probabilities(spark):
    docs = spark.range(500).select("id", F.lit(8).cast("long").alias("n"), F.lit("s").alias("source"))
    rows = mixing.pareto_mix(docs, F.col("n"), F.col("source"), [F.col("id")], [1.0], 1.5, 2.0).collect()
    assert {round(r["inclusion"], 6) for r in rows} == {0.5}
    assert Counter(r["copies"] for r in rows) == {1: 250, 2: 250}


@pytest.mark.parametrize("d", [16, 256])
def test_recall_of_lone_pairs(spark, d):
    # Pairs at a cosine of 0.95 to 0.97, each alone.
    rng = np.random.default_rng(d)
    pairs = 400
    x = rng.standard_normal((pairs, d))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z = rng.standard_normal((pairs, d))
    z -= (z * x).sum(axis=1, keepdims=True) * x
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    cosine = rng.uniform(0.9501, 0.97, (pairs, 1))
    y = cosine * x + np.sqrt(1 - cosine**2) * z
    rows = [(k, v.tolist()) for k, v in enumerate(np.concatenate([x, 3 * y]))]
    got = {r["vec_id"]: r for r in lattice.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    unit = np.concatenate([x, y])
    brute = unit @ unit.T >= 0.95
    np.fill_diagonal(brute, False)
    found = sum(got[k + pairs]["component_id"] == got[k]["component_id"] for k in range(pairs))
    assert found >= 0.95 * pairs
    assert all(got[k]["n_links"] <= brute[k].sum() for k in range(2 * pairs))


def test_large_groups_of_near_vectors(spark, monkeypatch):
    # Groups that span many tiles, every link counted.
    monkeypatch.setattr(lattice, "TILE", 16)
    monkeypatch.setattr(lattice, "STEP_ROWS", 64)
    monkeypatch.setattr(lattice, "COUNT_TILE", 16)
    monkeypatch.setattr(lattice, "COUNT_BLOCK", 5)
    rng = np.random.default_rng(1)
    base = rng.standard_normal((3, 32))
    x = np.concatenate([base[k % 3] + 0.12 * rng.standard_normal(32) for k in range(300)]).reshape(300, 32)
    x[250:260] = x[0]
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    brute = unit @ unit.T >= 0.95
    np.fill_diagonal(brute, False)
    got = {r["vec_id"]: r for r in lattice.near_vectors(spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")).collect()}
    for k in range(300):
        assert got[k]["n_links"] == brute[k].sum()
        assert got[k]["component_id"] == min([k, *np.flatnonzero(brute[k]).tolist()]) or got[k]["component_id"] in (0, 1, 2)
