"""The pipeline stage by stage, each on its own input, against brute force."""

from __future__ import annotations

import re
from collections import Counter

import public_tokenizers
from pyspark.sql import functions as F
from test_operators import WORD, brute_near, brute_quality, check_packing
from tokenizers import Tokenizer

import corpus_pipeline
from lathework.llm import private_data
from lathework.llm.common import stash
from lathework.llm.queries import MIX_MOST, MIX_SHARE, MIX_WEIGHTS

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "near_duplicates", "private_data", "mixing", "packing"]
    before = docs.collect()
    results = []
    for _, stage in corpus_pipeline.STAGES:
        out = stash(stage(spark, docs, SF))
        results.append(out.collect())
        assert len(results) == 5 or out.columns == docs.columns
        docs = out
    quality, near, private, mixed, packed = results

    kept = {r["doc_id"] for r in quality}
    for r in before:
        n, _, symbols, _, repeated = brute_quality(r["text"])
        if n < 50 or 100 * repeated > 50 * n or 10 * symbols > n:
            assert r["doc_id"] not in kept
    assert len(kept) > len(before) / 4

    _, component = brute_near({r["doc_id"]: r["text"] for r in quality})
    assert {r["doc_id"] for r in near} == set(component.values())

    texts = {r["doc_id"]: r["text"] for r in near}
    for r in private:
        text = texts[r["doc_id"]]
        assert r["text"] == private_data.redact(text, private_data.find_spans(text)) and r["n_chars"] == len(r["text"])
        assert not re.search(r"[A-Za-z0-9]@[A-Za-z0-9-]+\.[A-Za-z]", r["text"])
    assert len(private) == len(near)

    copies = Counter(r["doc_id"] for r in mixed)
    words = {r["doc_id"]: len(WORD.findall(r["text"])) for r in private}
    assert set(copies) <= set(words) and max(copies.values()) <= 2
    taken = sum(words[d] * n for d, n in copies.items())
    assert abs(taken - 1.5 * sum(words.values())) <= max(words.values()) * len({r["source"] for r in private})

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    length = {r["doc_id"]: len(tokenizer.encode(r["text"], add_special_tokens=False).ids) + 1 for r in private if r["doc_id"] in copies}
    got = Counter()
    for r in packed:
        got[r["doc_id"]] += r["length"]
    assert got == {d: copies[d] * n for d, n in length.items()}
    if set(copies.values()) == {1}:
        check_packing(packed, {r["doc_id"]: [*tokenizer.encode(r["text"], add_special_tokens=False).ids, 2] for r in mixed})


def test_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stash(stage(spark, docs, SF))
        assert docs.count() == 0


def test_odd_rows(spark, odd_docs):
    """Nulls in every column, empty, blank and very long texts, repeated rows, and columns that the stages use themselves."""
    docs = odd_docs.withColumns({c: F.lit("mine") for c in ("_number", "copy", "copies", "component_id", "redacted", "_group")})
    rows = docs.select(*corpus_pipeline.COLUMNS).collect()
    out = {name: stage(spark, docs, SF).collect() for name, stage in corpus_pipeline.STAGES}
    assert {r["doc_id"] for r in out["quality"]} <= {5, 6, None}
    assert Counter(r["doc_id"] for r in out["near_duplicates"]) == Counter([0, 1, 2, 3, 5, None, 7])
    assert sorted(map(str, out["private_data"])) == sorted(map(str, [r if r["text"] is not None else r for r in (row.__class__(**(row.asDict() | {"n_chars": None if row["text"] is None else len(row["text"])})) for row in rows)]))
    assert {r["doc_id"] for r in out["mixing"]} <= {r["doc_id"] for r in rows} and all(len(r) == 5 for r in out["mixing"])
    assert Counter(r["doc_id"] for r in out["packing"] if r["start"] == 0) == Counter(r["doc_id"] for r in rows)
    assert sum(r["length"] for r in out["packing"] if r["doc_id"] == 0) == 1


def test_run_leaves_no_tables_behind(spark):
    from pathlib import Path

    folder = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    before = set(folder.iterdir())
    assert corpus_pipeline.run(spark, SF).count() > 0
    assert len(set(folder.iterdir()) - before) <= 1  # the last stage's input


def test_mixing_samples_rows_without_an_id(spark):
    # A third of each source has a null id, another third one id in common.
    rows = [(None if k % 3 == 0 else -1 if k % 3 == 1 else k, f"w{k} " * (20 + k % 17), "en", "abc"[k // 300], 0) for k in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got, had = Counter(), Counter()
    for r in corpus_pipeline.mix_sources(spark, docs, SF).collect():
        got[r["source"]] += len(WORD.findall(r["text"]))
    for r in rows:
        had[r[3]] += len(WORD.findall(r[1]))
    # The first source is at its limit, its rest goes to the others by weight until they are.
    level, caps = MIX_SHARE * sum(had.values()), {s: MIX_MOST * n for s, n in had.items()}
    weights, targets = dict(zip("abc", MIX_WEIGHTS, strict=True)), {}
    while True:
        free = [s for s in weights if s not in targets]
        left = (level - sum(targets.values())) / sum(weights[s] for s in free)
        over = [s for s in free if weights[s] * left >= caps[s]]
        if not over:
            targets |= {s: weights[s] * left for s in free}
            break
        targets |= {s: caps[s] for s in over}
    for s, target in targets.items():
        assert abs(got[s] - target) <= 36


def test_near_duplicates_of_rows_without_an_id(spark):
    long = " ".join(f"w{k}" for k in range(80))
    rows = [(4, long), (4, long), (None, long), (3, long + " more"), (None, "lost " + long[::-1]), (None, "lost " + long[::-1]), (7, "of its own " + long.replace("w", "v")), (8, ""), (8, ""), (9, ""), (None, None), (None, None)]
    docs = spark.createDataFrame([(d, t, "en", "a", len(t or "")) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    out = Counter((r["doc_id"], r["text"]) for r in corpus_pipeline.drop_near_duplicates(spark, docs, SF).collect())
    assert out == Counter([(3, long + " more"), (None, rows[4][1]), rows[6], (8, ""), (9, ""), (None, None)])
