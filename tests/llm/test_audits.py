"""Divergence of sources, alignment of tokenizers and secret scans against brute force, with edge cases."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from lathework.llm import alignment, divergence, mixing, queries, secret_scan, sharding

SF = "/root/testdata/sf0.001"
NAMES = "doc_id long, text string, lang string, source string, n_chars long"
A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


# 11
def audited(rows, least, top):
    """(lang, source, part, item, value, rank) of rows (text, lang, source), by the definition."""
    rows = [tuple(x or "" for x in r) for r in rows]
    lower = str.maketrans({c: chr(c + 32) for c in range(65, 91)})
    held, counts = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text.translate(lower))
        held[lang].update(set(terms))
        counts[lang, source].update(terms)
    out = []
    for lang in {r[1] for r in rows}:
        kept = [t for t, n in held[lang].items() if n >= least]
        sources = {r[2] for r in rows if r[1] == lang}

        def p(n, kept=kept):
            total = sum(n[t] for t in kept)
            return {t: 1 + 1_000_000_000 * (n[t] + 5) // (total + 5 * len(kept)) for t in kept}

        q = p(sum((counts[lang, s] for s in sources), Counter()))
        of = {s: p(counts[lang, s]) for s in sources}
        for s in sources:
            pairs = [(o, sum(abs(of[s][t] - of[o][t]) for t in kept)) for o in sources if o != s]
            terms = [(t, of[s][t] - q[t]) for t in kept if counts[lang, s][t] and of[s][t] > q[t]]
            for part, found in (("pair", pairs), ("term", terms)):
                ranked = sorted(found, key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, value, k) for k, (item, value) in enumerate(ranked if part == "pair" else ranked[:top], 1)]
    return sorted(out)


def found(df):
    return sorted(map(tuple, df.select("lang", "source", "part", "item", "value", "rank").collect()))


def test_divergence(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = audited([(r["text"], r["lang"], r["source"]) for r in docs.collect()], 30, 50)
    out = queries.op11_divergence(spark, SF)
    assert {f.name: f.dataType.simpleString() for f in out.schema.fields} == {"lang": "string", "source": "string", "part": "string", "item": "string", "value": "bigint", "rank": "int"}
    assert found(out) == want and any(r[2] == "term" for r in want)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    assert sorted(con.execute(f"SELECT lang, source, part, item, value, rank FROM ({queries.ORACLES['op11_divergence']})").fetchall()) == want


def test_divergence_edges(spark, odd_docs):
    rows = [(r["text"], r["lang"], r["source"]) for r in odd_docs.collect()]
    for least in (1, 2, 99):  # 99: no kept terms, all pairs 0
        assert found(divergence.divergence_audit(odd_docs.withColumns({"term": F.lit(1), "p0": F.lit(2), "a": F.lit(3)}), least_docs=least, top=3)) == audited(rows, least, 3)
    assert divergence.divergence_audit(odd_docs.limit(0)).count() == 0
    rng = random.Random(3)
    words = ["ÄB", "äb", "Éa", "x", "X", "日本", "🙂", "zz", "it's", "a1b", "\0q", "ſ", "K"]
    rows = [(" ".join(rng.choices(words, k=rng.randint(0, 9))), rng.choice("lmn"), rng.choice(["s", "t", "u", "é", None])) for _ in range(300)]
    rows += [("", "l", "bare"), (None, "only", "one"), ("x " * 5000, "l", "s")]
    df = spark.createDataFrame([(k, *r, None) for k, r in enumerate(rows)], NAMES)
    assert found(divergence.divergence_audit(df, least_docs=5, top=4)) == audited(rows, 5, 4)


def test_divergence_is_exact_for_large_counts(spark):
    row = spark.range(1).select(divergence.probability(F.lit(9_000_000_000_000_000_000 - 5), F.lit(9_100_000_000_000_000_000), F.lit(1_000_000)).alias("p")).first()
    assert row["p"] == 1 + 10**9 * 9_000_000_000_000_000_000 // (9_100_000_000_000_000_000 + 5_000_000)


# 12
def whole(machine, text):
    """Groups as (A ids, B ids), by the tokens of the whole text."""
    if not text:
        return []
    ids = machine.a.encode(f" {text}", add_special_tokens=False).ids, machine.b.encode(text)
    names = [machine.bytes_a[k] for k in ids[0]], [machine.bytes_b[k] for k in ids[1]]
    if any(b"".join(n) != f" {text}".encode() for n in names):
        return []
    ends = [{int(e): k for k, e in enumerate(np.cumsum([len(x) for x in n]), 1)} for n in names]
    out, at = [], [0, 0]
    for cut in sorted(ends[0].keys() & ends[1].keys()):
        to = [e[cut] for e in ends]
        out.append((ids[0][at[0] : to[0]], ids[1][at[1] : to[1]]))
        at = to
    return out


def scored(groups_of):
    """The contract's columns for each row's groups."""
    links = [Counter((a, b) for x, y in groups for a in x for b in y) for groups in groups_of]
    docs = Counter(pair for row in links for pair in row)
    best = defaultdict(int)
    for (a, _), n in docs.items():
        best[a] = max(best[a], n)
    out = []
    for groups, row in zip(groups_of, links, strict=True):
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        digest = hashlib.sha256(text.encode()).hexdigest() if groups else ""
        out.append((sum(len(x) for x, _ in groups), sum(len(y) for _, y in groups), len(groups), sum(row.values()), sum(n for p, n in row.items() if docs[p] == best[p[0]]), sum(n * docs[p] for p, n in row.items()), digest))
    return out


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_alignment(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()
    machine = alignment.aligner(A, B)
    want = scored([whole(machine, r["text"]) for r in docs])
    out = queries.op12_alignment(spark, SF).orderBy("doc_id")
    assert [tuple(r) for r in out.select("doc_id", *COLUMNS).collect()] == [(d["doc_id"], *w) for d, w in zip(docs, want, strict=True)]
    monkeypatch.setattr(alignment, "BROADCAST_PAIRS", 0)  # the same by the shuffled join
    assert [tuple(r) for r in queries.op12_alignment(spark, SF).orderBy("doc_id").select(*COLUMNS).collect()] == want


ODD_TEXTS = ["", " ", "a", "\n", "  a\n\n b\tc <s> </s> <unk> x é 日本 <0x41>", "▁x y", "a▁", "<|endoftext|> hi", "日本語" * 50 + "🙂" * 30, "a" * 3000, " x　y z", "é é", "\0 x", "it's we're I'LL 's"]


@pytest.mark.parametrize("segment", [4, 1 << 15])
def test_alignment_of_odd_texts(monkeypatch, segment):
    monkeypatch.setattr(alignment, "SEGMENT", segment)
    machine = alignment.aligner(A, B)
    assert machine.cuts
    rng = random.Random(0)
    some = ["word", " ", "  ", "\n", "x", "12", ",", "Ünï", "日本", "🙂", "A", "'s", "▁", "<s>"]
    texts = ODD_TEXTS + ["".join(rng.choices(some, k=rng.randint(1, 60))) for _ in range(300)] + ["plain words " * 9000 + "日本 " * 100]
    machine._clear()
    for text, row in zip(texts, machine.align(texts), strict=True):
        a, b, of_a, of_b, keys, n = row.a, row.b, row.of_a, row.of_b, row.links, row.n
        at_a, at_b = np.cumsum(of_a)[:-1], np.cumsum(of_b)[:-1]
        got = [(x.tolist(), y.tolist()) for x, y in zip(np.split(a, at_a), np.split(b, at_b), strict=True)] if len(of_a) else []
        want = whole(machine, text)
        assert got == want, repr(text[:80])
        assert alignment.written(row) == ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in want)
        pairs = Counter()
        for x, y in want:
            for (p, m), (q, k) in ((u, v) for u in Counter(x).items() for v in Counter(y).items()):
                pairs[p << 32 | q] += m * k
        assert dict(zip(keys.tolist(), n.tolist(), strict=True)) == pairs


def test_alignment_of_large_groups(monkeypatch):
    """Groups whose pairs are listed in several steps."""
    monkeypatch.setattr(alignment, "PAIRS", 50)
    rng = np.random.default_rng(0)
    of_a, of_b = np.array([1, 40, 2, 300, 9, 1]), np.array([3, 30, 2, 200, 1, 1])
    a, b = rng.integers(0, 60, of_a.sum()), rng.integers(0, 60, of_b.sum())
    keys, n = alignment.linked(a, b, of_a, of_b)
    want, i, j = Counter(), 0, 0
    for x, y in zip(of_a, of_b, strict=True):
        want.update(int(p) << 32 | int(q) for p in a[i : i + x] for q in b[j : j + y])
        i, j = i + x, j + y
    assert dict(zip(keys.tolist(), n.tolist(), strict=True)) == want


def test_alignment_edges(spark, odd_docs):
    df = odd_docs.withColumns({"links": F.lit("mine"), "groups": F.lit(1), "number": F.lit(2), "row": F.lit(3), "a": F.lit(4), "docs": F.lit(5), "n_best": F.lit(6)})
    aligned = alignment.align_tokens(df, A, B)
    rows = aligned.collect()
    machine = alignment.aligner(A, B)
    for r in rows:
        assert [(g["a"], g["b"]) for g in r["groups"]] == whole(machine, r["text"])
    want = Counter(w[4:6] for w in scored([whole(machine, r["text"]) for r in rows]))
    out = alignment.score_links(aligned.drop("groups"))
    assert set(out.columns) == set(df.columns) - {"groups", "links"} | {"count_sum"} and out.where("number = 2 AND row = 3 AND a = 4 AND docs = 5").count() == len(rows)
    assert Counter((r["n_best"], r["count_sum"]) for r in out.collect()) == want
    assert alignment.score_links(aligned.limit(0)).count() == 0


# 13
def base_spans(text):
    text = text or ""
    word = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    out = [("assign", *m.span()) for m in word.finditer(text) if len(m[2]) >= 8]
    out += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(out, key=lambda s: (s[1], secret_scan.BASE.index(s[0])))


def test_secrets(spark):
    sf = "/root/testdata/sf0.01"  # the smallest with secrets
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    out = queries.op13_secrets(spark, sf).collect()
    assert len(out) == len(docs)
    for r in out:
        base = base_spans(docs[r["doc_id"]])
        count = Counter(s[0] for s in base)
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(count[k] for k in secret_scan.BASE)
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()
        assert r["spans"] == ",".join(f"{k}:{a}:{b}" for k, a, b, _ in secret_scan.find_secrets(docs[r["doc_id"]]))
    assert sum(r["n_assign"] for r in out) > 0


def test_secrets_base_patterns():
    rng = random.Random(1)
    some = ["password", "PassWD", " ", "=", ":", '"', "'", "token", "api", "_", "key", "AKIA", "AKIA", "0123456789abcdef", "DEADBEEF" * 2, "a1b2c3d4e5f60718", "é", "ſ", "paſſword", "x", "secret", ".", "toKen"]
    for _ in range(5000):
        text = "".join(rng.choices(some, k=rng.randint(1, 30)))
        assert [s[:3] for s in secret_scan.find_secrets(text) if s[0] in secret_scan.BASE] == base_spans(text)


def test_secrets_entropy():
    rng = random.Random(2)
    base62, base64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    for signs, n in ((base62, 40), (base64, 64), ("0123456789ABCDEF", 64)):
        caught = 0
        for _ in range(300):
            key = "".join(rng.choices(signs, k=n))
            spans = secret_scan.find_secrets(f"Ünder the key {key} lies more.")
            caught += bool(spans) and all(s[1] >= 14 and s[2] <= 14 + n for s in spans)
        assert caught >= 285
    run = "".join(rng.choices("abcdef0123", k=200))
    for k, bits in enumerate(secret_scan.window_bits(run, 20)):
        counts = Counter(run[k : k + 20])
        assert bits == pytest.approx(-sum(c / 20 * math.log2(c / 20) for c in counts.values()))


CLEAN = [
    "getHttpServletRequestFactoryBeanDefinitionParser2", "https://x.org/a/xZ7c4Qf9RkT2mW8vLb3NsY6hJd1PgAe5UoKi", "sha256: 9F86D081884C7D659A2FEAA0C55AD015A3BF4F1B2B0B822CD15D6C15B0F00A08", "commit 9F86D081884C7D659A2FEAA0C55AD015A3BF4F1B",
    "this-is-a-long-slug-with-many-words-2024-and-10-more", "Rindfleischetikettierungsueberwachungsaufgabenuebertragungsgesetz", "/usr/local/lib/python3/site-packages/Pyspark/sql/functions", "wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY", "123E4567-e89b-12d3-a456-426614174000",
    "data:image/png;base64,iVBORw0KGgoAAAANSUhEUgAAAAEAAAABCAYAAAAfFcSJ", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefgh0123456789", "=" * 80, "-" * 500, "Die Unabhängigkeitserklärungsfeierlichkeiten", "THE_MAXIMUM_NUMBER_OF_RETRIES_2", "12345678901234567890123456789",
]


def test_secrets_leave_clean_texts_alone(spark):
    assert [t for t in CLEAN if secret_scan.find_secrets(f"see {t} here")] == []
    key = "xZ7c4Qf9RkT2mW8vLb3NsY6hJd1PgAe5UoKi"
    assert [s[0] for s in secret_scan.find_secrets(key)] == ["entropy_alnum"] and not secret_scan.find_secrets(key, frozenset([key]))
    assert [s[0] for s in secret_scan.find_secrets(f"token={key}")] == ["assign"]  # reported once
    added = [s for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect() for s in secret_scan.find_secrets(r["text"]) if s[0] not in secret_scan.BASE]
    assert not added  # the table plants no other secrets


def test_secrets_edges(spark, odd_docs):
    long = "w " * 500_000 + "token: abcdefgh1 " + "0f" * 40
    df = odd_docs.withColumns({"secrets": F.lit("mine"), "kind": F.lit("mine")}).union(spark.createDataFrame([(8, long, "en", "a", 1, "m", "m", "m", "m")], odd_docs.withColumns({"secrets": F.lit("x"), "kind": F.lit("x")}).schema))
    rows = secret_scan.scan_secrets(df).collect()
    assert len(rows) == 11
    for r in rows:
        assert [(s["kind"], s["start"], s["end"]) for s in r["secrets"]] == (base_spans(r["text"]) if r["doc_id"] == 8 else [])
    assert "text" not in secret_scan.scan_secrets(df, keep_text=False).columns and secret_scan.scan_secrets(df.limit(0)).count() == 0


# Names of the caller's columns.
PRIVATE = ["_pid", "_row", "_start", "_tie", "_again", "_mid", "_ends", "_of", "_cut", "_u", "_key", "_class", "_source", "_odds", "_place", "_level", "_rest", "_sure", "_before", "_extra", "_by0", "packed", "a.b"]


def test_no_column_of_the_caller_is_lost(spark, odd_docs):
    df = odd_docs.drop("size").withColumns({c: F.lit("mine") for c in PRIVATE})
    dealt = sharding.shard_rows(df, 3)
    mixed = mixing.pareto_mix(df, F.coalesce("n_chars", F.lit(3)), F.col("source"), [F.col("doc_id")], [5.0, 2.0], 1.5, 2.0)
    plain = mixing.pareto_mix(odd_docs, F.coalesce("n_chars", F.lit(3)), F.col("source"), [F.col("doc_id")], [5.0, 2.0], 1.5, 2.0)
    assert dealt.columns == [*df.columns, "shard", "slot"] and mixed.columns == [*df.columns, *mixing.ADDED]
    for out in (dealt, mixed):
        rows = out.collect()
        assert len(rows) == 10 and all(r[c] == "mine" for r in rows for c in PRIVATE)
    shown = ["doc_id", *mixing.ADDED]
    assert sorted(map(str, mixed.select(shown).collect())) == sorted(map(str, plain.select(shown).collect()))
