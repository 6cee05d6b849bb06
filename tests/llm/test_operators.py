"""Each operator against a brute-force version, with edge cases and empty tables."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lathework.llm import conversations, html_text, lattice, minhash, mixing, packing, private_data, quality, queries, sharding, token_counts
from lathework.llm.components import connected_components

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
PATH = public_tokenizers.path("word_bpe_49k.json")


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def library():
    return Tokenizer.from_file(PATH)


def smallest(nodes, links):
    """The smallest node reachable from each."""
    root = {n: n for n in nodes}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = top(a), top(b)
        root[max(x, y)] = min(x, y)
    return {n: top(n) for n in nodes}


# 1
def check_shards(rows, shards):
    by = {}
    for r in rows:
        by.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    counts = [len(by.get(k, [])) for k in range(shards)]
    assert max(counts) - min(counts) <= 1


def test_sharding(spark, odd_docs, monkeypatch):
    out = queries.op1_sharding(spark, SF).collect()
    source = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert len(out) == len(source)
    for r in out:
        raw = source[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 16, zlib.crc32(raw), "rows", None)
    check_shards(out, 40)
    odd = sharding.shard_rows(odd_docs.withColumn("shard", F.lit("x")), 3).collect()
    assert len(odd) == 10
    check_shards(odd, 3)
    assert sharding.shard_rows(odd_docs.limit(0), 3).count() == 0
    monkeypatch.setattr(sharding, "BROADCAST_BYTES", 0)  # the matrix is joined: the same rows go to the same places
    assert sorted(map(tuple, queries.op1_sharding(spark, SF).collect()), key=str) == sorted(map(tuple, out), key=str)
    matrix = sharding.communication_matrix(np.array([5, 0, 7]), np.array([4, 4, 4]), 1)
    assert matrix.sum(axis=0).tolist() == [4, 4, 4] and matrix.sum(axis=1).tolist() == [5, 0, 7]


# 2
def test_conversations(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "bot", "b"), (2, 0, "user", "a"), (3, 0, "user", "a"), (3, 1, "bot", "b"), (3, 2, "user", None), (4, 0, None, "a"), (None, 0, "user", "z"), (5, None, "user", "a"), (5, None, "user", "a"), (6, 0, "user", ""), (7, 0, "user", "\0null"), (8, 0, "user", None), (8, 1, "bot", "b")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("place", F.lit(1))
    found = {r["conv_id"]: r["rendered"] for r in conversations.format_conversations(df).collect()}
    assert set(found) == {3, 4, 6, 7, 8}
    assert found[3] == "<|im_start|>user\na<|im_end|>\n<|im_start|>bot\nb<|im_end|>\n<|im_start|>user\n<|im_end|>\n"
    assert conversations.format_conversations(df.limit(0)).count() == 0
    long = spark.range(600).select(F.lit(9).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.lit("user").alias("role"), F.col("id").cast("string").alias("text"))
    pieces = conversations.format_conversations(long).orderBy("piece").collect()
    assert [p["piece"] for p in pieces] == [0, 1, 2] and "".join(p["rendered"] for p in pieces) == "".join(f"<|im_start|>user\n{k}<|im_end|>\n" for k in range(600))


def test_conversations_rows(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{SF}/conversations.parquet'")
    found = con.execute(queries.ORACLES["op2_conversations"])
    names = sorted(d[0] for d in found.description)
    want = Counter(tuple(dict(zip((d[0] for d in found.description), r, strict=True))[n] for n in names) for r in found.fetchall())
    out = queries.op2_conversations(spark, SF)
    assert sorted(out.columns) == names
    assert Counter(map(tuple, out.select(*names).collect())) == want


# 3
def test_html(spark):
    read, labels = html_text.labelled_pages(77, 60)
    chain = html_text.default_chain()
    right = total = 0
    for page, gold in zip(read, labels, strict=True):
        found = chain.decode(page)
        right, total = right + sum(a == b for a, b in zip(found, gold, strict=True)), total + len(gold)
    assert right / total > 0.97  # held-out accuracy
    # Viterbi against all label sequences of short chains.
    rng = np.random.default_rng(0)
    for _ in range(20):
        model = html_text.Chain(rng.standard_normal((8, 2)), rng.standard_normal((2, 2)))
        page = [tuple(rng.integers(0, 8, 3).tolist()) for _ in range(5)]
        score = model.scores(page)

        def value(y, score=score, model=model):
            return sum(score[k, y[k]] for k in range(5)) + sum(model.move[y[k], y[k + 1]] for k in range(4))

        assert value(model.decode(page)) == pytest.approx(max(value([(n >> k) & 1 for k in range(5)]) for n in range(32)))
    html = "<html><body><nav><ul><li><a href='/'>Home</a></li><li><a href='/b'>About</a></li></ul></nav><article><h1>A title for this page</h1><p>Some words &amp; more\n words stand here, in the first one. And so it goes.</p><p>The second one is a long line of words as well.</p></article><footer>&copy; x</footer></body></html>"
    df = spark.createDataFrame([(1, html, "t"), (2, None, "t"), (3, "", "t"), (4, "<p><b>broken <", "t"), (1, html, "t")], "page_id long, html string, text string")
    out = html_text.extract_main_text(df).orderBy("page_id").collect()
    assert len(out) == 5 and out[0]["text"] == out[1]["text"] == "A title for this page\nSome words & more words stand here, in the first one. And so it goes.\nThe second one is a long line of words as well."
    assert out[2]["text"] == out[3]["text"] == "" and all(r["n_chars"] == len(r["text"]) for r in out)
    assert html_text.extract_main_text(df.limit(0)).count() == 0


def test_html_hides_only_what_is_hidden():
    page = "<article><p>By <a title='the hidden lake' data-x=\"display:none\" href=/l>the lake</a> and <b class=hidden>mark</b>.</p><p>So <math><mrow><mi>x</mi><mo>=</mo><mn>2</mn></mrow><annotation>x=2</annotation></math> holds.</p><p hidden>one</p><p HIDDEN=''>two</p><p style='color:red; display : none'>three</p><p id=a hidden=until-found>four</p></article>"
    assert [b.text for b in html_text.blocks(page)] == ["By the lake and mark.", "So x=2 holds."]


# 4
def brute_quality(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = Counter(tuple(words[k : k + 3]) for k in range(len(words) - 2))
    marked = {k + j for k in range(len(words) - 2) if windows[tuple(words[k : k + 3])] > 1 for j in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(marked)


def test_quality(spark, odd_docs):
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    source = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in queries.op4_quality(spark, SF).collect():
        want = brute_quality(source[r["doc_id"]])
        assert tuple(r[n] for n in names) == want
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r["base_failed"] and r["kept"])
    verdicts = [sorted((str(r["doc_id"]), r["kept"]) for r in quality.cascade(odd_docs, rules=rules).collect()) for rules in (quality.RULES, quality.RULES[::-1])]
    assert verdicts[0] == verdicts[1] and len(verdicts[0]) == 10
    assert quality.cascade(odd_docs.limit(0)).count() == 0


# 5
def test_lattice(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((40, 16))
    rows = [(k, (base[k % 40] + 0.03 * rng.standard_normal(16) * (k // 40)).tolist()) for k in range(160)]
    rows += [(500, None), (501, [0.0] * 16), (502, [float("nan")] + [1.0] * 15), (503, []), (504, rows[7][1]), (505, rows[7][1]), (506, [None] + [1.0] * 15), (507, [1.0, 2.0]), (508, [2.0, 4.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("label", F.lit(1))
    fit = {k: np.array(v) for k, v in rows if v and None not in v and np.isfinite(v).all() and np.any(v)}
    links = [(a, b) for a in fit for b in fit if a < b and len(fit[a]) == len(fit[b]) and fit[a] @ fit[b] / np.sqrt((fit[a] @ fit[a]) * (fit[b] @ fit[b])) >= 0.95 - 1e-12]
    degree = Counter(x for pair in links for x in pair)
    want = smallest([k for k, _ in rows], links)
    got = {r["vec_id"]: r for r in lattice.near_vectors(df).collect()}
    assert len(got) == len(rows)
    right = sum(got[k]["component_id"] == want[k] and got[k]["n_links"] == degree[k] for k in want)
    assert right >= 0.95 * len(want)  # the hashing may miss a few
    assert all(got[k]["n_links"] <= degree[k] and got[k]["kept"] == (got[k]["component_id"] == k) for k in want)
    assert all(got[k]["n_links"] == 0 for k in (500, 501, 502, 503, 506)) and got[504]["component_id"] == want[504]
    assert lattice.near_vectors(df.limit(0)).count() == 0


def test_nearest_lattice_point():
    y = np.random.default_rng(0).standard_normal((200, 8)) * 3
    near = lattice.nearest_e8(y)
    gap = ((y - near) ** 2).sum(axis=1)
    for v in lattice.NEIGHBOURS:
        assert (((y - near - v) ** 2).sum(axis=1) >= gap - 1e-9).all()


# 6
def test_token_counts(spark, odd_docs):
    tokenizer = library()
    source = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in queries.op6_token_counts(spark, SF).collect():
        text = source[r["doc_id"]]
        n = len(tokenizer.encode(text, add_special_tokens=False).ids)
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(text.encode()), n, n > 2048)
    for r in token_counts.count_tokens(odd_docs, PATH).collect():
        assert r["n_tokens"] == len(tokenizer.encode(r["text"] or "", add_special_tokens=False).ids)
    assert token_counts.count_tokens(odd_docs.limit(0), PATH).count() == 0


def test_tokens_of_random_texts():
    rng, tokenizer, machine = random.Random(4), library(), token_counts.compiled(PATH)
    signs = "abcdeEstvrlmLL'’  \n\t.,!?-_09٣éßİ中🙂ñ" + "́  "
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 80))) for _ in range(1500)] + ["a" * 700, "'" * 300, "<|endoftext|>a<|startoftext|>"]
    ids, starts = machine.encode(texts)
    want = [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert machine.count(texts).tolist() == [len(w) for w in want]
    assert all(ids[starts[k] : starts[k + 1]].tolist() == w for k, w in enumerate(want))


# 7
def test_mixing(spark, odd_docs):
    rows = queries.op7_mixing(spark, SF).collect()
    again = {r["doc_id"]: r["taken"] for r in queries.op7_mixing(spark, SF).collect()}
    size = {r["doc_id"]: (r["source"], len(WORD.findall(r["text"] or ""))) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    per = Counter()
    for s, n in size.values():
        per[s] += n
    order = sorted((s for s in per if s is not None)) + [s for s in per if s is None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    total, target, free = 1.5 * sum(per.values()), {}, set(order)
    while True:
        left = total - sum(target.values())
        level = left / sum(weight[s] for s in free) if free else 0
        over = {s for s in free if weight[s] * level > 2 * per[s]}
        if not over:
            break
        target |= {s: 2.0 * per[s] for s in over}
        free -= over
    target |= {s: weight[s] * level for s in free}
    taken, largest = Counter(), Counter()
    for r in rows:
        s, n = size[r["doc_id"]]
        assert (r["size"], r["source_size"]) == (n, per[s]) and r["target"] == pytest.approx(target[s])
        assert r["taken"] == again[r["doc_id"]] <= 2 * n and r["taken"] % max(1, n) == 0
        taken[s] += r["taken"]
        largest[s] = max(largest[s], n)
    assert len(rows) == len(size) and all(abs(taken[s] - target[s]) <= largest[s] for s in per)
    odd = mixing.pareto_mix(odd_docs, F.length("text"), F.col("source"), [F.col("doc_id")], [5.0, 2.0, 1.0], 1.5, 2.0).collect()
    assert len(odd) == 10 and all(r["copies"] is not None for r in odd)
    assert mixing.pareto_mix(odd_docs.limit(0), F.length("text"), F.col("source"), [F.col("doc_id")], [5.0, 2.0, 1.0], 1.5, 2.0).count() == 0


# 8
def shingle_set(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4)))


def brute_near(texts):
    sets = {k: shingle_set(t) for k, t in texts.items()}
    keys = sorted(sets)
    links = [(a, b) for i, a in enumerate(keys) for b in keys[i + 1 :] if sets[a] and 100 * (n := len(sets[a] & sets[b])) >= 75 * (len(sets[a]) + len(sets[b]) - n)]
    return sets, smallest(keys, links)


@pytest.mark.parametrize("rows, tile", [(minhash.STEP_ROWS, minhash.TILE), (20, 8)])
def test_minhash(spark, monkeypatch, rows, tile):
    monkeypatch.setattr(minhash, "STEP_ROWS", rows)
    monkeypatch.setattr(minhash, "TILE", tile)
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rng = random.Random(1)
    stem = [f"t{k}" for k in range(90)]
    for k in range(60):  # edited copies at and around the border
        words = list(stem)
        for _ in range(rng.randint(0, 4)):
            words[rng.randrange(len(words))] = f"e{rng.randrange(50)}"
        texts[10_000 + k] = " ".join(words)
    texts |= {20_000: None, 20_001: "", 20_002: " \n", 20_003: "short one", 20_004: "SHORT  one", 20_005: "short two"}
    df = spark.createDataFrame([(k, t, "x") for k, t in texts.items()], "doc_id long, text string, component_id string")
    sets, want = brute_near(texts)
    got = minhash.near_duplicates(df).collect()
    assert len(got) == len(texts)
    for r in got:
        assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(sets[r["doc_id"]]), want[r["doc_id"]], want[r["doc_id"]] == r["doc_id"])


def test_minhash_without_keys_and_rows(spark):
    nulls = spark.createDataFrame([(None, "a b"), (None, "a b"), (1, "a b"), (1, "a b")], "doc_id long, text string")
    assert sorted(str(r["component_id"]) for r in minhash.near_duplicates(nulls).collect()) == ["1", "1", "None", "None"]
    assert minhash.near_duplicates(nulls.limit(0)).count() == 0


def test_minhash_of_a_large_group_and_long_texts(spark, monkeypatch):
    """A group whose pairs lie on both sides of the border, confirmed in tiles of a few texts; and two long texts."""
    monkeypatch.setattr(minhash, "STEP_BYTES", 3000)
    rng, stem = random.Random(7), [f"t{k}" for k in range(60)]
    texts = {}
    for k in range(120):
        words = list(stem)
        for _ in range(rng.randint(1, 3)):
            words[rng.randrange(60)] = f"e{k}x{rng.randrange(9)}"
        texts[k] = " ".join(words)
    long = [f"w{k % 9973}y{k % 17}" for k in range(100_000)]
    texts |= {1000: " ".join(long), 1001: " ".join(long[:90_000]), 1002: " ".join(long[50_000:])}
    sets, want = brute_near(texts)
    for r in minhash.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect():
        assert (r["n_shingles"], r["component_id"]) == (len(sets[r["doc_id"]]), want[r["doc_id"]])


def test_components(spark):
    links = [(k, k + 1) for k in range(60)] + [(100, 101), (101, 100), (200, 200), (None, 3)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(61), 0), 100: 100, 101: 100, 200: 200}


# 9
def check_packing(rows, ids_of):
    window, by_doc, by_seq = 4096, {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_seq.setdefault(r["sequence_id"], []).append(r)
    assert set(by_doc) == set(ids_of)
    for d, parts in by_doc.items():
        ids, at = ids_of[d], 0
        for r in sorted(parts, key=lambda r: r["start"]):
            piece = np.array(ids[at : at + r["length"]], dtype="<u4").tobytes()
            assert (r["start"], r["doc_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(piece)) and r["length"] > 0
            at += r["length"]
        assert at == len(ids)
    for parts in by_seq.values():
        at = 0
        for r in sorted(parts, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= window
    return len(by_seq)


def test_packing(spark, odd_docs):
    tokenizer = library()
    ids_of = {r["doc_id"]: [*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 2] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    n = check_packing(queries.op9_packing(spark, SF).collect(), ids_of)
    assert n <= -(-sum(map(len, ids_of.values())) // 4096) + 8  # a short window for each task at most
    odd = odd_docs.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).withColumn("start", F.lit("mine"))
    check_packing(packing.pack(odd, PATH).collect(), {r["doc_id"]: [*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 2] for r in odd.collect()})
    assert packing.pack(odd.limit(0), PATH).count() == 0


def test_bm25_prefers_shared_rare_terms():
    texts = [[1, 2, 3, 9], [1, 2, 3, 9], [1, 4, 5, 6], [7, 8, 7, 8]]
    index = packing.Bm25(np.concatenate(texts).astype(np.uint32), np.array([0, 4, 8, 12, 16]))
    assert index.neighbours(0, np.array([False, True, True, True])).tolist() == [1, 2]


def test_bm25_of_whole_texts():
    rng = np.random.default_rng(5)
    texts = [rng.zipf(1.3, rng.integers(1, 400)) % 3000 for _ in range(300)]
    texts[7] = texts[3]
    ids, starts = np.concatenate(texts).astype(np.uint32), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    index, counts, mean = packing.Bm25(ids, starts), [Counter(t.tolist()) for t in texts], len(ids) / len(texts)
    spread = Counter(w for c in counts for w in c)
    idf = {w: np.log1p((len(texts) - k + 0.5) / (k + 0.5)) for w, k in spread.items()}
    unused = np.ones(len(texts), dtype=bool)
    for seed in rng.permutation(len(texts))[:250].tolist():
        unused[seed] = False
        want = np.array([sum(idf[w] * c[w] * (packing.K1 + 1) / (c[w] + packing.K1 * (1 - packing.B + packing.B * sum(c.values()) / mean)) for w in counts[seed] if w in c) for c in counts])
        want[~unused] = 0
        got = index.neighbours(seed, unused)
        assert len(got) == min(packing.NEIGHBOURS, np.count_nonzero(want)) and unused[got].all() and len(set(got.tolist())) == len(got)
        assert want[got] == pytest.approx(np.sort(want)[::-1][: len(got)])
        index.narrow(unused)
    assert len(index.place) < 100


def test_packing_searches_until_the_window_is_full():
    # Two topics in turn, with many more documents of each in a window than one page of a search.
    n, size = 400, 8
    ids = np.concatenate([[10 + d % 2, 20 + d % 2, *range(1000 + 6 * d, 1006 + 6 * d)] for d in range(n)]).astype(np.uint32)
    pieces = packing.pack_shard(ids, np.arange(n + 1) * size, 100 * size)
    assert 100 > 3 * packing.NEIGHBOURS and sum(p[2] for p in pieces) == n * size
    for sequence in range(4):
        assert len({p[0] % 2 for p in pieces if p[3] == sequence}) == 1
    # A seed without relatives: the next document in input order goes on as the seed.
    texts = [[1, 2], [5, 6], [7, 8], [5, 9]]
    assert [p[0] for p in packing.pack_shard(np.concatenate(texts).astype(np.uint32), np.arange(5) * 2, 8)] == [0, 1, 3, 2]


# 10
PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute_private(text):
    def luhn(d):
        return sum(sum(divmod(2 * int(c), 10)) if k % 2 else int(c) for k, c in enumerate(reversed(d))) % 10 == 0

    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")), "card": 13 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if ok:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def test_private_data(spark, odd_docs):
    source = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in queries.op10_private_data(spark, SF).collect():
        want = brute_private(source[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in PATTERNS] == [sum(w.startswith(k) for w in want) for k in PATTERNS]
        assert set(want) <= set(r["spans"].split(",")) | {""}
    out = private_data.detect_private_data(odd_docs).collect()
    assert len(out) == 10 and all(r["redacted"] == r["text"] for r in out if r["doc_id"] in (0, 1, 2, 3))
    assert private_data.detect_private_data(odd_docs.limit(0)).count() == 0


def test_private_spans_of_random_texts():
    rng = random.Random(2)
    for _ in range(3000):
        text = "".join(rng.choice("01234567890123..-- +@()ab") for _ in range(rng.randint(0, 60)))
        assert [f"{k}:{a}:{b}" for k, a, b, _ in private_data.find_spans(text, private_data.BASE)] == brute_private(text)
    text = "Mail a.b@c.org, card 4111 1111 1111 1111, IBAN GB82 WEST 1234 5698 7654 32, SSN 123-45-6789; 123-45-6788 without a word near it" + " x" * 30
    spans = private_data.find_spans(text)
    assert {s[0] for s in spans} >= {"email", "card", "iban", "ssn"} and "a.b@c.org" not in private_data.redact(text, spans)
