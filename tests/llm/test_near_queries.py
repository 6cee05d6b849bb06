"""The registered near-duplicate queries against their SQL, over tables with planted groups and odd rows."""

from __future__ import annotations

import random

import duckdb
import numpy as np

from lathework.llm import queries


def both(spark, folder, name, table, df):
    """Rows of the query and of its SQL over df, written as the table."""
    df.write.parquet(f"{folder}/{table}.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    theirs = con.execute(queries.ORACLES[name])
    columns = [c[0] for c in theirs.description]
    mine = queries.QUERIES[name](spark, str(folder)).select(*columns).collect()
    return sorted(tuple(r) for r in mine), sorted(theirs.fetchall())


def test_lattice_query(spark, tmp_path):
    # Groups of cosine 0.998 and more inside, far apart from each other: the hashing misses nothing there.
    rng = np.random.default_rng(11)
    base = rng.standard_normal((30, 64))
    rows = [(k, (base[k % 30] * (1 + k % 3) + 0.01 * rng.standard_normal(64)).astype(np.float32).tolist()) for k in range(150)]
    rows += [(200, rows[5][1]), (201, rows[5][1]), (202, None), (203, []), (204, [0.0] * 64), (205, [float("nan")] + [1.0] * 63), (206, [None] + [1.0] * 63), (207, [1.0, 2.0]), (208, [2.0, 4.0]), (209, [float("inf")] + [1.0] * 63)]
    mine, theirs = both(spark, tmp_path, "op5_lattice", "embeddings", spark.createDataFrame([(k, v, k % 4) for k, v in rows], "vec_id long, embedding array<float>, label int"))
    assert mine == theirs
    assert sum(not r[3] for r in mine) == 120 + 2 + 1


def test_minhash_query(spark, tmp_path):
    rng, stem = random.Random(5), [f"t{k}" for k in range(120)]
    texts = {}
    for k in range(80):  # edited copies on both sides of the border, of several lengths
        words = stem[: rng.randrange(40, 121)]
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(len(words))] = f"e{rng.randrange(30)}"
        texts[k] = rng.choice([" ", "\n", " \t"]).join(w.upper() if rng.random() < 0.1 else w for w in words)
    texts |= {100: None, 101: "", 102: " \n\t", 103: "one two", 104: "ONE  two", 105: "one", 106: "İ É one two three four", 107: "i̇ é one two three four", 108: texts[3]}
    mine, theirs = both(spark, tmp_path, "op8_minhash", "documents", spark.createDataFrame([(k, t, "en", "a", 1) for k, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long"))
    assert mine == theirs
    assert 10 < sum(not r[3] for r in mine) < 80
