from __future__ import annotations

import pytest
from pyspark.sql import functions as F

NAMES = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and blank texts, repeated rows, a very long text, and a column that clashes with results."""
    long = " ".join(f"w{k % 977}x{k % 13}" for k in range(60_000))
    rows = [(0, None, None, None, None), (1, "", "en", "a", 0), (2, " \t\n ", "en", "a", 4), (3, "one two", "en", "b", 7), (4, "one two", "en", "b", 7), (4, "one two", "en", "b", 7), (5, long, "fr", "b", len(long)), (6, long, "fr", None, len(long)), (None, "lost key " * 30, "de", "c", None), (7, "Ünïcode 🙂 text 'tis we're <|endoftext|> x", "de", "c", 30)]
    return spark.createDataFrame(rows, NAMES).withColumn("kept", F.lit("mine")).withColumn("size", F.lit("mine"))
