"""Every query of the file tools against its SQL, over whole tables."""

from __future__ import annotations

import duckdb
import pandas as pd
import pytest

from lathework.plans import file_queries  # noqa: F401  registers more of them
from lathework.plans.queries import ORACLES, QUERIES


SF = "/root/testdata/sf0.001"


def normal(frame):
    frame = frame[sorted(frame.columns)]
    rows = [tuple(None if pd.isna(x) else round(x, 9) if isinstance(x, float) else x.item() if hasattr(x, "item") else x for x in r) for r in frame.astype(object).itertuples(index=False)]
    return list(frame.columns), sorted(rows, key=repr)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "part", "events", "lineitem", "orders"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    mine, theirs = QUERIES[name](spark, SF).toPandas(), con.execute(ORACLES[name]).df()
    assert len(mine) > 0 or name == "batch_empty"
    assert [c for c in normal(mine)[0]] == [c for c in normal(theirs)[0]]
    for a, b in zip(normal(mine)[1], normal(theirs)[1], strict=True):
        assert tuple(map(float_or, a)) == tuple(map(float_or, b))


def float_or(x):
    return float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else x
