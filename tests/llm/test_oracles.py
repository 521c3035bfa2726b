"""The training-data queries that SQL can express, against that SQL."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

from folioflow.llm.oracles import ORACLES
from folioflow.llm.queries import QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equal_to_sql(spark, sf_dir, name):
    db = duckdb.connect()
    for path in Path(sf_dir).glob("*.parquet"):
        db.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    df, want = QUERIES[name](spark, sf_dir), db.sql(ORACLES[name])
    columns = sorted(df.columns)
    assert sorted(want.columns) == columns
    places = [want.columns.index(c) for c in columns]
    key = lambda row: tuple((x is None, str(x)) for x in row)
    assert sorted((tuple(r[c] for c in columns) for r in df.collect()), key=key) == sorted((tuple(r[i] for i in places) for r in want.fetchall()), key=key)
