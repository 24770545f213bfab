"""Operators that SQL can express, against DuckDB."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

queries = pytest.importorskip("scoreloom.llm.queries")

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query(spark, name):
    c = duckdb.connect()
    for p in Path(SF).iterdir():
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    want = c.execute(queries.ORACLE_SQL[name])
    columns = [x[0] for x in want.description]
    got = queries.QUERIES[name](spark, SF).select(*columns)
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())
