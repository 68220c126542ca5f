"""Queries with oracle SQL against DuckDB, and the registry as a whole."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__
from postlake.llm.registry import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    want = con.execute(ORACLES[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(df.columns)
    assert sorted(map(tuple, df.select(columns).collect()), key=str) == sorted(want.fetchall(), key=str)


def test_each_operator_has_its_query():
    names = set(__spark_entry__.queries())
    assert "pipeline" in names
    assert {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{i}" for i in range(1, 14)}
