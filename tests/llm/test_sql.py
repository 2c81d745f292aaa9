"""Queries with DuckDB SQL equal it on the smallest tables; the others have tests of their own."""

import duckdb
import pytest

import __spark_entry__ as entry
from loomlog.llm import queries


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, sf_dir, name):
    c = duckdb.connect()
    for t in ("documents", "conversations", "labels"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    got = entry.queries()[name](spark, sf_dir)
    want = c.sql(queries.oracle_sql()[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = lambda df: sorted(map(tuple, df[columns].itertuples(index=False)), key=str)
    assert rows(got.toPandas()) == rows(want.df())


def test_registered_names():
    names = [n for n in entry.queries() if n.startswith("op")]
    assert [n.split("_")[0] for n in names] == [f"op{i}" for i in range(1, 11)] and "pipeline" in entry.queries()
