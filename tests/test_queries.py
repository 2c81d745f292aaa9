"""Every registered query with SQL equals DuckDB on the smallest tables; all others run."""

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from loomlog import registry

TABLES = ["documents", "conversations", "events"]


def canonical(df: pd.DataFrame) -> list[tuple]:
    columns = sorted(df.columns)
    rows = [tuple(None if v is None or v is pd.NA or v != v else round(float(v), 6) if isinstance(v, float) else str(v) for v in r) for r in df[columns].itertuples(index=False)]
    return sorted(rows, key=str)


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, sf_dir, duck, name):
    got = registry.QUERIES[name](spark, sf_dir).toPandas()
    if name in registry.SQL:
        want = duck.sql(registry.SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert canonical(got) == canonical(want)
    assert len(got) > 0 or name in ("hard_limit",)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_the_plan_prunes_and_does_not_shuffle_more_than_it_must(spark, sf_dir):
    plan = registry.QUERIES["token_estimate"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan and "Exchange" not in plan
    plan = registry.QUERIES["cold_blocks"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 2
