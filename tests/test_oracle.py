"""Every registered query with an oracle agrees with DuckDB at sf0.001."""

import math

import duckdb
import pytest

from cohortwise.plans.catalog import REGISTRY
from cohortwise.sources.tables import BASE_TABLES

SF = "/root/testdata/sf0.001"

SPARK_TO_DUCK = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR",
                 "boolean": "BOOLEAN", "date": "DATE", "timestamp_ntz": "TIMESTAMP"}


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in BASE_TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def _norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return v


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(n for n, (_, sql) in REGISTRY.items() if sql))
def test_query_matches_oracle(spark, con, name):
    fn, sql = REGISTRY[name]
    df = fn(spark, SF)
    rel = con.sql(sql)
    duck = dict(zip(rel.columns, (str(t) for t in rel.types)))
    assert {c: SPARK_TO_DUCK.get(t, t) for c, t in df.dtypes} == duck
    assert _rows(df.columns, [tuple(r) for r in df.collect()]) == _rows(rel.columns, rel.fetchall())


def test_every_query_registered_runs(spark):
    import __spark_entry__ as E
    assert set(E.queries()) >= set(REGISTRY)
    assert set(E.oracle_sql()) <= set(E.queries())
    assert E.entry(spark).count() > 0
