"""Every query with SQL against DuckDB on the smallest tables, and rows of the others."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from laminaspark.plans.registry import ORACLE, QUERIES

KINDS = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def db(sf):
    c = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(ORACLE) <= set(QUERIES) <= set(entry.queries())


def rows(cursor_rows, order):
    return sorted((tuple(r[k] for k in order) for r in cursor_rows), key=repr)


@pytest.mark.parametrize("name", list(ORACLE))
def test_against_sql(spark, sf, db, name):
    df = QUERIES[name](spark, sf)
    want = db.sql(ORACLE[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert {k: KINDS[v] for k, v in df.dtypes} == {k: str(v) for k, v in zip(want.columns, want.types, strict=True)}
    names = sorted(df.columns)
    got = rows((r.asDict() for r in df.collect()), names)
    assert got == rows((dict(zip(want.columns, r, strict=True)) for r in want.fetchall()), names)


@pytest.mark.parametrize(("name", "made", "key"), [("q45_format", "events", "event_id"), ("q71_describe", "embeddings", "vec_id")])
def test_large_numbers_against_sql(spark, sf, tmp_path, name, made, key):
    """Ids of six digits and more, and of more than 16 bits."""
    c, (low, high) = duckdb.connect(), {"event_id": (99_990, 10**9), "vec_id": (65_530, (1 << 31) - 1)}[key]
    c.execute(f"COPY (SELECT t.* REPLACE (CAST(CASE WHEN {key} % 2 = 0 THEN {low} + {key} ELSE {high} - {key} * 1000003 END AS BIGINT) AS {key}) FROM '{sf}/{made}.parquet' t) TO '{tmp_path}/{made}.parquet'")
    want = c.sql(ORACLE[name].replace(f"FROM {made}", f"FROM '{tmp_path}/{made}.parquet'"))
    got = QUERIES[name](spark, str(tmp_path)).select(*want.columns).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(want.fetchall(), key=repr)
