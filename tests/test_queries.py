"""Every registered query against its DuckDB oracle on sf0.001 (the driver's check, at small size)."""

import os

import duckdb
import pytest

import __spark_entry__ as entry_module
from tools.oracle_check import TABLES, digest

SF = "/root/testdata/sf0.001"
QUERIES = {k: entry_module.queries()[k] for k in entry_module.QUERIES}
ORACLE = {k: v for k, v in entry_module.oracle_sql().items() if k in QUERIES}

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test data not present")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{SF}/{t}.parquet"):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLE)


def test_entry_smoke(spark):
    df = entry_module.entry(spark)
    assert df.columns == ["region", "pollutant", "period", "label", "traffic", "year_feature"]
    assert df.count() > 0


def _spark_family(dtype: str) -> str:
    if dtype in ("tinyint", "smallint", "int", "bigint"):
        return "integer"
    if dtype in ("float", "double") or dtype.startswith("decimal"):
        return "number"
    if dtype.startswith("timestamp"):
        return "timestamp"
    return {"string": "text", "boolean": "bool", "date": "date"}.get(dtype, dtype)


def _duck_family(dtype: str) -> str:
    dtype = dtype.upper()
    if dtype in ("TINYINT", "SMALLINT", "INTEGER", "BIGINT", "HUGEINT"):
        return "integer"
    if dtype in ("FLOAT", "DOUBLE") or dtype.startswith("DECIMAL"):
        return "number"
    if dtype.startswith("TIMESTAMP"):
        return "timestamp"
    return {"VARCHAR": "text", "BOOLEAN": "bool", "DATE": "date"}.get(dtype, dtype)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, con, name):
    df = QUERIES[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    cur = con.execute(ORACLE[name])
    ocols = [d[0] for d in cur.description]
    otypes = {d[0]: _duck_family(str(d[1])) for d in cur.description}
    orows = cur.fetchall()
    assert sorted(df.columns) == sorted(ocols)
    stypes = {c: _spark_family(t) for c, t in df.dtypes}
    assert stypes == otypes
    assert len(rows) == len(orows)
    assert digest(df.columns, rows)[0] == digest(ocols, orows)[0]
