"""Every registered query with oracle SQL agrees with DuckDB on sf0.001
(row count, column names and an order-insensitive value hash)."""

import os

import pytest

from tests.conftest import SF_SMALL

duckdb = pytest.importorskip("duckdb")

SKIP_GROUPS = {"ml"}  # rows-only model queries are exercised by the driver


def _digest(cols, rows):
    import importlib.util
    spec = importlib.util.spec_from_file_location("check", os.path.join(os.path.dirname(__file__), "..", "tools", "check.py"))
    mod = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(mod)
    return mod.digest(cols, rows)


def _names():
    import __spark_entry__ as E
    from textlake.plans.registry import REGISTRY
    E.queries()
    return sorted(n for n, q in REGISTRY.items() if q.sql and q.group not in SKIP_GROUPS)


@pytest.fixture(scope="module")
def con():
    from tools.check import TABLES
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", _names())
def test_query_matches_oracle(spark, con, name):
    import __spark_entry__ as E
    df = E.queries()[name](spark, SF_SMALL)
    rows = df.collect()
    cur = con.execute(E.oracle_sql()[name])
    orows = cur.fetchall()
    ocols = [d[0] for d in cur.description]
    sc, sh, _ = _digest(df.columns, rows)
    oc, oh, _ = _digest(ocols, orows)
    assert sc == oc
    assert len(rows) == len(orows)
    assert sh == oh


def test_entry_smoke(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.count() >= 0 and "porcentaje" in df.columns
