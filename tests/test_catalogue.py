import glob
import math
import os

import duckdb
import pytest

from quern.plans import catalogue, flows, rasters

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS FROM '{p}'")
    return con


PLANS = {**catalogue.queries(), **rasters.queries(), **flows.queries()}
SQL = {**catalogue.oracle_sql(), **rasters.oracle_sql(), **flows.oracle_sql()}


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, duck, name):
    got = PLANS[name](spark, SF)
    cur = duck.execute(SQL[name])
    cols = [c[0] for c in cur.description]
    want = cur.fetchall()
    assert sorted(cols) == sorted(got.columns)

    def rows(values):
        return sorted(tuple(f"{v:.5f}" if isinstance(v, float) and math.isfinite(v) else str(v) for v in r) for r in values)

    assert rows(tuple(r[c] for c in sorted(cols)) for r in got.collect()) == rows(tuple(r[cols.index(c)] for c in sorted(cols)) for r in want)


def _same(spark, name, d):
    """Whether a query over the tables in d returns what its SQL does."""
    con = duckdb.connect()
    for p in glob.glob(f"{d}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS FROM '{p}'")
    got = PLANS[name](spark, str(d))
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({SQL[name]})").fetchall()
    return sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in got.collect())


def test_uploads_at_odd_prices(spark, tmp_path):
    """Cents that no double holds, sizes in the middle between two tenths of a megabyte, and missing values."""
    cents = "[3, 57, 58, 15728640, 15728641, 15885927, 15990784, 16619930, 17039360, 18087936, 27525120]"
    rows = f"SELECT i AS o_orderkey, i % 2 AS o_custkey, 'F' AS o_orderstatus, c / 100.0::double AS o_totalprice FROM (SELECT unnest({cents}) AS c, generate_subscripts({cents}, 1) AS i)"
    more = "SELECT * FROM (VALUES (20, 1, 'O', NULL), (NULL, 1, 'O', 5.0::double), (21, 1, NULL, 5.0::double), (22, 1, 'F', 0.0::double), (23, 0, 'F', 157286.405::double), (24, 0, 'F', 0.004::double))"
    duckdb.execute(f"COPY ({rows} UNION ALL {more}) TO '{tmp_path}/orders.parquet'")
    assert _same(spark, "uploads_judged", tmp_path)


def test_nested_document_is_whole(spark, tmp_path):
    """A customer is one row however far apart the ids of its orders are."""
    ids = "SELECT unnest([70000, 3, 140000, NULL, 10, 9]) AS o_orderkey, unnest([1, 1, 1, 1, 2, NULL]) AS o_custkey UNION ALL SELECT NULL, 3"
    duckdb.execute(f"COPY ({ids}) TO '{tmp_path}/orders.parquet'")
    assert _same(spark, "nested_document_build", tmp_path)
    got = {r.o_custkey: (r.orders, r.n) for r in catalogue.queries()["nested_document_build"](spark, str(tmp_path)).collect()}
    assert got == {1: ("3,70000,140000", 4), 2: ("10", 1), None: ("9", 1), 3: (None, 1)}
