"""Every registered query against its DuckDB oracle on the smallest tables."""

import decimal
import math

import duckdb
import pytest

import __spark_entry__ as E
from tokenmill.session import TABLES

SF = "/root/testdata/sf0.001"
ORACLES = E.oracle_sql()
QUERIES = E.queries()


def _norm(v):
    if v is None:
        return None
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, (list, tuple)):
        return tuple(map(_norm, v))
    if isinstance(v, float):
        return str(v) if math.isnan(v) or math.isinf(v) else round(v, 6) + 0.0
    return v


def _rows(columns, rows):
    cols = sorted(columns)
    at = [list(columns).index(c) for c in cols]
    rows = [[r[i] for i in at] for r in rows]
    rows = [tuple(map(_norm, r)) for r in rows]
    return cols, sorted(rows, key=lambda t: tuple((x is None, str(x)) for x in t))


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, con, name):
    df = QUERIES[name](spark, SF)
    sp_cols, sp_rows = _rows(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(ORACLES[name])
    dk_cols, dk_rows = _rows([d[0] for d in cur.description], cur.fetchall())
    assert sp_cols == dk_cols
    assert len(sp_rows) == len(dk_rows)
    assert sp_rows == dk_rows


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert set(df.columns) == {"split", "lang", "n_targets", "n_bytes", "bpb"}
    assert len(rows) > 0
