"""Every query with a SQL form, beside DuckDB, on the smallest tables."""

import importlib.util
import math
import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from cohortlens.plans import registry

DATA = Path("/root/testdata/sf0.001")
SQL = registry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "-"
    if isinstance(v, bool):
        return str(v)
    return f"{float(v):.6f}" if isinstance(v, (int, float)) else str(v)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, con, name):
    df = registry.queries()[name](spark, str(DATA))
    cur = con.execute(SQL[name])
    cols = sorted(c[0] for c in cur.description)
    assert cols == sorted(df.columns)
    at = [c[0] for c in cur.description]
    want = sorted(tuple(cell(r[at.index(c)]) for c in cols) for r in cur.fetchall())
    assert sorted(tuple(cell(r[c]) for c in cols) for r in df.collect()) == want


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 5
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert importlib.util.find_spec("cohortlens.plans") is not None
