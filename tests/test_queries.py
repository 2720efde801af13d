"""Every registered query against its SQL in DuckDB on the smallest tables."""

import math
from pathlib import Path

import pytest

import __spark_entry__ as contract

duckdb = pytest.importorskip("duckdb")
DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.is_dir(), reason="the given tables are not here")

QUERIES, ORACLE = contract.queries(), contract.oracle_sql()


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for path in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def plain(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    found = []
    for r in rows:
        values = [r[i] for i in order]
        found.append(tuple(None if isinstance(v, float) and math.isnan(v) else v for v in values))
    return sorted(found, key=lambda r: tuple((v is None, f"{v:.4e}" if isinstance(v, float) else str(v)) for v in r))


def same(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return math.isclose(a, b, rel_tol=1e-6, abs_tol=1e-6)
    return a == b


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, tables, name):
    df = QUERIES[name](spark, str(DATA))
    got = plain([tuple(r) for r in df.collect()], df.columns)
    assert got
    plan = df._jdf.queryExecution().executedPlan().toString()
    for slow in ("CartesianProduct", "NestedLoopJoin", "BatchEvalPython", "ArrowEvalPython"):
        assert slow not in plan
    if name not in ORACLE:
        return
    found = tables.execute(ORACLE[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(df.columns)
    want = plain(found.fetchall(), columns)
    assert len(got) == len(want)
    bad = [(a, b) for a, b in zip(got, want, strict=True) if not all(map(same, a, b))]
    assert not bad, bad[:3]


def test_flagship(spark):
    assert contract.entry(spark).count() > 0
