"""Every registered query with SQL against DuckDB on the smallest tables, and what plans must not hold."""

from pathlib import Path

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no tables here")
SQL = entry.oracle_sql()


def norm(v):
    if isinstance(v, float):
        return None if v != v else round(v, 5)
    return str(v.replace(tzinfo=None)) if hasattr(v, "isoformat") else v


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(repr(tuple(norm(r[c]) for c in cols)) for r in df.collect())
    cur = duck.execute(SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    want = sorted(repr(tuple(norm(r[names.index(c)]) for c in cols)) for r in cur.fetchall())
    assert got == want


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["normalize_text", "profile_messages", "reply_edges", "risk_levels", "per_class_prf", "split_assign"])
def test_plans_stay_in_the_jvm(spark, name):
    plan = entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_every_name_is_described_once():
    q = entry.queries()
    assert set(SQL) <= set(q) and all(callable(f) for f in q.values())
