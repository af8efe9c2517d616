"""Every registered query of the engine against its SQL, at the smallest scale."""

from __future__ import annotations

import pytest

import __spark_entry__
from dialoom.plans import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"


def plain(v):
    return int(v) if isinstance(v, float) and v.is_integer() else round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, DATA)
    cols = sorted(got.columns)
    rows = sorted((tuple(map(plain, r)) for r in got.select(cols).collect()), key=str)
    if name not in ORACLE_SQL:
        assert rows
        return
    assert cols == sorted(c[0] for c in duck.execute(ORACLE_SQL[name]).description)
    listed = ", ".join('"' + c + '"' for c in cols)
    want = duck.execute(f"SELECT {listed} FROM ({ORACLE_SQL[name]})").fetchall()
    assert rows == sorted((tuple(map(plain, r)) for r in want), key=str)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 1
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_scans_read_only_what_they_need(spark):
    plan = QUERIES["popularity_topk"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(o_orderdate), LessThan(o_orderdate" in plan and "l_extendedprice" not in plan
