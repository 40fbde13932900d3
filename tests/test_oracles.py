"""Every named query against its SQL statement on the smallest tables."""

import pytest

import __spark_entry__ as entry
from ledgerloom.catalog import ORACLES, QUERIES
from tools.check import close, rows_of

from .conftest import FOLDER

# Rows that a query without a statement must have at the smallest scale; the models have tests of their own.
SLOW = ("ml0",)
UNWANTED = ("CartesianProduct", "BroadcastNestedLoopJoin", "ArrowEval", "BatchEval", "PythonUDF")


@pytest.mark.parametrize("name", [n for n in QUERIES if n in ORACLES])
def test_same_answer(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    physical = df._jdf.queryExecution().executedPlan().toString()
    assert not [w for w in UNWANTED if w in physical]
    cur = duck.execute(ORACLES[name])
    cols = [c[0] for c in cur.description]
    want = rows_of(cols, cur.fetchall())
    assert sorted(df.columns) == sorted(cols)
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert all(close(x, y) for x, y in zip(a, b)), (a, b)


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in ORACLES and not n.startswith(SLOW)])
def test_rows_without_statement(spark, name):
    df = QUERIES[name](spark, FOLDER)
    assert df.count() > 0 and df.count() == len(df.collect())


def test_statements_belong_to_queries():
    assert set(ORACLES) <= set(QUERIES)
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())


def test_entry(spark):
    assert entry.entry(spark).count() == 12
