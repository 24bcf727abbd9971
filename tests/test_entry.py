"""The driver's contract: names, registered SQL, and results that agree on the smallest tables."""

import decimal
import importlib.util
import os
import sys

import duckdb
import pytest

SF = "/root/testdata/sf0.001"
sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
import __spark_entry__ as entry  # noqa: E402

CORE = sorted(n for n in __import__("tendril.queries", fromlist=["QUERIES"]).QUERIES)


def norm(v):
    if isinstance(v, (float, decimal.Decimal)):
        return f"{float(v):.6g}" if v else "0"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(norm, v)) + "]"
    return str(v)


def test_registry_needs_no_session():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert (importlib.util.find_spec("tendril.llm") is None) == ("p8_ids" not in entry.queries())


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for f in os.listdir(SF):
        c.execute(f"create view {f[:-8]} as select * from '{SF}/{f}'")
    return c


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", CORE)
def test_same_as_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    rows, cols = df.collect(), df.columns
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert len(set(cols)) == len(cols)
        return
    r = duck.execute(sql)
    names = [x[0] for x in r.description]
    want = r.fetchall()
    assert sorted(cols) == sorted(names)
    order = sorted(cols)
    assert sorted(tuple(norm(x[c]) for c in order) for x in rows) == sorted(tuple(norm(x[names.index(c)]) for c in order) for x in want)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_entry(spark):
    assert entry.entry(spark).count() > 0
