import datetime
import os

import duckdb
import pytest

from mdframe import catalog_queries as catalog

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for x in TABLES:
        c.execute(f"create view {x} as select * from '{DATA}/{x}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if v != v else round(v, 6)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return v


@pytest.mark.parametrize("name", list(catalog.queries()))
def test_equals_duckdb(spark, duck, name):
    frame = catalog.queries()[name](spark, DATA)
    columns = sorted(frame.columns)
    own = sorted((tuple(plain(r[c]) for c in columns) for r in frame.collect()), key=str)
    other = duck.sql(catalog.oracle_sql()[name])
    assert sorted(other.columns) == columns
    theirs = sorted((tuple(plain(r[other.columns.index(c)]) for c in columns) for r in other.fetchall()), key=str)
    assert own == theirs


def test_plans(spark):
    """Filters and columns reach the scan; a body is parsed once; grouping has a partial step."""
    e = catalog.engine(spark, DATA)
    plan = e.explain("select o_orderkey from orders where o_totalprice > 100000 and o_orderstatus = 'F'")
    assert "GreaterThan(o_totalprice" in plan and "EqualNullSafe(o_orderstatus,F)" in plan
    assert "ReadSchema: struct<o_orderkey:bigint,o_orderstatus:string,o_totalprice:double>" in plan
    physical = e.explain("select h1[0].title, link.count(), code.count() from docs where status = 'F'").split("== Physical Plan ==")[1]
    assert physical.count("ArrowEvalPython") == 1 and "EqualNullSafe(o_orderstatus,F)" in physical
    assert "BroadcastNestedLoopJoin" not in e.explain("select c_custkey from customer where c_custkey in (select o_custkey from orders)")
