"""Every query with SQL against DuckDB on the smallest tables."""

import math
import os

import pytest

duckdb = pytest.importorskip("duckdb")
DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

from aspectra import queries  # noqa: E402


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 9))
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(plain, v)) + "]"
    return repr(v)


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query(spark, db, name):
    df = queries.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    result = db.execute(queries.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    want = sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in result.fetchall())
    assert got == want


def test_all_queries_have_sql():
    assert set(queries.queries()) == set(queries.oracle_sql())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_filters_reach_the_scan(spark, tmp_path):
    """On materialised paths, comparisons are pushed and columns pruned."""
    from aspectra.operators import index
    from aspectra.plans.criteria import Condition, IndexCriterion, IndexFilter
    from aspectra.sources import driver

    driver.customers(spark, DATA).write.parquet(str(tmp_path / "c"))
    table = spark.read.parquet(str(tmp_path / "c"))
    wanted = IndexFilter((IndexCriterion("CustomerInfo", "/segment", Condition.EQUAL, "BUILDING"),))
    plan = index.list_urns(table, queries.CUSTOMER, wanted)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(i_info$segment,BUILDING)" in plan.replace("`", "")
    assert "a_info" not in plan
