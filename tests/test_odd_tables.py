"""Queries with SQL on small tables whose values the driver's small ones lack."""

import datetime as dt

import pytest

duckdb = pytest.importorskip("duckdb")

from aspectra import queries  # noqa: E402
from test_queries import plain  # noqa: E402

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


@pytest.fixture
def compare(spark, tmp_path):
    """Compares a query over the given events with its SQL."""

    def run(name, rows):
        path = str(tmp_path / "events.parquet")
        spark.createDataFrame(rows, EVENTS).coalesce(1).write.mode("overwrite").parquet(path)
        df = queries.queries()[name](spark, str(tmp_path))
        columns = sorted(df.columns)
        got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
        con = duckdb.connect()
        con.execute(f"CREATE VIEW events AS SELECT * FROM '{path}/*.parquet'")
        result = con.execute(queries.oracle_sql()[name])
        names = [d[0] for d in result.description]
        want = sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in result.fetchall())
        assert want
        assert got == want

    return run


def event(n, user, value, k, kind="click"):
    return n, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=n), user, kind, value, '{"k": %d}' % k


@pytest.mark.parametrize("name", ["snk_3_events", "wr_18_generic_save", "wr_1_add", "wr_8_decision"])
def test_stored_value_like_the_new_one(compare, name):
    compare(name, [event(0, 1, 9.0, 2), event(1, 1, 1.5, 1), event(2, 2, 1.5, 3), event(3, 3, 1.5, 10), event(4, 4, 7.0, 14)])


def test_layouts_are_read_once_and_repeats_count(spark):
    from collections import Counter

    from aspectra.operators import aspects

    one = [("a", None)] * 3 + [("b", 1), ("c", 2)] + [("d", 5)] * 25_001
    two = [("a", None)] + [("b", 1)] * 2 + [("e", 3)]
    old, new = (spark.createDataFrame(x, "urn string, `v.w` int") for x in (one, two))
    out = aspects.compare_layouts(old, new)
    assert out.columns == ["urn", "v.w", "only_in"]
    want = {("a", None, "old"): 2, ("c", 2, "old"): 1, ("d", 5, "old"): 25_001, ("b", 1, "new"): 1, ("e", 3, "new"): 1}
    assert Counter(map(tuple, out.collect())) == want
    assert out._jdf.queryExecution().analyzed().collectLeaves().size() == 2


def test_compared_layouts_rank_versions_once(spark, compare, tmp_path):
    rows = [event(n, n % 3, 100.0 * n, 1) for n in range(9)]
    compare("get_10_compare_layouts", rows)
    plan = queries.queries()["get_10_compare_layouts"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan
