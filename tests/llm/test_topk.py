import math
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from aspectra.llm.common import written
from aspectra.llm.topk import LONG, search_shard, top_k


def brute(rows, k):
    """A multiset of result rows: every row but the query's own is a candidate."""
    usable = []
    for i, v in rows:
        if i is None or v is None or not v or any(x is None or not math.isfinite(x) for x in v):
            continue
        usable.append((i, [math.floor(256 * x) for x in v]))
    out = []
    for at, (q, own) in enumerate(usable):
        if q % 50:
            continue
        found = [(-sum(a * b for a, b in zip(own, v)), i) for n, (i, v) in enumerate(usable) if n != at and len(v) == len(own)]
        out += [(q, r + 1, i, max(-LONG, min(LONG, -s))) for r, (s, i) in enumerate(sorted(found)[:k])]
    return Counter(out)


def check(spark, rows, k=5):
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<float>, id int, score int")
    rows32 = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    got = top_k(df, F.col("vec_id") % 50 == 0, k)
    assert Counter(tuple(r) for r in got.collect()) == brute(rows32, k)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]


def test_random_vectors(spark):
    rng = random.Random(1)
    check(spark, [(i, [rng.gauss(0, 1) for _ in range(16)]) for i in range(400)])


def test_ties_nulls_and_lengths(spark):
    rows = [(i, [1.0, 0.5]) for i in range(120)] + [(200, [1.0, 2.0, 3.0]), (250, [1.0, 1.0, 1.0]), (300, None), (350, [None, 1.0]), (400, [float("nan"), 1.0]), (450, [float("inf"), 1.0]), (500, []), (None, [1.0, 1.0])]
    check(spark, rows + rows[:7])


def test_few_candidates_and_none(spark):
    check(spark, [(0, [1.0]), (50, [-1.0]), (1, [3.0])])
    check(spark, [(0, [1.0])])
    check(spark, [])


def test_large_numbers_stay_exact(spark):
    rng = random.Random(2)
    check(spark, [(i * 10, [rng.uniform(-1e6, 1e6) for _ in range(4)]) for i in range(30)])


def test_very_large_components(spark):
    """Up to the largest float: no vector is left out, and scores beyond a long keep their order."""
    top = float(np.finfo(np.float32).max)
    rows = [(0, [4e13, 1.0]), (1, [4e13, 1.0]), (2, [1.0, 5.0]), (50, [3.0, 2.0]), (51, [-4e13, 7.0]), (100, [top, 1.0]), (101, [top, -top])]
    rows += [(102, [top / 2, 1.0]), (103, [-top, 0.0]), (150, [1.0, 1.0]), (7, [0.5, 0.25])]
    check(spark, rows)
    check(spark, rows, k=2)


def test_repeated_rows_count_each(spark, monkeypatch):
    from aspectra.llm import topk

    monkeypatch.setattr(topk, "BLOCK", 8)
    rng = random.Random(3)
    rows = [(i, [float(rng.randrange(-3, 4)) for _ in range(3)]) for i in range(120)]
    check(spark, rows + rows[:60] + [(50, [9.0, 9.0, 9.0])] * 2)


def test_agrees_with_sql_on_repeats(spark, tmp_path):
    import duckdb

    from aspectra.llm.queries import oracle_sql

    rows = [(i % 130, [float(i % 7), 1.0, -float(i % 3)], 0) for i in range(300)] + [(None, [1.0, 1.0, 1.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    df.coalesce(1).write.parquet(str(tmp_path / "e"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/e/*.parquet'")
    want = Counter(con.execute(oracle_sql()["op1_topk"]).fetchall())
    assert Counter(tuple(r) for r in top_k(df, F.col("vec_id") % 50 == 0).collect()) == want


def test_blocks_are_pruned(spark, monkeypatch):
    """Clustered blocks: most bounds fall below the k-th score, before blocks are sent."""
    from aspectra.llm import topk

    rng = np.random.default_rng(0)
    blocks = []
    for b in range(20):
        centre = rng.integers(-200, 200, 8)
        blocks.append((b, np.arange(b * 50, b * 50 + 50), centre + rng.integers(-3, 4, (50, 8))))
    every = np.concatenate([m for _, _, m in blocks])
    ids = np.arange(0, 1000, 100)
    queries, own = every[::100], np.stack([ids // 50, ids % 50], axis=1)
    low = np.stack([m.min(axis=0) for _, _, m in blocks]).astype(float)
    high = np.stack([m.max(axis=0) for _, _, m in blocks]).astype(float)
    row, vec, score, scored = search_shard(queries, own, np.full(10, -np.inf), blocks, low, high, 5)
    assert scored < 0.4 * len(queries) * len(blocks)
    for i, (q, at) in enumerate(zip(queries, ids)):
        s = every @ q
        want = sorted([(-int(s[j]), j) for j in range(1000) if j != at])[:5]
        assert [(-a, int(b)) for a, b, r in zip(score, vec, row) if r == i] == want
    kept = []
    monkeypatch.setattr(topk, "BLOCK", 50)
    monkeypatch.setattr(topk, "written", lambda df, label: kept.append((label, w := written(df, label))) or w)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.initialPartitionNum", "1")
    rows = [(int(i), [float(x) / 256 for x in v]) for i, v in enumerate(every)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").coalesce(1)
    got = top_k(df, F.col("vec_id") == 100).collect()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.initialPartitionNum")
    s = every @ every[100]
    assert [r.vec_id for r in got] == [j for _, j in sorted((-int(s[j]), j) for j in range(1000) if j != 100)[:5]]
    sent, made = dict(kept)["reached"].count(), dict(kept)["blocks"].count()
    assert sent < 0.5 * made
