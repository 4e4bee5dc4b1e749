import hashlib
import random

import numpy as np
import pytest

from aspectra.llm import suffix_dedup as sd


def brute(rows, length):
    seen, out = set(), {}
    for i, t in sorted(rows):
        b = (t or "").encode()
        cover = bytearray(len(b))
        for k in range(len(b) - length + 1):
            w = b[k : k + length]
            if w in seen:
                cover[k : k + length] = b"\1" * length
            else:
                seen.add(w)
        kept = bytes(x for x, c in zip(b, cover) if not c)
        spans = sum(1 for k in range(len(cover)) if cover[k] and (k == 0 or not cover[k - 1]))
        out[i] = (len(b), sum(cover), spans, hashlib.sha256(kept).hexdigest(), kept)
    return out


def documents():
    rng = random.Random(5)
    passages = ["".join(rng.choice("abcdé") for _ in range(rng.randint(60, 260))) for _ in range(6)]
    part = lambda: rng.choice([rng.choice(passages), rng.choice(passages)[20:150], "".join(rng.choice("abcdefgh ") for _ in range(rng.randint(0, 90)))])
    rows = [(i, "".join(part() for _ in range(rng.randint(0, 7)))) for i in range(150)]
    return rows + [(1000, None), (1001, ""), (1002, "a" * 3000), (1003, "a" * 99), (1004, "a" * 100), (1005, "\x00" * 300), (1006, "ab" * 400), (-5, passages[0] * 2)]


def compare(spark, rows, length=100):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, batch string, id int")
    got = {r.id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, bytes(r.kept)) for r in sd.removed_runs(df, length, keep_text=True).collect()}
    assert got == brute(rows, length)


def test_against_brute_force(spark):
    compare(spark, documents())


def test_hot_seeds_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(sd, "HOT", 3)
    compare(spark, documents())


def test_other_lengths(spark):
    compare(spark, documents()[:60], 40)
    with pytest.raises(ValueError):
        sd.removed_runs(spark.createDataFrame([(1, "a")], "doc_id long, text string"), 32)


def test_empty_null_ids(spark):
    """Rows without an id get a row each, after all others."""
    rng = random.Random(4)
    other = "".join(rng.choice("abcdefgh") for _ in range(250))
    rows = [(None, "a" * 300), (1, "a" * 300), (None, None), (None, other), (None, other)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r.id, r.n_bytes, r.n_removed) for r in sd.removed_runs(df).collect()]
    assert sorted(got, key=str) == sorted([(1, 300, 299), (None, 300, 300), (None, 0, 0), (None, 250, 0), (None, 250, 250)], key=str)
    assert sd.removed_runs(df.limit(0)).count() == 0


def test_repeated_ids_go_by_text(spark):
    rng = random.Random(8)
    own = ["".join(rng.choice("abcdefgh") for _ in range(150)) for _ in range(3)]
    rows = [(3, own[0]), (3, own[0]), (3, own[1] + own[0]), (2, own[2]), (2, "x" + own[1])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.id, bytes(r.kept)) for r in sd.removed_runs(df, keep_text=True).collect())
    order = sorted(rows)
    want = brute([((i, n), t) for n, (i, t) in enumerate(order)], 100)
    assert got == sorted((i, v[4]) for (i, _), v in want.items())


@pytest.mark.parametrize("bits", [(3, 64), (64, 3)])
def test_one_hash_may_collide(spark, monkeypatch, bits):
    """With one hash nearly useless the results are the same: no decision rests on one."""
    for hot in (2000, 3):
        monkeypatch.setattr(sd, "HOT", hot)
        rows = documents()[:90]
        df = spark.createDataFrame(rows, "doc_id long, text string")
        got = {r.id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, bytes(r.kept)) for r in sd.removed_runs(df, keep_text=True, hash_bits=bits).collect()}
        assert got == brute(rows, 100)


def test_interval_tree():
    """Intervals of a known array: common prefixes of sorted suffixes."""
    got = sorted(sd.intervals([3, 5, 5, 1, 4], 1))
    assert got == [(1, 0, 5), (3, 0, 3), (4, 4, 5), (5, 1, 3)]
    assert list(sd.intervals([], 1)) == []
    assert sorted(sd.intervals([2, 2, 2], 3)) == []


def test_maximal_repeats_have_all_occurrences():
    rng = random.Random(9)
    core = bytes(rng.randrange(97, 123) for _ in range(120))
    texts = [bytes([65 + i]) * 80 + core + bytes([75 + i]) * 80 for i in range(5)]
    texts.append(b"Z" * 10 + core[:60] + b"Y" * 90)
    batch = sd.Batch(np.arange(6), texts, 100)
    rows = np.array([r for r in range(len(batch.at)) if batch.raw[batch.at[r] : batch.at[r] + 32] in core])
    for seed in np.unique(batch.seed[rows]):
        own = rows[batch.seed[rows] == seed]
        if len(own) < 5:
            continue
        groups = list(sd.maximal_repeats(batch.contexts(own), 100))
        assert any(left + right == 120 and len(members) == 5 for left, right, members in groups)
        assert all(len(set(members.tolist())) == len(members) >= 2 for _, _, members in groups)


def test_equal_windows_share_samples():
    """Wherever a window stands, its sample begins at the same place in it."""
    rng = random.Random(3)
    window = bytes(rng.randrange(256) for _ in range(100))
    places = set()
    for before in (0, 1, 7, 50, 300):
        data = bytes(rng.randrange(256) for _ in range(before)) + window + bytes(rng.randrange(256) for _ in range(40))
        places.add(int(sd.samples(np.frombuffer(data, np.uint8), 100)[before]) - before)
    assert len(places) == 1
