import random
import zlib

import pytest

from aspectra.llm import packing
from aspectra.llm.bpe import packed
from aspectra.llm.queries import tokenizer_path

tokenizers = pytest.importorskip("tokenizers")
WORD = tokenizer_path("word_bpe_49k.json")


def simulate(slots, histogram, capacity):
    """Fills sequences by the plan; returns their lengths."""
    fill, ranks = {}, {n: set() for n in histogram}
    for length, first, number, sequence, offset in sorted(slots, key=lambda s: s[4]):
        for k in range(number):
            assert fill.get(sequence + k, 0) == offset
            fill[sequence + k] = offset + length
            assert first + k not in ranks[length]
            ranks[length].add(first + k)
    assert all(ranks[n] == set(range(c)) for n, c in histogram.items())
    assert max(fill.values(), default=0) <= capacity
    return fill


@pytest.mark.parametrize("seed", range(6))
def test_plans(seed):
    rng = random.Random(seed)
    histogram = {n: rng.choice([1, 2, 7, 100]) for n in rng.sample(range(1, 101), rng.randint(1, 60))}
    slots = packing.plan_slots(histogram, 100)
    fill = simulate(slots, histogram, 100)
    rooms = []  # best fit, longest first, piece by piece
    for n in sorted(histogram, reverse=True):
        for _ in range(histogram[n]):
            fits = [(r, i) for i, r in enumerate(rooms) if r >= n]
            if fits:
                rooms[min(fits)[1]] -= n
            else:
                rooms.append(100 - n)
    assert len(fill) <= len(rooms)


def test_small_plans():
    assert packing.plan_slots({}, 8) == []
    assert len(simulate(packing.plan_slots({8: 3}, 8), {8: 3}, 8)) == 3
    assert len(simulate(packing.plan_slots({5: 2, 3: 2}, 8), {5: 2, 3: 2}, 8)) == 2
    assert len(simulate(packing.plan_slots({1: 17}, 8), {1: 17}, 8)) == 3
    with pytest.raises(ValueError):
        packing.plan_slots({9: 1}, 8)


def test_plan_follows_lengths_not_pieces():
    few = packing.plan_slots({n: 10 for n in range(1, 301)}, 300)
    many = packing.plan_slots({n: 10_000_000 for n in range(1, 301)}, 300)
    assert len(many) < 3 * len(few)


def check(spark, rows, capacity, monkeypatch=None):
    t = tokenizers.Tokenizer.from_file(WORD)
    df = spark.createDataFrame([(i, x, 1, 2) for i, x in rows], "doc_id long, text string, length int, offset int")
    got = packing.pack_documents(df, WORD, capacity).collect()
    want = []
    for i, x in rows:
        ids = t.encode(x or "", add_special_tokens=False).ids + [0]
        for k, at in enumerate(range(0, len(ids), capacity)):
            part = ids[at : at + capacity]
            want.append((i, k, at, len(part), zlib.crc32(packed(part))))
    assert sorted(map(str, want)) == sorted(str((r.id, r.piece, r.start, r.length, r.ids_crc32)) for r in got)
    by = {}
    for r in sorted(got, key=lambda r: r.offset):
        assert by.get(r.sequence_id, 0) == r.offset
        by[r.sequence_id] = r.offset + r.length
    assert all(n <= capacity for n in by.values())
    return len(by), sum(r.length for r in got)


def test_documents(spark, monkeypatch):
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choice(["cat", "sat", "mats", "ox"]) for _ in range(rng.randint(0, 90)))) for i in range(200)]
    rows += [(500, None), (501, ""), (502, "a b " * 400), (None, "x"), (3, "twice"), (3, "twice")]
    monkeypatch.setattr(packing, "RUN", 2)
    monkeypatch.setattr(packing, "SALTS", 2)
    n, total = check(spark, rows, 64)
    assert n <= -(-total // 64) + 2
    check(spark, [(1, "a")], 8)


def test_ranks_of_one_length_are_summed_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(packing, "RUN", 3)
    monkeypatch.setattr(packing, "SALTS", 4)
    df = spark.createDataFrame([(i, 5) for i in range(200)] + [(i, 3) for i in range(200, 231)], "id long, length long")
    got = packing.pack(df, 8, ["id"]).collect()
    assert len({(r.sequence_id, r.offset) for r in got}) == 231 and len({r.sequence_id for r in got}) == 200


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack_documents(df, WORD).count() == 0
