import hashlib
import random
import struct

import pytest

from aspectra.llm import bpe, token_counts
from aspectra.llm.queries import tokenizer_path

tokenizers = pytest.importorskip("tokenizers")
WORD, BYTE = tokenizer_path("word_bpe_49k.json"), tokenizer_path("byte_bpe_50k.json")
MIX = "aA'sStTéÉΣσς  \n\t\x1c\x1d\x85\xa0İiÍ̇,.!?0१²Ⅷ漢字🎉‍\x00ﬁ ǅ<|>"


def texts(n=400):
    rng = random.Random(3)
    pool = [*MIX, "<|endoftext|>", "<|startoftext|>", "'ll", "'re", "  ", " the", " world"]
    out = ["".join(rng.choice(pool) for _ in range(rng.randint(0, 40))) for _ in range(n)]
    return out + ["", " " * 300, "a" * 3000, "ab" * 500, "!" * 999, "the cat sat. " * 200]


@pytest.fixture(scope="module")
def word():
    return tokenizers.Tokenizer.from_file(WORD)


@pytest.fixture(scope="module")
def byte():
    return tokenizers.Tokenizer.from_file(BYTE)


def test_words_as_the_library(word):
    encoder = bpe.WordEncoder(WORD)
    cache = bpe.WordCache(encoder, bpe.packed)
    own = texts()
    for text, values in zip(own, cache.of_many(own)):
        want = word.encode(text, add_special_tokens=False).ids
        raw = b"".join(values)
        assert list(struct.unpack(f"<{len(raw) // 4}I", raw)) == want
        assert encoder.encode(text) == want
        assert encoder.decode(want) == word.decode(want, skip_special_tokens=False)


def test_cuts_are_certain(word):
    """No token of any text spans a cut."""
    encoder = bpe.WordEncoder(WORD)
    words = ["qxzjk".encode(), "zqzqz".encode(), "hello".encode()]
    raw, starts, ends, owner = encoder.fragments(words)
    assert len(starts) > 3 and b"".join(raw[a:b].tobytes() for a, b in zip(starts, ends)) == b"".join(words)
    inner = {bytes([p >> 8, p & 255]) for p in range(1 << 16) if encoder.inner[p]}
    for a, w in zip(starts[1:], owner[1:]):
        if w == owner[list(starts).index(a) - 1]:
            assert bytes(raw[a - 1 : a + 1]) not in inner


def test_rows_and_heap_merge_alike():
    v = bpe.Vocabulary(WORD)
    rows, heap = bpe.RowMerger(v.merges), bpe.LongWord(v.merges)
    import numpy as np

    rng = random.Random(1)
    for _ in range(50):
        raw = bytes(rng.choice(b"aeinrst") for _ in range(30))
        ids = [v.byte_ids[b] for b in raw]
        merged = rows.merge(np.array([ids], np.int32))[0]
        assert merged[merged >= 0].tolist() == heap.merge(ids) == v.merge(ids)


def test_counts_and_every_prefix(byte):
    counter = token_counts.PrefixCounter(BYTE)
    size = lambda t: len(byte.encode(t, add_special_tokens=False).ids)
    for text in texts(150):
        assert counter.count(text) == size(text)
        text = text[:120]
        want = [size(text[:i]) for i in range(len(text) + 1)]
        assert counter.prefixes(text) == want
        for budget in (0, 1, 5, 9):
            assert counter.cut(text, budget) == max(i for i, n in enumerate(want) if n <= budget)


def frame(spark):
    rows = [(1, "The cat", "x", 9), (1, "The cat", "x", 9), (2, None, None, None), (None, "a", "y", 1), (3, "", "y", 2)]
    return spark.createDataFrame(rows, "doc_id long, text string, id string, n_tokens int")


def test_columns_with_nulls_and_clashing_names(spark, word, byte):
    got = sorted(bpe.round_trip_digests(frame(spark), WORD).collect(), key=str)
    ids = word.encode("The cat", add_special_tokens=False).ids
    sha = hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
    assert sum(r.ids_sha256 == sha and r.n_tokens == len(ids) for r in got) == 2
    assert sorted(str(r.id) for r in got) == ["1", "1", "2", "3", "None"]
    empty = [r for r in got if r.id == 2][0]
    assert (empty.n_tokens, empty.ids_sha256) == (0, hashlib.sha256(b"").hexdigest())
    counts = {str(r.id): (r.n_bytes, r.n_tokens, r.over_limit, r.budget_chars) for r in token_counts.count_tokens(frame(spark), BYTE, 1).collect()}
    assert counts["1"] == (7, 2, True, 3) and counts["2"] == (0, 0, False, 0)
    nothing = frame(spark).limit(0)
    assert bpe.round_trip_digests(nothing, WORD).count() == 0
    assert token_counts.count_tokens(nothing, BYTE).count() == 0
    decoded = bpe.decode_documents(bpe.encode_documents(frame(spark), WORD), WORD).collect()
    assert {r.text for r in decoded if r.id == 1} == {word.decode(ids, skip_special_tokens=False)}


def test_budgets_from_stored_tables():
    """What the counted pieces and their stored tables say is what cutting anew says."""
    import random

    rng = random.Random(12)
    counter = token_counts.PrefixCounter(BYTE)
    parts = ["don't", "it's", " ", "  ", "\n\n", "\t", "word", "Überzahl", "12345", "x" * 40, "…", "日本語", "a,b", "'", "' s", "<|endoftext|>", "<|"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(0, 60))) for _ in range(150)] + ["long " * 30_000 + "'" * 50]
    for budget in (1, 2, 7, 33):
        got = counter.count_and_cut(texts, budget)
        for text, (n, cut) in zip(texts, got):
            assert n == counter.count(text)
            assert cut == (len(text) if n <= budget else counter.cut(text, budget)), (text, budget)


def test_hashes_decide_nothing(monkeypatch):
    """Strings that hash like a token, but are none, are not taken for it."""
    import numpy as np

    counter = token_counts.PrefixCounter(BYTE)
    words = ["hello", "tokens", "zqxjk", "overflowing", "aaaa"]
    want = [counter.count(w) for w in words]
    other = token_counts.PrefixCounter(BYTE)
    find = other.by_hash.find
    fake = other.tokens[b"the"]
    other.by_hash.find = lambda keys: np.where(find(keys) < 0, fake, find(keys)).astype(np.int32)
    assert [n for n, _ in other.count_and_cut(words, 3)] == want


def test_long_words_are_forgotten(word):
    cache = bpe.WordCache(bpe.encoder_for(WORD), list)
    texts = ["x" * 5000 + " short", "x" * 5000, "é" * 70_000]
    got = [[i for own in t for i in own] for t in cache.of_many(texts)]
    assert got == [word.encode(t, add_special_tokens=False).ids for t in texts]
    assert max(map(len, cache)) <= bpe.LONG_WORD
