"""Byte-pair encoding with forced-boundary splitting (operator 5).

A pair of neighbouring bytes that occurs inside no vocabulary token can never
end up inside one token, whatever the merges do.  Every such pair in a word is
a *certain cut*: the fragments between cuts are encoded independently and
their ids concatenated.  Fragments are short and repeat, so each is encoded
once per worker.

Words are looked up first; those not seen before are encoded together.  Their
fragments become rows of symbols, and one numpy step applies the best merge of
every row, leftmost first, until no row has one left.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import regex
from pyspark.sql import DataFrame

from .common import require, spread, text_or_empty

#: Unicode White_Space, as a character class body.
WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

#: Words a worker keeps before it starts afresh.
CACHE_ENTRIES = 1_000_000
#: Symbols of the longest fragments that are merged as rows.
ROW_SYMBOLS = 64
#: Characters of text that are split before unseen words are encoded.
SLICE = 4_000_000

#: Characters for which the short word patterns below hold, and their classes.
NARROW = re.compile("[^\\x00-\u012f\u0131-\u017f]")
NARROW_WHITE = r"\t-\r \x85\xa0"
NARROW_LETTERS = r"A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u017f"
NARROW_NUMBERS = r"0-9\xb2\xb3\xb9\xbc-\xbe"


@lru_cache(maxsize=1)
def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in vocabulary files.

    Bytes that print keep their own code point; the others take the code
    points from 256 upwards in byte order.
    """
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


class Vocabulary:
    """A vocabulary file of kind BPE: symbols, ids and merge ranks."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        self.ids: dict[str, int] = model["vocab"]
        self.specials: dict[str, int] = {
            t["content"]: t["id"] for t in spec["added_tokens"]
        }
        self.names: dict[int, str] = {i: t for t, i in self.ids.items()}
        self.names.update({i: t for t, i in self.specials.items()})
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            key = (self.ids[left], self.ids[right])
            self.merges.setdefault(key, (rank, self.ids[left + right]))
        symbols = byte_symbols()
        self.byte_ids = [self.ids[s] for s in symbols]
        self.last_ids = [self.ids[s + self.suffix] for s in symbols]
        self.byte_of = {s: b for b, s in enumerate(symbols)}

    def merge(self, ids: list[int]) -> list[int]:
        """Apply the merges in rank order, leftmost first among equals."""
        get = self.merges.get
        while len(ids) > 1:
            best = None
            for pair in zip(ids, ids[1:]):
                m = get(pair)
                if m is not None and (best is None or m[0] < best[0]):
                    best, which = m, pair
            if best is None:
                break
            out, i, new, n = [], 0, best[1], len(ids)
            left, right = which
            while i < n:
                if i + 1 < n and ids[i] == left and ids[i + 1] == right:
                    out.append(new)
                    i += 2
                else:
                    out.append(ids[i])
                    i += 1
            ids = out
        return ids


class LongWord:
    """Merging for long fragments, with a heap: n log n steps, not n squared."""

    def __init__(self, merges: dict[tuple[int, int], tuple[int, int]]):
        self.merges = merges

    def merge(self, ids: list[int]) -> list[int]:
        import heapq

        get, n = self.merges.get, len(ids)
        ids, after, before = list(ids), [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [
            (m[0], i, ids[i], ids[i + 1], m[1])
            for i in range(n - 1)
            if (m := get((ids[i], ids[i + 1])))
        ]
        heapq.heapify(heap)
        while heap:
            _, i, left, right, new = heapq.heappop(heap)
            j = after[i]
            if ids[i] != left or j < 0 or ids[j] != right:
                continue
            ids[i], ids[j], after[i] = new, -1, after[j]
            if after[i] >= 0:
                before[after[i]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b >= 0 and (m := get((ids[a], ids[b]))):
                    heapq.heappush(heap, (m[0], a, ids[a], ids[b], m[1]))
        return [x for x in ids if x >= 0]


class RowMerger:
    """Merges many short symbol rows at once."""

    #: No merge.
    NONE = np.int32(2**31 - 1)

    def __init__(self, merges: dict[tuple[int, int], tuple[int, int]]):
        size = 1 << max(4, (4 * len(merges)).bit_length())
        self.shift = np.uint64(64 - (size.bit_length() - 1))
        self.mask = size - 1
        self.keys = np.full(size, -1, np.int64)
        self.ranks = np.full(size, self.NONE, np.int32)
        self.new = np.zeros(size, np.int32)
        for (left, right), (rank, new) in merges.items():
            key = left << 32 | right
            at = ((key * 0x9E3779B97F4A7C15) & (2**64 - 1)) >> int(self.shift)
            while self.keys[at] >= 0:
                at = (at + 1) & self.mask
            self.keys[at], self.ranks[at], self.new[at] = key, rank, new

    def find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, merged id) of pairs; NONE where a side is negative or no
        merge exists."""
        key = left.astype(np.int64) << 32 | right.astype(np.int64) & 0xFFFFFFFF
        at = ((key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)
        found = self.keys[at]
        open_ = np.flatnonzero((found != key) & (found >= 0))
        while len(open_):
            at[open_] = (at[open_] + 1) & self.mask
            found = self.keys[at[open_]]
            open_ = open_[(found != key[open_]) & (found >= 0)]
        hit = (self.keys[at] == key) & (left >= 0) & (right >= 0)
        return np.where(hit, self.ranks[at], self.NONE), self.new[at]

    def merge(self, ids: np.ndarray) -> np.ndarray:
        """Rows of ids padded with -1, merged; -1 where symbols went."""
        n, width = ids.shape
        if not n or width < 2:
            return ids
        ids = ids.astype(np.int32)
        place = np.arange(width, dtype=np.int32)
        after = np.tile(place + 1, (n, 1))
        before = np.tile(place - 1, (n, 1))
        ranks, _ = self.find(ids[:, :-1].ravel(), ids[:, 1:].ravel())
        ranks = np.c_[ranks.reshape(n, width - 1), np.full(n, self.NONE, np.int32)]
        active = np.arange(n)
        while len(active):
            i = ranks[active].argmin(axis=1)
            some = ranks[active, i] != self.NONE
            active, i = active[some], i[some]
            if not len(active):
                break
            j = after[active, i]
            _, new = self.find(ids[active, i], ids[active, j])
            ids[active, i], ids[active, j] = new, -1
            ranks[active, j] = self.NONE
            k = after[active, j]
            after[active, i] = k
            inside = k < width
            rows, at = active[inside], k[inside]
            before[rows, at] = i[inside]
            right = np.full(len(active), -1, np.int32)
            right[inside] = ids[rows, at]
            ranks[active, i] = self.find(new, right)[0]
            h = before[active, i]
            inside = h >= 0
            rows, at = active[inside], h[inside]
            ranks[rows, at] = self.find(ids[rows, at], new[inside])[0]
        return ids


class WordEncoder:
    """Encodes text by the word-BPE vocabulary, by forced-boundary splitting."""

    #: The word pattern of this kind of vocabulary (a fixed value).
    WORDS = regex.compile(
        r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    )
    #: The same for texts of narrow characters only.
    SHORT = re.compile(
        "'s|'t|'re|'ve|'m|'ll|'d"
        f"|[{NARROW_LETTERS}]+|[{NARROW_NUMBERS}]"
        f"|[^{NARROW_WHITE}{NARROW_LETTERS}{NARROW_NUMBERS}]+"
    )

    def __init__(self, path: str):
        self.vocab = v = Vocabulary(path)
        inner = self._inner_pairs()
        self.inner = np.zeros(1 << 16, bool)
        self.inner[sorted(inner)] = True
        self.rows = RowMerger(v.merges)
        self.long = LongWord(v.merges)
        self.byte_ids = np.array(v.byte_ids, np.int32)
        self.last_ids = np.array(v.last_ids, np.int32)
        names = sorted(v.specials, key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, names))) if names else None

    def _inner_pairs(self) -> set[int]:
        """Neighbouring bytes that occur inside some token, as a * 256 + b."""
        pairs, of, suffix = set(), self.vocab.byte_of, self.vocab.suffix
        for token in self.vocab.ids:
            body = token.removesuffix(suffix) if suffix else token
            raw = [of[c] for c in body if c in of]
            if len(raw) == len(body):
                pairs.update(a * 256 + b for a, b in zip(raw, raw[1:]))
        return pairs

    def words(self, text: str) -> list[str]:
        """The words of a text without special strings, normalised."""
        if NARROW.search(text) is None:
            return self.SHORT.findall(text.lower())
        text = unicodedata.normalize("NFC", text)
        # Character by character, as the library does: no final-sigma rule.
        return self.WORDS.findall(text.replace("Σ", "σ").lower())

    def fragments(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(bytes, starts, ends, word) of the fragments between certain cuts."""
        raw = np.frombuffer(b"".join(words), np.uint8)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
        if not len(raw):
            none = np.zeros(0, np.int64)
            return raw, none, none, none
        cut = np.ones(len(raw), bool)  # whether a fragment begins here
        cut[1:] = ~self.inner[raw[:-1].astype(np.int64) * 256 + raw[1:]]
        cut[ends[:-1][ends[:-1] < len(raw)]] = True
        starts = np.flatnonzero(cut)
        return raw, starts, np.append(starts[1:], len(raw)), np.searchsorted(ends, starts, side="right")

    def encode_many(self, words: list[bytes]) -> list[np.ndarray]:
        """Ids of each word: its fragments' ids, one after the other."""
        raw, starts, ends, word = self.fragments(words)
        if not len(starts):
            return [np.zeros(0, np.int32) for _ in words]
        symbols = self.byte_ids[raw]
        last = np.append(word[1:] != word[:-1], True)
        symbols[ends[last] - 1] = self.last_ids[raw[ends[last] - 1]]
        out = symbols.copy()  # merged in place; -1 where symbols went
        size = ends - starts
        low = 1
        for high in (6, 10, 16, 32, ROW_SYMBOLS):
            own = np.flatnonzero((size > low) & (size <= high))
            for at in range(0, len(own), 1 << 14):
                part = own[at : at + (1 << 14)]
                where = starts[part][:, None] + np.arange(high)
                inside = where < ends[part][:, None]
                rows = np.where(inside, symbols[np.where(inside, where, 0)], -1)
                out[where[inside]] = self.rows.merge(rows)[inside]
            low = high
        for i in np.flatnonzero(size > ROW_SYMBOLS):
            merged = self.long.merge(symbols[starts[i] : ends[i]].tolist())
            out[starts[i] : ends[i]] = -1
            out[starts[i] : starts[i] + len(merged)] = merged
        kept = out >= 0
        flat = out[kept]
        number = np.concatenate(([0], np.cumsum(kept)))
        edges = np.concatenate(([0], np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))))
        bounds = number[edges].tolist()
        return [flat[a:b] for a, b in zip(bounds, bounds[1:])]

    def pieces(self, text: str) -> Iterator[tuple[str, int | None]]:
        """Parts between special strings (id None), and those (their id)."""
        if self.special is None or "<|" not in text:
            yield text, None
            return
        at = 0
        for m in self.special.finditer(text):
            yield text[at : m.start()], None
            yield m[0], self.vocab.specials[m[0]]
            at = m.end()
        yield text[at:], None

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        for part, special in self.pieces(text):
            if special is not None:
                out.append(special)
                continue
            for ids in self.encode_many([w.encode("utf-8") for w in self.words(part)]):
                out.extend(ids.tolist())
        return out

    def decode(self, ids: Iterable[int]) -> str:
        """The library's decoding of a vocabulary without a decoder: tokens
        joined by one space."""
        return " ".join(self.vocab.names[i] for i in ids if i in self.vocab.names)


#: Words of more characters are forgotten after their slice.
LONG_WORD = 64


class WordCache(dict):
    """word -> ``make(ids)``; starts afresh when it is full.

    Long words stay for their slice only, so the number of entries bounds the
    bytes.
    """

    def __init__(self, encoder: WordEncoder, make):
        super().__init__()
        self.encoder, self.make = encoder, make

    def of_many(self, texts: list[str]) -> Iterator[list]:
        """The values of each whole text's words, in order.

        Texts are taken in slices; the unseen words of a slice are encoded
        together.
        """
        at = 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (end == at or size + len(texts[end]) <= SLICE):
                size += len(texts[end])
                end += 1
            split = [self._split(t) for t in texts[at:end]]
            long = self._learn(split)
            get = self.__getitem__
            for words in split:
                if type(words) is list:
                    yield [*map(get, words)]
                else:
                    yield [v for own, special in words for v in (map(get, own) if special is None else [self.make(np.array([special], np.int32))])]
            for word in long:
                del self[word]
            at = end

    def _split(self, text: str):
        """The words of a text; a tuple of parts where special strings occur."""
        if "<|" not in text:
            return self.encoder.words(text)
        return tuple(
            (self.encoder.words(part) if special is None else (), special)
            for part, special in self.encoder.pieces(text)
        )

    def _learn(self, split: list) -> list[str]:
        """Encodes the unseen words; returns the long ones among them."""
        seen: set[str] = set()
        for words in split:
            if type(words) is list:
                seen.update(words)
            else:
                for own, _ in words:
                    seen.update(own)
        missing = [*(seen - self.keys())]
        if len(self) + len(missing) > CACHE_ENTRIES:
            self.clear()
            missing = [*seen]
        make = self.make
        for word, ids in zip(missing, self.encoder.encode_many([w.encode("utf-8") for w in missing])):
            self[word] = make(ids)
        return [w for w in missing if len(w) > LONG_WORD]


_ENCODERS: dict[str, WordEncoder] = {}


def encoder_for(path: str) -> WordEncoder:
    """One encoder per worker process and vocabulary file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def packed(ids: np.ndarray) -> bytes:
    """Ids as little-endian unsigned 32-bit numbers."""
    return np.asarray(ids, "<u4").tobytes()


def encode_documents(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, ids): the token ids of every whole text as packed binary.

    Null texts are empty and give empty ids; repeated rows stay; other columns
    are dropped, whatever their names.
    """
    require(docs, id_col, text_col)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        cache = WordCache(encoder_for(path), packed)
        for batch in batches:
            out = [b"".join(own) for own in cache.of_many(batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(out, pa.binary())], names=["id", "ids"]
            )

    picked = spread(docs.select(docs[id_col].alias("id"), text_or_empty(text_col).alias("text")))
    return picked.mapInArrow(run, f"id {kind}, ids binary")


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """(id, text): decodes the packed ids of :func:`encode_documents`."""
    require(encoded, "id", "ids")
    kind = encoded.schema["id"].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        encoder = encoder_for(path)
        for batch in batches:
            out = []
            for raw in batch.column(1).to_pylist():
                raw = raw or b""
                out.append(encoder.decode(struct.unpack(f"<{len(raw) // 4}I", raw)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(out, pa.string())], names=["id", "text"]
            )

    return encoded.select("id", "ids").mapInArrow(run, f"id {kind}, text string")


def round_trip_digests(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) of every whole text.

    Ids and decoded text are fed to the digests as they are joined, so what
    leaves the executors is a few bytes a document.  Null texts are empty:
    no tokens, the digests of nothing.
    """
    require(docs, id_col, text_col)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        encoder = encoder_for(path)
        names = encoder.vocab.names

        def make(ids):
            ids = ids.tolist()
            return " ".join(map(str, ids)), " ".join([names[i] for i in ids]), len(ids)

        cache = WordCache(encoder, make)
        for batch in batches:
            counts, ids_sha, text_sha = [], [], []
            for entries in cache.of_many(batch.column(1).to_pylist()):
                if entries:
                    ids, words, n = zip(*entries)
                else:
                    ids, words, n = (), (), ()
                counts.append(sum(n))
                ids_sha.append(hashlib.sha256(" ".join(ids).encode()).hexdigest())
                text_sha.append(hashlib.sha256(" ".join(words).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(counts, pa.int64()),
                    pa.array(ids_sha, pa.string()),
                    pa.array(text_sha, pa.string()),
                ],
                names=["id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    picked = spread(docs.select(docs[id_col].alias("id"), text_or_empty(text_col).alias("text")))
    return picked.mapInArrow(
        run, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
