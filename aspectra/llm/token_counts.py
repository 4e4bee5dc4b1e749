"""Exact token counts at every prefix, by dynamic programming (operator 2).

For merge-ranked BPE a token sequence is the encoding of its text exactly if
every neighbouring pair of tokens is the encoding of its own bytes.  So the
encoding of a prefix ending at ``i`` is that of some shorter prefix plus one
last token, and the first last token whose pair with the shorter prefix's last
token is stable is the right one::

    last[i]  = the token t = piece[i - len(t) : i] with (last[i - len(t)], t) stable
    count[i] = count[i - len(t)] + 1

The table of a piece answers how many tokens any prefix has, and where to cut
a text for a budget, without encoding again.  Pieces (pre-tokens) do not share
tokens, so the table of a text is the tables of its pieces laid end to end.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from itertools import accumulate

import numpy as np
import regex
from pyspark.sql import DataFrame

from .bpe import (
    CACHE_ENTRIES,
    NARROW,
    NARROW_LETTERS,
    NARROW_NUMBERS,
    NARROW_WHITE,
    SLICE,
    WHITE,
    RowMerger,
    Vocabulary,
)
from .common import require, spread, text_or_empty


#: Bytes of the longest pieces whose tables are filled as rows.
ROW_BYTES = 32
_BASE = 0x9E3779B97F4A7C15


class IntTable:
    """A hash table from 64-bit keys to small numbers, on whole arrays."""

    def __init__(self, bits: int = 16):
        self._make(bits)

    def _make(self, bits: int) -> None:
        self.bits, self.used = bits, 0
        self.keys = np.zeros(1 << bits, np.uint64)
        self.values = np.full(1 << bits, -1, np.int32)  # -1: free

    def _home(self, keys: np.ndarray) -> np.ndarray:
        mixed = (keys ^ (keys >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Values; -1 for keys that are not there."""
        at, mask = self._home(keys), (1 << self.bits) - 1
        out = self.values[at]
        open_ = np.flatnonzero((out >= 0) & (self.keys[at] != keys))
        while len(open_):
            at[open_] = (at[open_] + 1) & mask
            out[open_] = self.values[at[open_]]
            open_ = open_[(out[open_] >= 0) & (self.keys[at[open_]] != keys[open_])]
        return out

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Adds distinct keys that are not there."""
        if 2 * (self.used + len(keys)) > 1 << self.bits:
            old = self.values >= 0
            kept = self.keys[old], self.values[old]
            self._make(max(self.bits + 1, (4 * (len(kept[0]) + len(keys))).bit_length()))
            self.add(*kept)
        self.used += len(keys)
        at, mask, left = self._home(keys), (1 << self.bits) - 1, np.arange(len(keys))
        while len(left):
            free = self.values[at[left]] < 0
            own = left[free]
            self.values[at[own]], self.keys[at[own]] = values[own], keys[own]
            # Of several that took one place the last has it.
            lost = np.concatenate((left[~free], own[self.keys[at[own]] != keys[own]]))
            at[lost] = (at[lost] + 1) & mask
            left = lost


class PrefixCounter(dict):
    """Token counts of prefixes for a byte-level vocabulary file.

    As a mapping it holds the token counts of the pieces met so far.
    """

    #: How texts are cut before merging (a fixed value of the vocabulary).
    PIECES = regex.compile(
        r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    )
    #: The same for texts of narrow characters only.
    SHORT = re.compile(
        f"'s|'t|'re|'ve|'m|'ll|'d| ?[{NARROW_LETTERS}]+| ?[{NARROW_NUMBERS}]+"
        f"| ?[^{NARROW_WHITE}{NARROW_LETTERS}{NARROW_NUMBERS}]+"
        f"|[{NARROW_WHITE}]+(?![^{NARROW_WHITE}])|[{NARROW_WHITE}]+"
    )
    #: White space and what follows it: pieces never span two units.
    UNITS = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")
    _LEAD = re.compile(f"[{WHITE}]*")

    def __init__(self, path: str):
        super().__init__()
        self.vocab = v = Vocabulary(path)
        of = v.byte_of
        self.tokens: dict[bytes, int] = {}
        for name, i in v.ids.items():
            if name not in v.specials and all(c in of for c in name):
                self.tokens[bytes(of[c] for c in name)] = i
        self.bytes = {i: raw for raw, i in self.tokens.items()}
        self.longest = max(map(len, self.tokens))
        self.stable_pairs: dict[tuple[int, int], bool] = {}
        self.reachable: dict[int, bool] = {}
        self.tables: dict[bytes, tuple[int, ...]] = {}
        self.rows = RowMerger(v.merges)
        self.byte_ids = np.array(v.byte_ids, np.int32)
        self.raw = [self.bytes.get(i, b"") for i in range(max(self.bytes) + 1)]
        self.by_hash, self.pairs = IntTable(18), IntTable(18)
        short = [t for t in self.tokens if len(t) <= ROW_BYTES]
        whole, lengths = self._padded(short)
        self.base = _BASE
        while True:  # a base for which no two tokens have one hash
            hashes = self._hashes(whole)[np.arange(len(short)), lengths] ^ lengths.astype(np.uint64)
            if len(np.unique(hashes)) == len(short):
                break
            self.base += 2
        self.powers = np.array([pow(self.base, i, 1 << 64) for i in range(ROW_BYTES + 1)], np.uint64)
        ids = np.array([self.tokens[t] for t in short], np.int32)
        self.by_hash.add(hashes, ids)
        # The tokens' bytes, to compare what is found by hash with.
        self.token_bytes = np.zeros((len(self.raw), ROW_BYTES), np.uint8)
        self.token_bytes[ids, : whole.shape[1]] = whole
        self.token_size = np.zeros(len(self.raw), np.int32)
        self.token_size[ids] = lengths
        # The whole tables of short pieces: token counts of all prefixes, a byte each.
        self.prefix_rows: dict[str, bytes] = {}
        self.alone = np.zeros(len(self.raw), bool)
        self.alone[ids] = self._encode_to([[i] for i in ids.tolist()])
        names = sorted(v.specials, key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, names))) if names else None

    # -- one piece ---------------------------------------------------------

    def _encodes_to(self, raw: bytes, ids: list[int]) -> bool:
        return self.vocab.merge([self.vocab.byte_ids[b] for b in raw]) == ids

    def stable(self, left: int, right: int) -> bool:
        """Whether the two tokens' bytes encode to just these two tokens."""
        key = (left, right)
        known = self.stable_pairs.get(key)
        if known is None:
            if len(self.stable_pairs) > CACHE_ENTRIES:
                self.stable_pairs.clear()
            known = self._encodes_to(self.bytes[left] + self.bytes[right], [left, right])
            self.stable_pairs[key] = known
        return known

    def single(self, token: int) -> bool:
        """Whether the token's bytes encode to the token itself."""
        known = self.reachable.get(token)
        if known is None:
            known = self._encodes_to(self.bytes[token], [token])
            self.reachable[token] = known
        return known

    def table(self, piece: bytes) -> tuple[int, ...]:
        """Token counts of ``piece[:i]`` for every i from 0 to its length."""
        found = self.tables.get(piece)
        if found is None:
            found = self._table(piece)
            if len(piece) <= 64:
                if len(self.tables) >= CACHE_ENTRIES // 8:
                    self.tables.clear()
                self.tables[piece] = found
        return found

    def _table(self, piece: bytes) -> tuple[int, ...]:
        n, tokens, longest = len(piece), self.tokens, self.longest
        last, count = [-1] * (n + 1), [0] * (n + 1)
        for i in range(1, n + 1):
            for start in range(max(0, i - longest), i):
                t = tokens.get(piece[start:i])
                if t is None:
                    continue
                if self.single(t) if start == 0 else self.stable(last[start], t):
                    last[i], count[i] = t, count[start] + 1
                    break
        return tuple(count)

    # -- many pieces -------------------------------------------------------

    @staticmethod
    def _padded(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(bytes as rows, lengths)."""
        lengths = np.fromiter(map(len, raws), np.int64, len(raws))
        width = int(lengths.max(initial=1))
        out = np.zeros((len(raws), width), np.uint8)
        out[np.arange(width)[None, :] < lengths[:, None]] = np.frombuffer(b"".join(raws), np.uint8)
        return out, lengths

    def _hashes(self, rows: np.ndarray) -> np.ndarray:
        """Polynomial hashes of every prefix of every row."""
        out = np.zeros((len(rows), rows.shape[1] + 1), np.uint64)
        for i in range(rows.shape[1]):
            out[:, i + 1] = out[:, i] * np.uint64(self.base) + rows[:, i].astype(np.uint64) + np.uint64(1)
        return out

    def _encode_to(self, wanted: list[list[int]]) -> np.ndarray:
        """For token sequences: whether their bytes encode to just them."""
        raws = [b"".join([self.raw[i] for i in ids]) for ids in wanted]
        out = np.zeros(len(wanted), bool)
        size = np.fromiter(map(len, raws), np.int64, len(raws))
        for low, high in ((0, 8), (8, 16), (16, 32), (32, 1 << 30)):
            own = np.flatnonzero((size > low) & (size <= high))
            for at in range(0, len(own), 1 << 14):
                part = own[at : at + (1 << 14)].tolist()
                rows, lengths = self._padded([raws[i] for i in part])
                ids = np.where(np.arange(rows.shape[1])[None, :] < lengths[:, None], self.byte_ids[rows], -1)
                merged = self.rows.merge(ids)
                alive = merged >= 0
                number = alive.sum(axis=1)
                flat, ends = merged[alive], np.cumsum(number)
                for k, i in enumerate(part):
                    n = len(wanted[i])
                    out[i] = number[k] == n and flat[ends[k] - n : ends[k]].tolist() == wanted[i]
        return out

    def _stable_many(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)
        found = self.pairs.find(keys)
        new = np.unique(keys[found < 0])
        if len(new):
            if self.pairs.used > 2 * CACHE_ENTRIES:
                self.pairs = IntTable(18)
                new = np.unique(keys)
            pairs = [[k >> 32, k & 0xFFFFFFFF] for k in new.tolist()]
            self.pairs.add(new, self._encode_to(pairs).astype(np.int32))
            found = self.pairs.find(keys)
        return found > 0

    def tables_of(self, raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(tables as rows, lengths) of pieces of at most ROW_BYTES bytes.

        The tables of all pieces are filled together, position by position,
        by the same rule as in :meth:`table`.  Tokens are found by hash and
        then compared byte by byte.
        """
        rows, lengths = self._padded(raws)
        hashes = self._hashes(rows)
        n, width = rows.shape
        last = np.full((n, width + 1), -1, np.int32)
        count = np.zeros((n, width + 1), np.int32)
        for i in range(1, width + 1):
            todo = np.flatnonzero(lengths >= i)
            for start in range(i):
                if not len(todo):
                    break
                own = hashes[todo, i] - hashes[todo, start] * self.powers[i - start]
                token = self.by_hash.find(own ^ np.uint64(i - start))
                some = np.flatnonzero(token >= 0)
                if not len(some):
                    continue
                same = self.token_size[token[some]] == i - start
                same &= (rows[todo[some], start:i] == self.token_bytes[token[some], : i - start]).all(axis=1)
                some = some[same]
                token, at = token[some], todo[some]
                good = self.alone[token] if start == 0 else self._stable_many(last[at, start], token)
                last[at[good], i] = token[good]
                count[at[good], i] = count[at[good], start] + 1
                todo = np.delete(todo, some[good])
        return count, lengths

    def learn(self, pieces: set[str]) -> None:
        """Counts of all pieces not met so far."""
        missing = [*(pieces - self.keys())]
        if len(self) + len(missing) > CACHE_ENTRIES:
            self.clear()
            self.prefix_rows.clear()
            missing = [*pieces]
        raws = [p.encode("utf-8", "surrogatepass") for p in missing]
        size = np.fromiter(map(len, raws), np.int64, len(raws))
        for low, high in ((0, 4), (4, 6), (6, 8), (8, 10), (10, 12), (12, 16), (16, 22), (22, ROW_BYTES)):
            own = np.flatnonzero((size > low) & (size <= high)).tolist()
            for at in range(0, len(own), 1 << 13):
                part = own[at : at + (1 << 13)]
                tables, lengths = self.tables_of([raws[i] for i in part])
                for i, n, row in zip(part, lengths.tolist(), tables.astype(np.uint8)):
                    self.prefix_rows[missing[i]] = kept = row[: n + 1].tobytes()
                    self[missing[i]] = kept[-1]

    def count_many(self, texts: list[str]) -> list[int]:
        """Tokens of whole texts; unseen pieces of a slice are met together."""
        return [n for n, _ in self.count_and_cut(texts, None)]

    def count_and_cut(self, texts: list[str], budget: int | None) -> list[tuple[int, int]]:
        """(tokens, characters of the longest prefix within ``budget``) of whole texts.

        The pieces that were counted say in which unit the budget ends, and
        the stored tables where in it: nothing is split or encoded again.
        """
        out, at, get = [], 0, self.__getitem__
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (end == at or size + len(texts[end]) <= SLICE):
                size += len(texts[end])
                end += 1
            split = [[(self.pieces(p), special) for p, special in self.segments(t)] for t in texts[at:end]]
            self.learn({p for parts in split for own, special in parts if not special for p in own})
            for text, parts in zip(texts[at:end], split):
                n = sum(1 if special else sum(map(get, own)) for own, special in parts)
                if budget is None or n <= budget:
                    cut = len(text)
                elif len(parts) == 1 and not parts[0][1]:
                    cut = self._cut_pieces(text, parts[0][0], budget)
                else:
                    cut = self.cut(text, budget)
                out.append((n, cut))
            at = end
        return out

    def _cut_pieces(self, text: str, pieces: list[str], budget: int) -> int:
        """:meth:`cut` for a text without special strings, from its pieces."""
        k = before = place = 0
        for k, piece in enumerate(pieces):
            if before + self[piece] > budget:
                break
            before += self[piece]
            place += len(piece)
        # Back to where the unit begins: white space, then what is none.
        first = place
        if not self._is_white(text[first]):
            while first and not self._is_white(text[first - 1]):
                first -= 1
        while first and self._is_white(text[first - 1]):
            first -= 1
        while place > first:
            k -= 1
            before -= self[pieces[k]]
            place -= len(pieces[k])
        unit = self.UNITS.match(text, first)[0]
        table = self.unit_prefixes(unit)
        return first + max(i for i, n in enumerate(table) if n <= budget - before)

    def _is_white(self, c: str) -> bool:
        return self._LEAD.match(c).end() > 0

    # -- units and texts ---------------------------------------------------

    def __missing__(self, piece: str) -> int:
        """Tokens of a piece: the last entry of its table."""
        n = self.table(piece.encode("utf-8", "surrogatepass"))[-1]
        if len(piece) <= 64:
            if len(self) >= CACHE_ENTRIES:
                self.clear()
                self.prefix_rows.clear()
            self[piece] = n
        return n

    def pieces(self, text: str) -> list[str]:
        """The pieces of a text without special strings."""
        pattern = self.SHORT if NARROW.search(text) is None else self.PIECES
        return pattern.findall(text)

    def unit_count(self, unit: str) -> int:
        return sum(map(self.__getitem__, self.pieces(unit)))

    def unit_prefixes(self, unit: str) -> list[int]:
        """Token counts of ``unit[:i]`` for every i from 0 to its length.

        Cutting inside a unit can change how it is split only in two ways:
        white space at the end of a text is one piece, and a contraction cut
        after its first letter is an apostrophe and a letter.
        """
        lead = self._LEAD.match(unit).end()
        out = [0]
        at, white = 0, self.table(unit[:lead].encode())
        for i in range(lead):
            at += len(unit[i].encode())
            out.append(white[at])
        before = 0
        for m in self.PIECES.finditer(unit):
            piece, start = m[0], m.start()
            counts = self.prefix_rows.get(piece) or self.table(piece.encode("utf-8", "surrogatepass"))
            at = 0
            for k, c in enumerate(piece, 1):
                at += len(c.encode("utf-8", "surrogatepass"))
                if start + k <= lead:
                    continue
                n = counts[at]
                if k == 2 and len(piece) > 2 and piece[0] == "'" and c.isalpha():
                    n = 2
                out.append(before + n)
            before += counts[-1]
        return out

    def segments(self, text: str) -> list[tuple[str, bool]]:
        """The text cut at special strings; True marks those."""
        if self.special is None or "<|" not in text:
            return [(text, False)]
        out, at = [], 0
        for m in self.special.finditer(text):
            out += [(text[at : m.start()], False), (m[0], True)]
            at = m.end()
        out.append((text[at:], False))
        return [x for x in out if x[0]]

    def count(self, text: str) -> int:
        """Tokens of the whole text: its pieces' last table entries."""
        get = self.__getitem__
        return sum(
            1 if special else sum(map(get, self.pieces(part)))
            for part, special in self.segments(text)
        )

    def units_until(self, text: str, budget: int) -> tuple[list[str], list[int]]:
        """Units (special strings are units) and their tokens, until their sum
        is over ``budget``, and one more."""
        units, counts, left = [], [], budget
        for part, special in self.segments(text):
            found = [part] if special else (m[0] for m in self.UNITS.finditer(part))
            for unit in found:
                units.append(unit)
                counts.append(1 if special else self.unit_count(unit))
                if left < 0:
                    return units, counts
                left -= counts[-1]
        return units, counts

    def prefixes(self, text: str) -> list[int]:
        """Token counts of ``text[:i]`` for every i from 0 to its length."""
        out, base, tail = [0], 0, ""
        for part, special in self.segments(text):
            if special:
                # A special string that is cut is ordinary text after the tail.
                for k in range(1, len(part)):
                    units = self.UNITS.findall(tail + part[:k])
                    out.append(base - self._of(tail) + sum(map(self.unit_count, units)))
                base, tail = base + 1, ""
                out.append(base)
                continue
            for unit in self.UNITS.findall(part):
                out += [base + n for n in self.unit_prefixes(unit)[1:]]
                base, tail = base + self.unit_count(unit), unit
        return out

    def _of(self, unit: str) -> int:
        return self.unit_count(unit) if unit else 0

    def cut(self, text: str, budget: int) -> int:
        """Characters of the longest prefix with at most ``budget`` tokens.

        Only the unit in which the budget ends needs its prefix table.
        """
        units, counts = self.units_until(text, budget)
        return self.cut_units(units, counts, budget)

    def cut_units(self, units: list[str], counts: list[int], budget: int) -> int:
        if budget <= 0 or not units:
            return 0
        sums = [*accumulate(counts, initial=0)]
        k = min(bisect_right(sums, budget - 1) - 1, len(units) - 1)
        room, unit = budget - sums[k], units[k]
        at = sum(map(len, units[:k]))
        if self.special and unit in self.vocab.specials:
            return at + len(unit)
        table = self.unit_prefixes(unit)
        best = at + max(i for i, n in enumerate(table) if n <= room)
        follows = units[k + 1] if k + 1 < len(units) else ""
        if best == at + len(unit) and self.special and follows in self.vocab.specials:
            # The start of a special string is text that may join this unit's tokens.
            for j in range(len(follows) - 1, 0, -1):
                own = self.UNITS.findall(unit + follows[:j])
                if sum(map(self.unit_count, own)) <= room:
                    return best + j
        return best


_COUNTERS: dict[str, PrefixCounter] = {}


def counter_for(path: str) -> PrefixCounter:
    """One counter per worker process and vocabulary file."""
    if path not in _COUNTERS:
        _COUNTERS[path] = PrefixCounter(path)
    return _COUNTERS[path]


def count_tokens(
    docs: DataFrame,
    path: str,
    budget: int = 512,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit, budget_chars) of every whole text.

    ``budget_chars``: characters of the longest prefix with at most ``budget``
    tokens.  Null and empty texts have no tokens; repeated rows stay; other
    columns are dropped, whatever their names.  No shuffle.
    """
    require(docs, id_col, text_col)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        counter = counter_for(path)
        for batch in batches:
            size, total, cut = [], [], []
            texts = batch.column(1).to_pylist()
            for text, (n, characters) in zip(texts, counter.count_and_cut(texts, budget)):
                size.append(len(text.encode("utf-8")))
                total.append(n)
                cut.append(characters)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(size, pa.int64()),
                    pa.array(total, pa.int64()),
                    pa.array([n > budget for n in total], pa.bool_()),
                    pa.array(cut, pa.int64()),
                ],
                names=["id", "n_bytes", "n_tokens", "over_limit", "budget_chars"],
            )

    picked = spread(docs.select(docs[id_col].alias("id"), text_or_empty(text_col).alias("text")))
    return picked.mapInArrow(
        run,
        f"id {kind}, n_bytes long, n_tokens long, over_limit boolean, budget_chars long",
    )
