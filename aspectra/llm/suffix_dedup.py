"""Suffix-array deduplication by common-prefix interval trees (operator 8).

Texts are UTF-8 bytes.  Every byte covered by a string of ``length`` bytes
that also starts earlier (smaller document, or same document and smaller
start) is removed.

A suffix array of all bytes is not needed.  *Sample suffixes* are enough: the
content-defined minimizers of ``SEED``-byte seeds, chosen so that every window
of ``length`` bytes owns exactly one of them and equal windows own it at the
same place.  Two equal windows therefore show up as two sample suffixes that
agree to the right, and whose left extensions agree as far as the window
starts.

Documents are dealt into compressed batches once; every round below is one
exchange of packed arrays, one row per batch and hash range, and the answers
go back to the batches they concern.

1. Batches send the hashes of their seeds.  Seeds met twice come back.
2. For those, batches send digests of the context (the sample suffix and what
   stands to its left), with the earliest place.  A context that stands
   earlier elsewhere loses all windows of its sample.  A seed with several
   different contexts is asked for one of each.
3. Batches send these suffixes with their left contexts.  Per seed they form
   an enhanced suffix array; a stack scan of its common-prefix lengths lists
   the interval tree, and inside each interval the members, sorted by what
   stands to their left, are scanned for left-extension diversity.  What comes
   out are maximal repeats (left reach, right reach) with *all* occurrences;
   all but the earliest are marked.
4. Batches turn the answers into removed runs.

A seed with more than ``HOT`` occurrences is not sent to one task: in round 2
its windows are hashed whole, one by one, and their earliest places found by
hash range.  Its windows' repeats are the same, only found one by one.

Equal contexts and equal windows are recognised by two 64-bit hashes, each
salted anew in every run and always compared together: a wrong removal needs
two texts that collide in 128 bits.
"""

from __future__ import annotations

import hashlib
import secrets

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import require, text_or_empty

#: Bytes that the sample suffixes of one seed have in common.
SEED = 32
#: Occurrences beyond which a seed's windows are hashed one by one.
HOT = 2000
#: Bytes of text in a batch of documents, about: the least, and the most, which
#: large corpora come to, since a hot seed has a row for every batch.
BATCH_BYTES, BATCH_MOST = 4 << 20, 64 << 20
#: Batches up to which the least size holds.
BATCHES = 100_000
#: Windows that are sampled at a time.
PIECE = 1 << 16
#: Bytes that never occur in UTF-8 stand for what is outside a text.
OUTSIDE = 0xFF

_MULT = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)


def samples(data: np.ndarray, length: int) -> np.ndarray:
    """For every window of ``length`` bytes, where its sample begins.

    The sample has the least 32-bit hash of the window's seeds, the leftmost
    among equals.
    """
    block, size, base = data.astype(np.uint32) + np.uint32(1), 1, 0x9E3779B1
    while size < SEED:
        block = block[:-size] * np.uint32(pow(base, size, 1 << 32)) + block[size:]
        size *= 2
    block ^= block >> np.uint32(15)
    block *= np.uint32(0x85EBCA77)
    block ^= block >> np.uint32(13)
    block *= np.uint32(0xC2B2AE3D)
    key = block.astype(np.uint64) << np.uint64(32)
    key |= np.arange(len(block), dtype=np.uint64)
    span, least, size = length - SEED + 1, key, 1
    while size * 2 <= span:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if size < span:
        rest = span - size
        least = np.minimum(least[: len(key) - span + 1], least[rest : rest + len(key) - span + 1])
    return (least & np.uint64(0xFFFFFFFF)).astype(np.int64)


def mixed(rows: np.ndarray, salt: int = 0x243F6A8885A308D3) -> np.ndarray:
    """64-bit hashes of byte rows."""
    n, width = rows.shape
    if width % 8:
        rows = np.concatenate((rows, np.zeros((n, 8 - width % 8), np.uint8)), axis=1)
    words = np.ascontiguousarray(rows).view("<u8")
    out = np.full(n, salt, np.uint64)
    for k in range(words.shape[1]):
        out = (out ^ words[:, k]) * _MULT
        out ^= out >> np.uint64(29)
    out *= _MIX
    out ^= out >> np.uint64(32)
    return out


class Hashes:
    """Two salted 64-bit hashes of byte rows, of which ``bits`` each are kept."""

    def __init__(self, salts: tuple[int, int], bits: tuple[int, int] = (64, 64)):
        self.salts, self.bits = salts, bits

    def __call__(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return tuple(mixed(rows, s) >> np.uint64(64 - b) for s, b in zip(self.salts, self.bits))


def pair_unique(one: np.ndarray, two: np.ndarray):
    """(distinct ones, distinct twos, first row of each, rows' numbers), as np.unique gives them."""
    order = np.lexsort((two, one))
    a, b = one[order], two[order]
    new = np.ones(len(order), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    inverse = np.empty(len(order), np.int64)
    inverse[order] = np.cumsum(new) - 1
    return a[new], b[new], order[new], inverse


def pair_place(one: np.ndarray, two: np.ndarray, other: np.ndarray, another: np.ndarray) -> np.ndarray:
    """Where each pair of the second two arrays stands among the first (distinct); -1: nowhere."""
    distinct, _, _, inverse = pair_unique(np.concatenate((one, other)), np.concatenate((two, another)))
    place = np.full(len(distinct), -1, np.int64)
    place[inverse[: len(one)]] = np.arange(len(one))
    return place[inverse[len(one) :]]


class Batch:
    """Documents laid end to end, with the sample of every window."""

    def __init__(
        self,
        ids: np.ndarray,
        texts: list[bytes],
        length: int,
        keys: np.ndarray | None = None,
        none: np.ndarray | None = None,
    ):
        keys = np.zeros(len(ids), np.int64) if keys is None else keys
        none = np.zeros(len(ids), np.int64) if none is None else none
        order = np.lexsort((keys, ids))
        if ((np.diff(ids[order]) == 0) & (np.diff(keys[order]) == 0)).any():
            # The same order in every round, whatever order the rows come in.
            order = sorted(range(len(ids)), key=lambda i: (ids[i], keys[i], texts[i]))
        self.ids, self.keys = np.asarray(ids, np.int64)[order], np.asarray(keys, np.int64)[order]
        self.none = none[order].astype(bool)
        texts = [texts[i] for i in order]
        self.length = length
        self.sizes = np.array([len(t) for t in texts], np.int64)
        self.starts = np.concatenate(([0], np.cumsum(self.sizes)))[:-1].astype(np.int64)
        # Rows that repeat an id count their places from the first of them.
        self.base = self.starts[np.searchsorted(self.ids, self.ids)]
        self.raw = b"".join(texts)
        self.data = np.frombuffer(self.raw, np.uint8)
        self._sample()

    def _sample(self) -> None:
        """Window runs: samples ``at`` own windows ``first`` .. ``last``."""
        none = np.zeros(0, np.int64)
        self.at = self.first = self.last = self.owner = none
        self.seed = np.zeros(0, np.uint64)
        long = np.flatnonzero(self.sizes >= self.length)
        if not len(long):
            return
        at, first = [], []
        windows = len(self.data) - self.length + 1
        for begin in range(0, windows, PIECE):
            end = min(windows, begin + PIECE)
            own = samples(self.data[begin : end + self.length - 1], self.length)
            new = np.flatnonzero(own[1:] != own[:-1]) + 1
            new = np.concatenate(([0], new))
            at.append(own[new] + begin)
            first.append(new + begin)
        at, first = np.concatenate(at), np.concatenate(first)
        # Windows of each document; runs are cut where documents begin.
        low, high = self.starts[long], self.starts[long] + self.sizes[long] - self.length
        inside = np.searchsorted(first, low, side="right") - 1
        at = np.concatenate((at, at[inside]))
        first = np.concatenate((first, low))
        order = np.lexsort((np.arange(len(first)), first))
        at, first = at[order], first[order]
        doc = np.searchsorted(low, first, side="right") - 1
        keep = (doc >= 0) & (first <= high[np.maximum(doc, 0)])
        # Of two runs with one beginning, or one sample, the first stands.
        at, first, doc = at[keep], first[keep], doc[keep]
        new = np.concatenate(([True], (at[1:] != at[:-1]) | (doc[1:] != doc[:-1])))
        at, first, doc = at[new], first[new], doc[new]
        following = np.concatenate((first[1:], [np.iinfo(np.int64).max])) - 1
        self.at, self.first, self.owner = at, first, long[doc]
        self.last = np.minimum(following, high[doc])
        words = np.lib.stride_tricks.as_strided(
            self.data, (len(self.data) - SEED + 1, SEED), (1, 1), writeable=False
        )[at]
        self.seed = mixed(np.ascontiguousarray(words))

    def contexts(self, rows: np.ndarray) -> np.ndarray:
        """For samples: left bytes (nearest first), then bytes to the right."""
        left = self.length - SEED
        width = left + self.length
        at, own = self.at[rows], self.owner[rows]
        begin, end = self.starts[own], self.starts[own] + self.sizes[own]
        offsets = np.concatenate((-1 - np.arange(left), np.arange(self.length)))
        out = np.empty((len(rows), width), np.uint8)
        for s in range(0, len(rows), 1 << 15):
            part = slice(s, s + (1 << 15))
            where = at[part, None] + offsets[None, :]
            inside = (where >= begin[part, None]) & (where < end[part, None])
            got = self.data[np.where(inside, where, 0)]
            out[part] = np.where(inside, got, OUTSIDE)
        return out


def as_keys(rows: np.ndarray) -> np.ndarray:
    """Byte rows as big-endian 64-bit columns, for sorting."""
    n, width = rows.shape
    padded = np.zeros((n, -(-width // 8) * 8), np.uint8)
    padded[:, :width] = rows
    return padded.view(">u8").astype(np.uint64)


def common(rows: np.ndarray) -> np.ndarray:
    """Common prefix lengths of neighbouring byte rows."""
    differ = rows[1:] != rows[:-1]
    first = differ.argmax(axis=1)
    return np.where(differ.any(axis=1), first, rows.shape[1])


def intervals(lcp: list[int], least: int):
    """Stack scan: (depth, first, last) of every common-prefix interval of at
    least ``least``; ``lcp[i]`` is what suffixes i and i + 1 share."""
    stack: list[tuple[int, int]] = []
    for i, depth in enumerate([*lcp, -1]):
        first = i
        while stack and stack[-1][0] > depth:
            top, first = stack.pop()
            if top >= least:
                yield top, first, i
        if depth >= least and (not stack or stack[-1][0] < depth):
            stack.append((depth, first))


def maximal_repeats(contexts: np.ndarray, length: int):
    """(left reach, right reach, members) of the maximal repeats of one seed.

    ``contexts``: rows as :meth:`Batch.contexts` gives them.  Members are row
    numbers.  A group is right-maximal, being an interval of the suffix array,
    and left-maximal, being an interval of the members' left contexts whose
    members differ (or end) further left.  Only repeats of at least ``length``
    bytes are listed.
    """
    left_width = length - SEED
    left, right = contexts[:, :left_width], contexts[:, left_width:]
    order = np.lexsort(as_keys(right).T[::-1])
    lcp = common(right[order]).tolist()
    for depth, first, last in intervals(lcp, SEED):
        members = order[first : last + 1]
        need = max(0, length - depth)
        if len(members) == 2:
            differ = np.flatnonzero(left[members[0]] != left[members[1]])
            reach = int(differ[0]) if len(differ) else left_width
            if reach >= need:
                yield reach, depth, members
            continue
        own = left[members]
        by_left = np.lexsort(as_keys(own).T[::-1])
        for reach, a, b in intervals(common(own[by_left]).tolist(), need):
            yield reach, depth, members[by_left[a : b + 1]]


def marks_of(
    contexts: np.ndarray, seed: np.ndarray, doc: np.ndarray, at: np.ndarray, length: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, low, high): windows at seed - high .. seed - low also start earlier.

    Rows of one seed stand together.
    """
    edges = np.flatnonzero(seed[1:] != seed[:-1]) + 1
    rows, low, high = [], [], []
    for s, e in zip([0, *edges.tolist()], [*edges.tolist(), len(seed)]):
        if e - s < 2:
            continue
        for reach, depth, members in maximal_repeats(contexts[s:e], length):
            members = members + s
            first = np.lexsort((at[members], doc[members]))[0]
            rest = np.delete(members, first)
            rows.append(rest)
            low.append(np.full(len(rest), max(0, length - depth)))
            high.append(np.full(len(rest), reach))
    if not rows:
        none = np.zeros(0, np.int64)
        return none, none, none
    return np.concatenate(rows), np.concatenate(low), np.concatenate(high)


def _ranges(total: int, size: int) -> int:
    return max(64, -(-total // size))


def _bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """The range of the hash's top bits that it belongs to."""
    return ((hashes >> np.uint64(44)) * np.uint64(buckets) >> np.uint64(20)).astype(np.int64)


def _groups(bucket: np.ndarray):
    order = np.argsort(bucket, kind="stable")
    edges = np.flatnonzero(np.diff(bucket[order])) + 1
    for own in np.split(order, edges):
        if len(own):
            yield int(bucket[own[0]]), own


def _dealt(rows: DataFrame, batches: int, parts: int) -> DataFrame:
    """(batch, n, ids, sizes, body): documents (their ids, then keys) packed and compressed by batch."""

    def run(arrow):
        import pyarrow as pa
        import zstandard

        packer = zstandard.ZstdCompressor(level=1)
        for chunk in arrow:
            ids = chunk.column(0).to_numpy(zero_copy_only=False)
            batch = chunk.column(1).to_numpy(zero_copy_only=False)
            texts = [t.encode("utf-8") for t in chunk.column(2).to_pylist()]
            keys = chunk.column(3).to_numpy(zero_copy_only=False)
            none = chunk.column(4).to_numpy(zero_copy_only=False)
            sizes = np.array([len(t) for t in texts], np.int64)
            out = [
                (
                    b,
                    len(own),
                    b"".join(x[own].astype(np.int64).tobytes() for x in (ids, keys, none)),
                    sizes[own].tobytes(),
                    packer.compress(b"".join([texts[i] for i in own])),
                )
                for b, own in _groups(batch)
            ]
            if out:
                kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*out), kinds)],
                    names=["batch", "n", "ids", "sizes", "body"],
                )

    number = F.pmod(F.xxhash64("id"), F.lit(batches)).cast("int")
    return (
        rows.select("id", number.alias("batch"), "text", "key", "none")
        .mapInArrow(run, "batch int, n int, ids binary, sizes binary, body binary")
        .repartition(parts, "batch")
    )


def _batch_of(pdf, length: int) -> Batch:
    import zstandard

    unpack, ids, keys, none, texts = zstandard.ZstdDecompressor(), [], [], [], []
    for n, own, sizes, body in pdf[["n", "ids", "sizes", "body"]].itertuples(index=False):
        ids.append(np.frombuffer(own, np.int64, n))
        keys.append(np.frombuffer(own, np.int64, n, 8 * n))
        none.append(np.frombuffer(own, np.int64, n, 16 * n))
        raw, at = unpack.decompress(body) if any(sizes) else b"", 0
        for size in np.frombuffer(sizes, np.int64, n).tolist():
            texts.append(raw[at : at + size])
            at += size
    return Batch(np.concatenate(ids), texts, length, np.concatenate(keys), np.concatenate(none))


def _columns(bodies, kinds: list[str]) -> list[np.ndarray]:
    """Packed arrays of (n, body) rows, laid end to end; 8 bytes a value."""
    parts: list[list[np.ndarray]] = [[np.zeros(0, k)] for k in kinds]
    for n, body in bodies:
        for i, k in enumerate(kinds):
            parts[i].append(np.frombuffer(body, k, n, 8 * n * i))
    return [np.concatenate(p) for p in parts]


def _body(*arrays: np.ndarray) -> bytes:
    return b"".join(np.ascontiguousarray(a).tobytes() for a in arrays)


class _Known:
    """What a batch knows of its samples once seeds have come back."""

    def __init__(self, batch: Batch, bodies, hashes: Hashes):
        self.hashes = hashes
        seeds, hot = _columns(bodies, ["u8", "u8"])
        order = np.argsort(seeds)
        seeds, hot = seeds[order], hot[order].astype(bool)
        if len(seeds) and len(batch.seed):
            place = np.minimum(np.searchsorted(seeds, batch.seed), len(seeds) - 1)
            found = seeds[place] == batch.seed
            self.cold = np.flatnonzero(found & ~hot[place])
            self.hot = np.flatnonzero(found & hot[place])
        else:
            self.cold = self.hot = np.zeros(0, np.int64)

    def context_hashes(self, batch: Batch, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        one, two = np.zeros(len(rows), np.uint64), np.zeros(len(rows), np.uint64)
        for s in range(0, len(rows), 1 << 14):
            part = slice(s, s + (1 << 14))
            one[part], two[part] = self.hashes(batch.contexts(rows[part]))
        return one, two

    def digests(self, batch: Batch):
        """(hashes of the distinct contexts, first row of each, rows' numbers)."""
        return pair_unique(*self.context_hashes(batch, self.cold))

    def windows(self, batch: Batch):
        """(first hash, second hash, window) of all windows of hot samples."""
        rows = self.hot
        n = batch.last[rows] - batch.first[rows] + 1
        window = np.repeat(batch.first[rows], n) + (
            np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        )
        one, two = np.zeros(len(window), np.uint64), np.zeros(len(window), np.uint64)
        for s in range(0, len(window), 1 << 15):
            own = window[s : s + (1 << 15), None] + np.arange(batch.length)[None, :]
            one[s : s + (1 << 15)], two[s : s + (1 << 15)] = self.hashes(batch.data[own])
        return one, two, window


def removed_runs(
    docs: DataFrame,
    length: int = 100,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep_text: bool = False,
    key_col: str | None = None,
    hash_bits: tuple[int, int] = (64, 64),
) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256[, kept][, key]) per document.

    ``kept`` (binary, with ``keep_text``): the bytes that stay, concatenated.
    Null and empty texts lose nothing.  Ids must be integers (below 2**62);
    rows that repeat an id are taken one after the other, by ``key_col`` (an
    integer, unique per row, returned as ``key``) or else by text.  Rows
    without an id come after all others, in the order of a hash of their text.
    An empty table gives an empty one.
    """
    require(docs, id_col, text_col)
    if length <= SEED:
        raise ValueError(f"length must be over {SEED}")
    spark = docs.sparkSession
    own_id, text = docs[id_col].cast("long"), text_or_empty(text_col)
    # Without an id: a place of their own beyond the ids, and no batch that holds them all.
    last = F.lit(1 << 62) + F.xxhash64(text).bitwiseAND(F.lit((1 << 61) - 1))
    rows = docs.select(
        F.coalesce(own_id, last).alias("id"),
        text.alias("text"),
        (docs[key_col].cast("long") if key_col else F.lit(0).cast("long")).alias("key"),
        own_id.isNull().cast("long").alias("none"),
    )
    hashes = Hashes((secrets.randbits(64), secrets.randbits(64)), hash_bits)
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n_batches = _ranges(total, max(BATCH_BYTES, min(BATCH_MOST, total // BATCHES)))
    buckets = _ranges(total // 4, BATCH_BYTES)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), n_batches // 8)
    dealt = _dealt(rows, n_batches, parts)
    to_bucket = "bucket int, batch int, kind int, n int, body binary"
    to_batch = "batch int, kind int, n int, body binary"
    sent_names = ["bucket", "batch", "kind", "n", "body"]
    back_names = ["batch", "kind", "n", "body"]

    def frame(out, names):
        import pandas as pd

        return pd.DataFrame(out, columns=names)

    def bodies(pdf, *kinds):
        own = pdf[pdf["kind"].isin(kinds)]
        return [*own[["n", "body"]].itertuples(index=False, name=None)]

    # Round 1: seeds.

    def send_seeds(key, pdf):
        batch = _batch_of(pdf, length)
        seeds, counts = np.unique(batch.seed, return_counts=True)
        return frame(
            [
                (b, int(key[0]), 0, len(own), _body(seeds[own]) + counts[own].clip(0, 65535).astype("u2").tobytes())
                for b, own in _groups(_bucket(seeds, buckets))
            ],
            sent_names,
        )

    def answer_seeds(pdf):
        every = _columns(bodies(pdf, 0), ["u8"])[0]
        counts = np.concatenate(
            [np.frombuffer(body, "u2", n, 8 * n) for n, body in bodies(pdf, 0)]
        ).astype(np.int64)
        batch = np.repeat(pdf["batch"].to_numpy(), pdf["n"].to_numpy())
        _, inverse = np.unique(every, return_inverse=True)
        totals = np.bincount(inverse, counts).astype(np.int64)[inverse]
        again = totals > 1
        every, batch, hot = every[again], batch[again], (totals[again] > HOT).astype(np.uint64)
        return frame(
            [(b, 0, len(own), _body(every[own], hot[own])) for b, own in _groups(batch)],
            back_names,
        )

    seeds = dealt.groupBy("batch").applyInPandas(send_seeds, to_bucket)
    known = seeds.groupBy("bucket").applyInPandas(answer_seeds, to_batch)

    # Round 2: digests of contexts (kind 0), windows of hot seeds (kind 1).

    def send_digests(key, left, right):
        if not len(left) or not len(right):
            return frame([], sent_names)
        batch = _batch_of(left, length)
        own_known = _Known(batch, bodies(right, 0), hashes)
        out = []
        if len(own_known.cold):
            one, two, first, _ = own_known.digests(batch)
            rows = own_known.cold[first]
            seed, doc = batch.seed[rows], batch.ids[batch.owner[rows]]
            at = batch.at[rows] - batch.base[batch.owner[rows]]
            for b, own in _groups(_bucket(seed, buckets)):
                out.append((b, int(key[0]), 0, len(own), _body(seed[own], one[own], two[own], doc[own], at[own])))
        if len(own_known.hot):
            one, two, window = own_known.windows(batch)
            one, two, first, _ = pair_unique(one, two)
            window = window[first]
            owner = np.searchsorted(batch.starts, window, side="right") - 1
            doc, at = batch.ids[owner], window - batch.base[owner]
            for b, own in _groups(_bucket(one, buckets)):
                out.append((b, int(key[0]), 1, len(own), _body(one[own], two[own], doc[own], at[own])))
        return frame(out, sent_names)

    def answer_digests(pdf):
        """Late contexts (kind 1), late windows (kind 2), wanted ones (kind 3)."""
        out = []
        for kind in (0, 1):
            own = pdf[pdf["kind"] == kind]
            if not len(own):
                continue
            kinds = ["u8", "u8", "u8", "i8", "i8"] if kind == 0 else ["u8", "u8", "i8", "i8"]
            *seed, one, two, doc, at = _columns(bodies(own, kind), kinds)
            seed = seed[0] if seed else one
            batch = np.repeat(own["batch"].to_numpy(), own["n"].to_numpy())
            order = np.lexsort((at, doc, two, one, seed))
            seed, one, two, batch = seed[order], one[order], two[order], batch[order]
            other_seed = np.concatenate(([True], seed[1:] != seed[:-1]))
            other = np.concatenate(([True], (one[1:] != one[:-1]) | (two[1:] != two[:-1])))
            new = other_seed | other
            late = np.flatnonzero(~new)
            for b, g in _groups(batch[late]):
                out.append((b, 1 + kind, len(g), _body(one[late[g]], two[late[g]])))
            if kind == 0:
                number = np.cumsum(other_seed) - 1
                several = np.bincount(number, new)[number] > 1
                wanted = np.flatnonzero(new & several)
                for b, g in _groups(batch[wanted]):
                    out.append((b, 3, len(g), _body(seed[wanted[g]], one[wanted[g]], two[wanted[g]])))
        return frame(out, back_names)

    digests = (
        dealt.groupBy("batch").cogroup(known.groupBy("batch")).applyInPandas(send_digests, to_bucket)
    )
    answers = digests.groupBy("bucket").applyInPandas(answer_digests, to_batch)

    # Round 3: suffixes with their contexts.

    left_width = length - SEED
    width = left_width + length

    def wanted_rows(batch, right):
        """Rows of the contexts that were asked for, and their hashes."""
        seed, one, two = _columns(bodies(right, 3), ["u8", "u8", "u8"])
        rows = np.flatnonzero(np.isin(batch.seed, seed))
        own_one, own_two, first, _ = pair_unique(*_Known(batch, [], hashes).context_hashes(batch, rows))
        hit = pair_place(*pair_unique(one, two)[:2], own_one, own_two) >= 0
        return rows[first[hit]], own_one[hit], own_two[hit]

    def send_contexts(key, left, right):
        if not len(left) or not (right["kind"] == 3).any():
            return frame([], sent_names)
        batch = _batch_of(left, length)
        rows, one, two = wanted_rows(batch, right)
        seed, doc = batch.seed[rows], batch.ids[batch.owner[rows]]
        at = batch.at[rows] - batch.base[batch.owner[rows]]
        contexts = batch.contexts(rows)
        return frame(
            [
                (b, int(key[0]), 0, len(own), _body(seed[own], one[own], two[own], doc[own], at[own], contexts[own]))
                for b, own in _groups(_bucket(seed, buckets))
            ],
            sent_names,
        )

    def answer_contexts(pdf):
        """Marks (kind 4): hashes, low, high."""
        seed, one, two, doc, at = _columns(bodies(pdf, 0), ["u8", "u8", "u8", "i8", "i8"])
        batch = np.repeat(pdf["batch"].to_numpy(), pdf["n"].to_numpy())
        contexts = np.concatenate(
            [
                np.frombuffer(body, np.uint8, n * width, 40 * n).reshape(n, width)
                for n, body in bodies(pdf, 0)
            ]
        )
        order = np.lexsort((at, doc, seed))
        seed, one, two, doc, at, batch = (x[order] for x in (seed, one, two, doc, at, batch))
        row, low, high = marks_of(contexts[order], seed, doc, at, length)
        return frame(
            [
                (b, 4, len(g), _body(one[row[g]], two[row[g]], low[g], high[g]))
                for b, g in _groups(batch[row])
            ],
            back_names,
        )

    suffixes = (
        dealt.groupBy("batch")
        .cogroup(answers.groupBy("batch"))
        .applyInPandas(send_contexts, to_bucket)
    )
    marks = suffixes.groupBy("bucket").applyInPandas(answer_contexts, to_batch)

    # Round 4: removed runs.

    names = ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * keep_text + ["key"] * bool(key_col)
    schema = "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (
        ", kept binary" * keep_text + ", key long" * bool(key_col)
    )

    def finish(key, left, right):
        if not len(left):
            return frame([], names)
        batch = _batch_of(left, length)
        step = np.zeros(len(batch.data) + 1, np.int32)

        def remove(first, last):
            """Windows first .. last (places in the batch) go."""
            np.add.at(step, first, 1)
            np.add.at(step, last + length, -1)

        own_known = _Known(batch, bodies(right, 0), hashes)
        rows = own_known.cold
        if len(rows):
            one, two, first, inverse = own_known.digests(batch)
            # Not the earliest of the batch: all windows of the sample go.
            gone = first[inverse] != np.arange(len(rows))
            late = np.zeros(len(one), bool)
            late[pair_place(one, two, *_columns(bodies(right, 1), ["u8", "u8"]))] = True
            gone |= late[inverse]
            remove(batch.first[rows[gone]], batch.last[rows[gone]])
            mark_one, mark_two, low, high = _columns(bodies(right, 4), ["u8", "u8", "i8", "i8"])
            if len(low):
                row = rows[first[pair_place(one, two, mark_one, mark_two)]]
                begin = np.maximum(batch.first[row], batch.at[row] - high)
                end = np.minimum(batch.last[row], batch.at[row] - low)
                good = begin <= end
                remove(begin[good], end[good])
        if len(own_known.hot):
            one, two, window = own_known.windows(batch)
            one, two, first, inverse = pair_unique(one, two)
            gone = first[inverse] != np.arange(len(inverse))
            late = np.zeros(len(one), bool)
            late[pair_place(one, two, *_columns(bodies(right, 2), ["u8", "u8"]))] = True
            gone |= late[inverse]
            remove(window[gone], window[gone])
        covered = np.cumsum(step[:-1], dtype=np.int32) > 0
        out = []
        for i, (start, size) in enumerate(zip(batch.starts.tolist(), batch.sizes.tolist())):
            own = covered[start : start + size]
            gone = int(own.sum())
            kept, spans = batch.raw[start : start + size], 0
            if gone:
                spans = int(own[0]) + int((own[1:] & ~own[:-1]).sum())
                kept = batch.data[start : start + size][~own].tobytes()
            row = [None if batch.none[i] else int(batch.ids[i]), size, gone, spans, hashlib.sha256(kept).hexdigest()]
            out.append([*row, *[kept] * keep_text, *[int(batch.keys[i])] * bool(key_col)])
        done = frame(out, names)
        return done.astype({"id": "Int64"})

    late = answers.filter(F.col("kind") < 3)
    back = known.unionByName(late).unionByName(marks)
    return dealt.groupBy("batch").cogroup(back.groupBy("batch")).applyInPandas(finish, schema)
