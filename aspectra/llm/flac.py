"""FLAC columns: bytes as 8-bit mono audio and back (operator 3).

The coder works on many frames at once.  Frames of a batch, whatever file they
belong to, step through their residuals together: one numpy step decodes the
n-th Rice code of every frame.  Each file carries a seek table with every
frame, which gives the decoder its starting points and readers their sample
offsets; files without one are walked frame by frame.

Checked on reading: the CRC-8 of every frame header, the CRC-16 of every
frame, the sample count and the MD5 of the samples.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import require, spread, text_or_empty

#: Samples in a frame; the last frame of a file may be shorter.
BLOCK = 1152
#: Sample rate written to files.
RATE = 8000
#: Payload bytes coded at a time in a worker.
BATCH_BYTES = 2 << 20
#: Order of the linear predictors tried beside the fixed ones, and their bits.
LPC_ORDER, LPC_BITS = 4, 12
#: Predictor coefficients of the format's fixed orders (fixed values).
FIXED = ((), (1,), (2, -1), (3, -3, 1), (4, -6, 4, -1))
#: Block sizes that have a code of their own in frame headers (fixed values).
SIZE_CODES = {192: 1, 576: 2, 1152: 3, 2304: 4, 4608: 5} | {256 << i: 8 + i for i in range(8)}


class FlacError(ValueError):
    """Media bytes that break the format or fail a checksum."""


@lru_cache(maxsize=2)
def crc_table(bits: int) -> np.ndarray:
    poly, top, mask = {8: (0x07, 0x80, 0xFF), 16: (0x8005, 0x8000, 0xFFFF)}[bits]
    out = np.zeros(256, np.uint32)
    for byte in range(256):
        value = byte << (bits - 8)
        for _ in range(8):
            value = (value << 1) ^ poly if value & top else value << 1
        out[byte] = value & mask
    return out


def crc8(data: bytes) -> int:
    table, value = crc_table(8), 0
    for b in data:
        value = int(table[value ^ b])
    return value


def crc16(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """CRC-16 of many byte ranges, stepping through them together."""
    table = crc_table(16)
    order = np.argsort(-sizes, kind="stable")
    starts, sizes = starts[order], sizes[order]
    value = np.zeros(len(starts), np.uint32)
    ends = np.searchsorted(-sizes, -np.arange(1, (sizes.max(initial=0)) + 1), side="right")
    for i, n in enumerate(ends.tolist()):
        own = value[:n]
        value[:n] = ((own << 8) & 0xFFFF) ^ table[(own >> 8) ^ data[starts[:n] + i]]
    out = np.empty_like(value)
    out[order] = value
    return out


@lru_cache(maxsize=4096)
def frame_header(number: int, size: int) -> bytes:
    """A frame header with its CRC-8: fixed block size, mono, 8 bits."""
    code = SIZE_CODES.get(size, 6 if size <= 256 else 7)
    head = bytes([0xFF, 0xF8, code << 4, 0b0000_001_0]) + coded_number(number)
    if code == 6:
        head += bytes([size - 1])
    elif code == 7:
        head += struct.pack(">H", size - 1)
    return head + bytes([crc8(head)])


def coded_number(n: int) -> bytes:
    """The format's UTF-8-like code of a frame or sample number."""
    if n < 0x80:
        return bytes([n])
    tail = []
    limit = 0x20
    while True:
        tail.insert(0, 0x80 | (n & 0x3F))
        n >>= 6
        if n < limit:
            break
        limit >>= 1
    lead = (0xFF << (7 - len(tail))) & 0xFF
    return bytes([lead | n, *tail])


# -- encoding ---------------------------------------------------------------


def _levinson(x: np.ndarray, order: int) -> np.ndarray:
    """Linear predictors of each row of ``x`` by Levinson's recursion."""
    f = x.astype(np.float32)
    n = f.shape[1]
    auto = np.stack(
        [np.einsum("ij,ij->i", f[:, : n - k], f[:, k:]) for k in range(order + 1)], 1
    ).astype(np.float64)
    error = auto[:, 0] * (1 + 1e-9) + 1e-9
    a = np.zeros((len(f), order))
    for i in range(order):
        acc = auto[:, i + 1] - (a[:, :i] * auto[:, i:0:-1]).sum(axis=1)
        k = acc / error
        new = a.copy()
        new[:, i] = k
        new[:, :i] = a[:, :i] - k[:, None] * a[:, :i][:, ::-1]
        a = new
        error = np.maximum(error * (1 - k * k), 1e-9)
    return a


def _quantized(a: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients as integers of ``bits`` bits and their shifts (0 to 15)."""
    most = np.abs(a).max(axis=1)
    shift = np.clip(bits - 1 - np.ceil(np.log2(np.maximum(most, 1e-9) + 1e-12)).astype(int) - 1, 0, 15)
    top = 2 ** (bits - 1) - 1
    q = np.clip(np.rint(a * (2.0**shift)[:, None]), -top - 1, top).astype(np.int32)
    return q, shift.astype(np.int32)


def _residual(x: np.ndarray, coefs: np.ndarray, shift: np.ndarray) -> np.ndarray:
    order = coefs.shape[1]
    n = x.shape[1]
    if not order:
        return x.copy()
    # 8-bit samples, at most 32 coefficients of 15 bits: 32 bits hold the sums.
    predicted = coefs[:, 0:1] * x[:, order - 1 : n - 1]
    for j in range(1, order):
        predicted += coefs[:, j : j + 1] * x[:, order - 1 - j : n - 1 - j]
    predicted >>= shift[:, None]
    return np.subtract(x[:, order:], predicted, out=predicted)


def _zigzag(r: np.ndarray) -> np.ndarray:
    return (r << 1) ^ (r >> 31)


def _rice(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A Rice parameter of each row, the better of two near the best, and its bits."""
    n = z.shape[1]
    mean = z.sum(axis=1, dtype=np.int64) / n
    low = np.clip(np.floor(np.log2(np.maximum(mean * 0.6931, 1))), 0, 12).astype(z.dtype)
    best = np.full(len(z), np.iinfo(np.int64).max)
    param = np.zeros(len(z), np.int64)
    for k in (low, low + 1):
        bits = (z >> k[:, None]).sum(axis=1, dtype=np.int64) + n * (1 + k.astype(np.int64))
        better = bits < best
        best[better], param[better] = bits[better], k[better]
    return param, best


class _Bits:
    """Rows of bits of differing lengths, byte-aligned, written by column."""

    def __init__(self, lengths: np.ndarray):
        self.sizes = -(-lengths // 8)
        self.starts = np.concatenate(([0], np.cumsum(self.sizes)))[:-1]
        self.bits = np.zeros(int(self.sizes.sum()) * 8, np.uint8)

    def put(self, at: np.ndarray, values: np.ndarray, width: int) -> None:
        for j in range(width):
            self.bits[at + j] = (values >> (width - 1 - j)) & 1


def _encode_class(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Subframes of equally long frames: their bytes, starts and sizes."""
    count, n = x.shape
    none = np.zeros(count, np.int32)
    tried = [
        (o, np.tile(np.array(FIXED[o], np.int32), (count, 1)), none, False)
        for o in (0, 1)
        if o < n
    ]
    if n > 4 * LPC_ORDER:
        q, shift = _quantized(_levinson(x, LPC_ORDER), LPC_BITS)
        tried.append((LPC_ORDER, q, shift, True))
    constant = (x == x[:, :1]).all(axis=1)
    cost = np.full(count, 8 + 8 * n)  # verbatim
    choice = np.full(count, -1)
    residuals, params = [], []
    for i, (order, coefs, shift, lpc) in enumerate(tried):
        z = _zigzag(_residual(x, coefs, shift))
        param, bits = _rice(z)
        bits = bits + 8 + 8 * order + 10 + (9 + LPC_BITS * order) * lpc
        better = bits < cost
        cost[better], choice[better] = bits[better], i
        residuals.append(z)
        params.append(param)
    choice[constant], cost[constant] = -2, 16
    out = _Bits(cost)
    base = out.starts * 8
    for i, (order, coefs, shift, lpc) in enumerate(tried):
        for k in np.unique(params[i][choice == i]).tolist():
            rows = np.flatnonzero((choice == i) & (params[i] == k))
            at = base[rows].copy()
            kind = (0b100000 | (order - 1)) if lpc else (0b001000 | order)
            out.put(at, np.full(len(rows), kind << 1), 8)
            at += 8
            for j in range(order):
                out.put(at, x[rows, j] & 0xFF, 8)
                at += 8
            if lpc:
                out.put(at, np.full(len(rows), LPC_BITS - 1), 4)
                out.put(at + 4, shift[rows], 5)
                at += 9
                for j in range(order):
                    out.put(at, coefs[rows, j] & (2**LPC_BITS - 1), LPC_BITS)
                    at += LPC_BITS
            out.put(at, np.full(len(rows), k), 10)  # method 0, partition order 0
            at += 10
            z = residuals[i][rows]
            stop = np.cumsum((z >> k) + (1 + k), axis=1, dtype=np.int64)
            stop += (at - k - 1)[:, None]
            stop = stop.ravel()
            out.bits[stop] = 1
            if k:
                out.put(stop + 1, (z & ((1 << k) - 1)).astype(np.uint8 if k <= 8 else np.int32).ravel(), k)
    rows = np.flatnonzero(choice == -1)
    if len(rows):
        out.put(base[rows], np.full(len(rows), 0b000001 << 1), 8)
        at = base[rows][:, None] + 8 + 8 * np.arange(n)[None, :]
        out.put(at.ravel(), x[rows].ravel() & 0xFF, 8)
    rows = np.flatnonzero(choice == -2)
    if len(rows):
        out.put(base[rows], np.zeros(len(rows), np.int64), 8)
        out.put(base[rows] + 8, x[rows, 0] & 0xFF, 8)
    return np.packbits(out.bits), out.starts, out.sizes


def encode_many(payloads: list[bytes], block: int = BLOCK) -> list[bytes]:
    """FLAC files of non-empty payloads, each byte one 8-bit sample."""
    data = np.frombuffer(b"".join(payloads), np.uint8).astype(np.int32) - 128
    sizes = [len(p) for p in payloads]
    if min(sizes, default=1) < 1:
        raise ValueError("a file needs at least one sample")
    frames = []  # (file, number, start, length)
    at = 0
    for i, size in enumerate(sizes):
        for number, first in enumerate(range(0, size, block)):
            frames.append((i, number, at + first, min(block, size - first)))
        at += size
    lengths = np.array([f[3] for f in frames])
    starts = np.array([f[2] for f in frames])
    bodies: list[bytes] = [b""] * len(frames)
    for n in np.unique(lengths).tolist():
        rows = np.flatnonzero(lengths == n)
        packed, begin, size = _encode_class(data[starts[rows][:, None] + np.arange(n)])
        raw = packed.tobytes()
        for r, b, s in zip(rows.tolist(), begin.tolist(), size.tolist()):
            bodies[r] = raw[b : b + s]
    whole = [frame_header(f[1], f[3]) + b for f, b in zip(frames, bodies)]
    size = np.array([len(w) for w in whole])
    ends = np.cumsum(size)
    checks = crc16(np.frombuffer(b"".join(whole), np.uint8), ends - size, size).tolist()
    by_file: list[list[tuple[int, bytes]]] = [[] for _ in payloads]
    for f, w, c in zip(frames, whole, checks):
        by_file[f[0]].append((f[3], w + struct.pack(">H", c)))
    return [_file(p, own, block) for p, own in zip(payloads, by_file)]


def _file(payload: bytes, frames: list[tuple[int, bytes]], block: int) -> bytes:
    samples = (np.frombuffer(payload, np.uint8) ^ 0x80).tobytes()
    sizes = [len(f) for _, f in frames]
    fields = RATE << 44 | 0 << 41 | 7 << 36 | len(payload)  # rate, mono, 8 bits, samples
    info = (
        struct.pack(">HH", max(16, block), max(16, block))
        + min(sizes).to_bytes(3, "big")
        + max(sizes).to_bytes(3, "big")
        + fields.to_bytes(8, "big")
        + hashlib.md5(samples).digest()
    )
    points, sample, offset = [], 0, 0
    for n, f in frames:
        points.append(struct.pack(">QQH", sample, offset, n))
        sample += n
        offset += len(f)
    table = b"".join(points)
    return b"".join(
        [
            b"fLaC\x00",
            len(info).to_bytes(3, "big"),
            info,
            b"\x83",
            len(table).to_bytes(3, "big"),
            table,
            *(f for _, f in frames),
        ]
    )


# -- decoding ---------------------------------------------------------------


class Stream:
    """The metadata of one file and where its frames begin."""

    def __init__(self, data: bytes):
        if data[:4] != b"fLaC":
            raise FlacError("no FLAC marker")
        at, last, self.points, seen = 4, False, [], False
        while not last:
            if at + 4 > len(data):
                raise FlacError("metadata is cut off")
            last, kind = data[at] >> 7, data[at] & 0x7F
            size = int.from_bytes(data[at + 1 : at + 4], "big")
            body = data[at + 4 : at + 4 + size]
            at += 4 + size
            if kind == 0:
                seen = True
                fields = int.from_bytes(body[10:18], "big")
                self.rate = fields >> 44
                self.channels = (fields >> 41 & 7) + 1
                self.bits = (fields >> 36 & 31) + 1
                self.samples = fields & (1 << 36) - 1
                self.md5 = body[18:34]
            elif kind == 3:
                self.points = [
                    p for p in struct.iter_unpack(">QQH", body) if p[0] != 2**64 - 1
                ]
        if not seen:
            raise FlacError("no stream information")
        if self.channels != 1 or self.bits != 8:
            raise FlacError("only mono streams of 8 bits are read")
        self.start, self.size = at, len(data)

    def complete(self) -> bool:
        """Whether the seek table lists every frame."""
        sample = 0
        for first, _, n in self.points:
            if first != sample:
                return False
            sample += n
        return sample == self.samples and bool(self.points)


def _header(data: bytes, at: int) -> tuple[int, int, int]:
    """(block size, frame number, header size) of the frame at ``at``."""
    head = data[at : at + 16]
    if len(head) < 6 or head[0] != 0xFF or head[1] & 0xFE != 0xF8:
        raise FlacError(f"no frame at byte {at}")
    code, rate = head[2] >> 4, head[2] & 15
    if head[3] >> 4 or (head[3] >> 1 & 7) not in (0, 1):
        raise FlacError("only mono frames of 8 bits are read")
    lead, extra = head[4], 0
    if lead & 0x80:
        while lead & (0x80 >> extra):
            extra += 1
        number = lead & (0x7F >> extra)
        for b in head[5 : 4 + extra]:
            number = number << 6 | b & 0x3F
        at_size = 4 + extra
    else:
        number, at_size = lead, 5
    n = next((s for s, c in SIZE_CODES.items() if c == code), 0)
    if code == 6:
        n, at_size = head[at_size] + 1, at_size + 1
    elif code == 7:
        n, at_size = int.from_bytes(head[at_size : at_size + 2], "big") + 1, at_size + 2
    at_size += {12: 1, 13: 2, 14: 2}.get(rate, 0)
    if crc8(head[:at_size]) != head[at_size]:
        raise FlacError(f"header checksum of the frame at byte {at}")
    return n, number, at_size + 1


class _Reader:
    """Bit positions of many frames over one buffer."""

    def __init__(self, data: bytes):
        padded = np.frombuffer(data + bytes(16), np.uint8)
        self.words = np.lib.stride_tricks.as_strided(
            padded[: len(data) + 8].view(np.uint8), (len(data) + 8, 8), (1, 1)
        )
        self.big = np.ndarray((len(data) + 8,), ">u8", padded, strides=(1,))

    def window(self, at: np.ndarray) -> np.ndarray:
        """At least 57 bits from each position, at the top of 64."""
        return self.big[at >> 3].astype(np.uint64) << (at & 7).astype(np.uint64)

    def take(self, at: np.ndarray, width: int) -> np.ndarray:
        return (self.window(at) >> np.uint64(64 - width)).astype(np.int64) if width else np.zeros(len(at), np.int64)

    def signed(self, at: np.ndarray, width: int) -> np.ndarray:
        v = self.take(at, width)
        return v - ((v >> (width - 1)) << width)


def decode_frames(data: bytes, starts: list[int]) -> tuple[list[np.ndarray], list[int]]:
    """Samples and ends of the frames that begin at ``starts`` of ``data``.

    All frames of one block size step through their samples together.
    """
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(starts)
    ends = [0] * len(starts)
    reader = _Reader(data)
    heads = [_header(data, s) for s in starts]
    sizes = np.array([h[0] for h in heads])
    body = np.array([s + h[2] for s, h in zip(starts, heads)], np.int64)
    raw = np.frombuffer(data, np.uint8)
    for n in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == n)
        samples, at = _decode_class(reader, body[rows] * 8, n)
        end = -(-at // 8)
        for i, r in enumerate(rows.tolist()):
            out[r], ends[r] = samples[i], int(end[i]) + 2
    first, last = np.array(starts, np.int64), np.array(ends, np.int64) - 2
    if len(first):
        if last.max() + 2 > len(raw):
            raise FlacError("a frame is cut off")
        found = crc16(raw, first, last - first)
        if (found != (raw[last].astype(np.uint32) << 8 | raw[last + 1])).any():
            raise FlacError("frame checksum")
    return out, ends


def _decode_class(reader: _Reader, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    kind = reader.take(at, 8)
    if (kind & 0x81).any():
        raise FlacError("reserved or wasted bits are not read")
    kind >>= 1
    at = at + 8
    samples = np.zeros((len(at), n), np.int64)
    done = np.zeros(len(at), bool)
    rows = np.flatnonzero(kind == 0)
    if len(rows):
        samples[rows] = reader.signed(at[rows], 8)[:, None]
        at[rows] += 8
        done[rows] = True
    rows = np.flatnonzero(kind == 1)
    if len(rows):
        where = at[rows][:, None] + 8 * np.arange(n)
        samples[rows] = reader.signed(where.ravel(), 8).reshape(len(rows), n)
        at[rows] += 8 * n
        done[rows] = True
    for k in np.unique(kind[~done]).tolist():
        rows = np.flatnonzero(kind == k)
        if 8 <= k <= 12:
            order = k - 8
        elif k >= 32:
            order = k - 31
        else:
            raise FlacError(f"reserved subframe type {k}")
        if order > n:
            raise FlacError("order above the block size")
        pos, own = at[rows], np.zeros((n, len(rows)), np.int64)
        for j in range(order):
            own[j] = reader.signed(pos, 8)
            pos = pos + 8
        if k >= 32:
            width = reader.take(pos, 4) + 1
            if (width == 16).any():
                raise FlacError("coefficient precision")
            shift = reader.signed(pos + 4, 5)
            pos = pos + 9
            coefs = np.zeros((order, len(rows)), np.int64)
            for w in np.unique(width).tolist():
                some = np.flatnonzero(width == w)
                for j in range(order):
                    coefs[j, some] = reader.signed(pos[some] + j * w, w)
            pos = pos + order * width
            if (shift < 0).any():
                raise FlacError("negative shift")
        else:
            coefs = np.tile(np.array(FIXED[order], np.int64)[:, None], (1, len(rows)))
            shift = np.zeros(len(rows), np.int64)
        pos = _residuals(reader, pos, own, order, n)
        # Undo the prediction, sample by sample for all frames together.
        if order == 1 and k < 32:
            np.cumsum(own, axis=0, out=own)
        elif order:
            flipped = coefs[::-1]
            for i in range(order, n):
                own[i] += (flipped * own[i - order : i]).sum(axis=0) >> shift
        samples[rows] = own.T
        at[rows] = pos
    return samples, at


def _residuals(reader: _Reader, pos: np.ndarray, out: np.ndarray, order: int, n: int) -> np.ndarray:
    """Rice-coded residuals into ``out[order:]``; returns the end positions."""
    method = reader.take(pos, 2)
    if (method > 1).any():
        raise FlacError("reserved residual coding")
    depth = reader.take(pos + 2, 4)
    pos = pos + 6
    part = n >> depth
    wide = method == 1
    param = np.zeros(len(pos), np.int64)
    escape = np.zeros(len(pos), bool)
    simple = not depth.any() and not wide.any()
    for i in range(order, n):
        if i == order or not simple:
            due = np.full(len(pos), True) if i == order else (i % part) == 0
            if due.any():
                code = np.where(wide, reader.take(pos, 5), reader.take(pos, 4))
                step = np.where(wide, 5, 4)
                escaped = code == np.where(wide, 31, 15)
                raw_width = reader.take(pos + step, 5)
                param = np.where(due, np.where(escaped, raw_width, code), param)
                escape = np.where(due, escaped, escape)
                pos = pos + np.where(due, step + 5 * escaped, 0)
        window = reader.window(pos)
        top = (window >> np.uint64(32)).astype(np.float64)
        zeros = 32 - np.frexp(top)[1]
        if (long := (zeros >= 32) & ~escape).any():
            zeros = zeros.astype(np.int64)
            for r in np.flatnonzero(long):
                zeros[r] = _long_unary(reader, int(pos[r]))
            start = pos + zeros + 1
            window = reader.window(start)
        else:
            start = pos + zeros + 1
            window = window << (zeros + 1).astype(np.uint64)
        low = ((window >> np.uint64(1)) >> (63 - param).astype(np.uint64)).astype(np.int64)
        z = (zeros.astype(np.int64) << param) | low
        value = (z >> 1) ^ -(z & 1)
        after = start + param
        if escape.any():
            for r in np.flatnonzero(escape):
                w = int(param[r])
                value[r] = reader.signed(pos[r : r + 1], w)[0] if w else 0
                after[r] = pos[r] + w
        out[i] = value
        pos = after
    return pos


def _long_unary(reader: _Reader, at: int) -> int:
    zeros = 0
    while True:
        if at // 8 >= len(reader.big):
            raise FlacError("a frame is cut off")
        top = int(reader.window(np.array([at]))[0]) >> 32
        if top:
            return zeros + 32 - top.bit_length()
        zeros += 32
        at += 32


def decode_many(files: list[bytes]) -> list[bytes]:
    """The payloads of FLAC files, with every checksum verified."""
    joined = b"".join(files)
    base, starts, owner, streams = 0, [], [], []
    slow: dict[int, bytes] = {}
    for i, data in enumerate(files):
        stream = Stream(data)
        streams.append(stream)
        if stream.complete():
            starts += [base + stream.start + offset for _, offset, _ in stream.points]
            owner += [i] * len(stream.points)
        else:
            slow[i] = _walk(data, stream)
        base += len(data)
    samples, _ = decode_frames(joined, starts)
    parts: list[list[bytes]] = [[] for _ in files]
    for i, s in zip(owner, samples):
        if s.min(initial=0) < -128 or s.max(initial=0) > 127:
            raise FlacError("sample out of range")
        parts[i].append(s.astype(np.int8).tobytes())
    out = []
    for i, stream in enumerate(streams):
        raw = slow.get(i) or b"".join(parts[i])
        if len(raw) != stream.samples:
            raise FlacError("sample count")
        if stream.md5 != bytes(16) and hashlib.md5(raw).digest() != stream.md5:
            raise FlacError("sample digest")
        out.append((np.frombuffer(raw, np.uint8) ^ 0x80).tobytes())
    return out


def _walk(data: bytes, stream: Stream) -> bytes:
    """Signed samples of a file without a full seek table."""
    at, out = stream.start, []
    while at < len(data):
        samples, ends = decode_frames(data, [at])
        out.append(samples[0].astype(np.int8).tobytes())
        at = ends[0]
    return b"".join(out)


def read_samples(data: bytes, first: int, count: int) -> bytes:
    """Payload bytes first .. first + count - 1: only their frames are decoded."""
    stream = Stream(data)
    if not stream.complete():
        return decode_many([data])[0][first : first + count]
    own = [p for p in stream.points if p[0] < first + count and p[0] + p[2] > first]
    samples, _ = decode_frames(data, [stream.start + p[1] for p in own])
    if not samples:
        return b""
    raw = (np.concatenate(samples) + 128).astype(np.uint8).tobytes()
    return raw[first - own[0][0] : first - own[0][0] + count]


# -- columns ----------------------------------------------------------------


def _runs(sizes: list[int]):
    """Index ranges of about BATCH_BYTES."""
    first, total = 0, 0
    for i, size in enumerate(sizes):
        total += size
        if total >= BATCH_BYTES:
            yield first, i + 1
            first, total = i + 1, 0
    if first < len(sizes):
        yield first, len(sizes)


def padded(text: str, unit: int = 192) -> bytes:
    """UTF-8 bytes with spaces appended up to a positive multiple of ``unit``."""
    raw = text.encode("utf-8")
    return raw + b" " * (max(unit, -(-len(raw) // unit) * unit) - len(raw))


def encode_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media): whole texts as FLAC files.

    Null and empty texts become one frame of 192 spaces; repeated rows stay;
    other columns are dropped.
    """
    require(docs, id_col, text_col)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in _runs([len(t) for t in texts]):
                own = [padded(t) for t in texts[a:b]]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a),
                        pa.array([len(t.encode("utf-8")) for t in texts[a:b]], pa.int64()),
                        pa.array(encode_many(own), pa.binary()),
                    ],
                    names=["id", "n_bytes", "media"],
                )

    picked = spread(docs.select(docs[id_col].alias("id"), text_or_empty(text_col).alias("text")))
    return picked.mapInArrow(run, f"id {kind}, n_bytes long, media binary")


#: Columns of PCM blocks after the id.
_PCM = "n_bytes long, media_bytes long, media_sha256 string, block int, first_sample long, pcm binary"


def pcm_blocks(media: DataFrame) -> DataFrame:
    """(id, n_bytes, media_bytes, media_sha256, block, first_sample, pcm) of (id[, n_bytes], media).

    The decoded frames: ``pcm`` are unsigned 8-bit samples; ``first_sample``
    is the seekable offset.  A file's blocks come one after the other, from
    block 0.  Null media give no rows; broken media raise FlacError.
    """
    require(media, "id", "media")
    kind = media.schema["id"].dataType.simpleString()
    n_bytes = F.col("n_bytes") if "n_bytes" in media.columns else F.lit(None)

    def run(batches):
        import pyarrow as pa

        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.binary())
        names = ["id", *(c.split()[0] for c in _PCM.split(", "))]
        for batch in batches:
            there = [i for i, f in enumerate(batch.column(2).to_pylist()) if f is not None]
            files = [batch.column(2)[i].as_py() for i in there]
            sizes = batch.column(1).to_pylist()
            for a, b in _runs([len(f) for f in files]):
                owner, rows = [], []
                for i, data, raw in zip(there[a:b], files[a:b], decode_many(files[a:b])):
                    points = Stream(data).points
                    if not points:
                        points = [(s, 0, min(BLOCK, len(raw) - s)) for s in range(0, len(raw), BLOCK)]
                    known = (sizes[i], len(data), hashlib.sha256(data).hexdigest())
                    rows += [(*known, k, p[0], raw[p[0] : p[0] + p[2]]) for k, p in enumerate(points)]
                    owner += [i] * len(points)
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array(owner)), *(pa.array(c, t) for c, t in zip(zip(*rows), kinds))],
                        names=names,
                    )

    return media.select("id", n_bytes.cast("long").alias("n_bytes"), "media").mapInArrow(run, f"id {kind}, {_PCM}")


class Features:
    """Digests, peak, energy and zero crossings of samples that come block after block."""

    def __init__(self):
        self.sha, self.size, self.tail = hashlib.sha256(), 0, b""
        self.peak = self.energy = self.crossings = 0
        self.negative: bool | None = None

    def add(self, pcm: bytes) -> None:
        self.sha.update(pcm)
        self.size += len(pcm)
        self.tail = (self.tail + pcm)[-16:]
        x = np.frombuffer(pcm, np.uint8).astype(np.int64) - 128
        if not len(x):
            return
        below = x < 0
        self.peak = max(self.peak, int(np.abs(x).max()))
        self.energy += int((x * x).sum())
        self.crossings += int((below[1:] != below[:-1]).sum()) + (self.negative not in (None, bool(below[0])))
        self.negative = bool(below[-1])

    def row(self) -> tuple[int, str, int, str]:
        text = f"peak={self.peak};energy={self.energy};crossings={self.crossings}"
        return self.size, self.sha.hexdigest(), zlib.crc32(self.tail), text


def media_features(media: DataFrame) -> DataFrame:
    """Reads (id, n_bytes, media) back as PCM blocks and computes digests and features.

    Offsets are checked: a block that does not begin where the one before it
    ended raises FlacError.
    """
    require(media, "id", "n_bytes", "media")
    kind = media.schema["id"].dataType.simpleString()
    schema = (
        f"id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long,"
        " media_bytes long, media_sha256 string, feature string"
    )

    def run(batches):
        import pyarrow as pa

        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        names = ["id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
        now = known = None

        def done():
            size, sha, crc, text = now.row()
            own = (known[1], size, sha, crc, known[2], known[3], text)
            return [known[0], *(pa.array([v], t) for v, t in zip(own, kinds))]

        def joined(rows):
            return pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in zip(*rows)], names=names)

        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(1, 7)]
            rows = []
            for i, (n_bytes, media_bytes, sha, block, first, pcm) in enumerate(zip(*columns)):
                if block == 0:
                    if now is not None:
                        rows.append(done())
                    now, known = Features(), (batch.column(0).slice(i, 1), n_bytes, media_bytes, sha)
                if now.size != first:
                    raise FlacError("blocks do not follow one another")
                now.add(pcm)
            if rows:
                yield joined(rows)
        if now is not None:
            yield joined([done()])

    return pcm_blocks(media).mapInArrow(run, schema)
