"""Exact top-k by inner product with block-at-a-time pruning (operator 1).

Vectors are cut into *blocks* of consecutive ids, written once.  A block keeps
its vectors as a forward index (one matrix in the smallest type that holds
them) and, per dimension ("term"), the least and the largest value.  For a
query the sum over dimensions of the larger of ``q * least`` and ``q *
largest`` bounds every score in the block.

A query's k-th score in its own block is known where blocks are made.  The
blocks' bounds meet the queries first, without the blocks: only blocks whose
bound reaches some query's k-th score are sent to that chunk of queries.
There blocks are taken in falling order of their bounds and scored whole until
the bound falls below the k-th best score so far; blocks whose bound equals it
are still scored, since ties go to the smaller id.

Queries are cut into chunks and blocks into shards; a task joins one chunk
with one shard by key, so neither side is ever whole in one place, and the
shards' best k are merged per query.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import require, written

#: Vectors in a block.
BLOCK = 256
#: Blocks in a shard, at most about.
SHARD_BLOCKS = 256
#: Queries in a chunk, about.
CHUNK = 8192
#: Pairs of chunk and block up to this number, counted first, are broadcast.
BROADCAST_PAIRS = 500_000
#: Sums below this are exact in double precision.
EXACT = 2.0**52
#: Scores beyond this are reported as this; they are ranked as they are.
LONG = 2**63 - 1
#: Bytes of the numbers that scores are merged by.
KEY = 320


# -- numbers ------------------------------------------------------------------


def _whole(a: np.ndarray) -> np.ndarray:
    """Whole numbers as Python integers of any size."""
    return np.array([[int(x) for x in row] for row in a.tolist()], object).reshape(a.shape)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products a @ b.T, exactly; whole numbers in any numeric type."""
    most = float(np.abs(a.astype(np.float64)).max(initial=0)) * float(np.abs(b.astype(np.float64)).max(initial=0))
    if most * a.shape[1] < EXACT:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return _whole(a) @ _whole(b).T


def below(score) -> float:
    """A double that is not above the score."""
    if abs(score) >= 10**300:
        return 1e300 if score > 0 else -np.inf
    return float(score) - abs(float(score)) * 2.0**-40


def sort_key(score: int) -> bytes:
    """Bytes that order as the scores do."""
    return (int(score) + (1 << (8 * KEY - 1))).to_bytes(KEY, "big")


def bounds_of(queries: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """[query, block]: no score is above it.

    Computed in doubles and widened by a relative 2**-40, so that rounding
    never prunes a block that matters; what doubles cannot hold is no bound.
    """
    q = queries.astype(np.float64)
    up, down = np.maximum(q, 0), np.minimum(q, 0)
    with np.errstate(all="ignore"):
        out = up @ high.T + down @ low.T
        out += (np.abs(up) @ np.abs(high).T + np.abs(down) @ np.abs(low).T) * 2.0**-40
    return np.where(np.isfinite(out), out, np.inf)


def smallest_type(matrix: np.ndarray) -> np.ndarray:
    """Whole numbers (as doubles) in the smallest type that holds them."""
    most = float(np.abs(matrix).max(initial=0))
    for kind in ("i1", "i2", "i4"):
        if most < 2 ** (8 * int(kind[1]) - 1):
            return matrix.astype(kind)
    return matrix


# -- scoring ------------------------------------------------------------------


def search_shard(
    queries: np.ndarray,
    own: np.ndarray,
    seeds: np.ndarray,
    blocks: list[tuple[int, np.ndarray, np.ndarray]],
    low: np.ndarray,
    high: np.ndarray,
    k: int,
) -> tuple[np.ndarray, np.ndarray, list, int]:
    """(query row, id, score) of each query's k best, and block scorings.

    ``own``: (block, place) of each query's own row, which is no candidate.
    ``seeds``: doubles that are not above the query's k-th score.  ``blocks``:
    (number, ids, matrix) each, with their bounds per dimension.
    """
    bounds = bounds_of(queries, low, high)
    order = np.argsort(-bounds, axis=1, kind="stable")
    best: list[list] = [[] for _ in queries]
    kth = seeds.astype(np.float64).copy()
    active = np.arange(len(queries))
    scored = 0
    for step in range(len(blocks)):
        # Later blocks' bounds are lower still; an equal bound may hold ties.
        active = active[bounds[active, order[active, step]] >= kth[active]]
        if not len(active):
            break
        chosen = order[active, step]
        for b in np.unique(chosen):
            rows = active[chosen == b]
            number, ids, matrix = blocks[b]
            found = products(queries[rows], matrix)
            scored += len(rows)
            near = found >= kth[rows][:, None]
            mine = own[rows, 0] == number
            near[np.flatnonzero(mine), own[rows[mine], 1]] = False
            if found.shape[1] > k + 1 and found.dtype != object:
                # Among all but one (the query itself) only the k best and ties.
                edge = np.partition(found, found.shape[1] - k - 1, axis=1)[:, -k - 1]
                near &= found >= edge[:, None]
            r, c = np.nonzero(near)
            cuts = np.searchsorted(r, np.arange(len(rows) + 1))
            scores, at = found[r, c].tolist(), ids[c].tolist()
            for i, row in enumerate(rows.tolist()):
                s, e = int(cuts[i]), int(cuts[i + 1])
                if s == e:
                    continue
                merged = best[row] + [(-x, v) for x, v in zip(scores[s:e], at[s:e])]
                merged.sort()
                best[row] = merged[:k]
                if len(merged) >= k:
                    kth[row] = max(kth[row], below(-merged[k - 1][0]))
    row = np.repeat(np.arange(len(best)), [len(x) for x in best])
    flat = [x for own_best in best for x in own_best]
    return row, np.array([v for _, v in flat], np.int64), [-s for s, _ in flat], scored


def own_block_seeds(matrix: np.ndarray, asked: np.ndarray, k: int) -> np.ndarray:
    """Per asked row a double not above its k-th score among the block's other rows."""
    at = np.flatnonzero(asked)
    if len(matrix) <= k or not len(at):
        return np.full(len(at), -np.inf)
    found = products(matrix[at], matrix)
    out = np.empty(len(at))
    for i, place in enumerate(at.tolist()):
        others = np.delete(found[i], place)
        kth = sorted(others.tolist(), reverse=True)[k - 1] if others.dtype == object else np.partition(others, len(others) - k)[-k]
        out[i] = below(int(kth))
    return out


# -- tables ---------------------------------------------------------------------

_PACKED = (
    "dim int, n int, ids binary, kind string, matrix binary, low binary, high binary, "
    "places binary, seeds binary, n_asked int"
)


def packed_blocks(vectors: DataFrame, asked: Column, k: int, scale: int, id_col: str, vec_col: str) -> DataFrame:
    """Blocks of consecutive ids, written once: one row per block, by number.

    ``places`` and ``seeds`` are of the asked rows.  Vectors that are null,
    empty, or hold null or non-finite components take no part; neither do rows
    without an id, or components whose scaled value no double can hold.
    """
    require(vectors, id_col, vec_col)
    picked = vectors.select(
        vectors[id_col].cast("long").alias("id"),
        vectors[vec_col].cast("array<double>").alias("raw"),
        F.coalesce(asked, F.lit(False)).alias("asked"),
    )
    x = F.col("raw")
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) * float(scale) < float("inf")))
    usable = picked.filter(F.col("id").isNotNull() & x.isNotNull() & (F.size(x) > 0) & finite)

    def pack(batches):
        import pyarrow as pa

        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            column = batch.column(1)
            values = column.flatten().to_numpy(zero_copy_only=False)
            sizes = column.value_lengths().to_numpy(zero_copy_only=False)
            starts = np.cumsum(sizes) - sizes
            flags = batch.column(2).to_numpy(zero_copy_only=False)
            out = []
            for dim in np.unique(sizes).tolist():
                rows = np.flatnonzero(sizes == dim)
                for at in range(0, len(rows), BLOCK):
                    part = rows[at : at + BLOCK]
                    whole = np.floor(values[starts[part][:, None] + np.arange(dim)] * scale)
                    matrix, own = smallest_type(whole), flags[part]
                    places = np.flatnonzero(own).astype(np.int32)
                    seeds = own_block_seeds(matrix, own, k)
                    low, high = whole.min(axis=0), whole.max(axis=0)
                    packed = (ids[part].astype(np.int64), matrix, low, high, places, seeds)
                    raw = [a.tobytes() for a in packed]
                    out.append((dim, len(part), raw[0], matrix.dtype.str, *raw[1:], len(places)))
            if out:
                kinds = (pa.int32(), pa.int32(), pa.binary(), pa.string(), *[pa.binary()] * 5, pa.int32())
                names = [c.split()[0] for c in _PACKED.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)

    ranged = usable.repartitionByRange("id").sortWithinPartitions("id")
    return written(ranged.mapInArrow(pack, _PACKED).withColumn("block", F.monotonically_increasing_id()), "blocks")


def _queries(packed: DataFrame, chunks: int) -> DataFrame:
    """The asked rows of each block: one row per block that has any."""

    def pick(batches):
        import pyarrow as pa

        for batch in batches:
            out = []
            for r in batch.to_pylist():
                places = np.frombuffer(r["places"], np.int32)
                ids = np.frombuffer(r["ids"], np.int64)[places]
                matrix = np.frombuffer(r["matrix"], r["kind"]).reshape(-1, r["dim"])[places]
                out.append((r["block"], r["dim"], ids.tobytes(), r["kind"], matrix.tobytes(), r["places"], r["seeds"]))
            if out:
                kinds = (pa.int64(), pa.int32(), pa.binary(), pa.string(), pa.binary(), pa.binary(), pa.binary())
                names = ["block", "dim", "ids", "kind", "matrix", "places", "seeds"]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)

    asked = packed.filter("n_asked > 0").select("block", "dim", "ids", "kind", "matrix", "places", "seeds")
    schema = "block long, dim int, ids binary, kind string, matrix binary, places binary, seeds binary"
    picked = asked.mapInArrow(pick, schema)
    return picked.withColumn("chunk", F.pmod(F.xxhash64("block"), F.lit(chunks)).cast("int"))


def _by_dim(pieces) -> dict[int, tuple]:
    """dim -> (query matrix, ids, own (block, place), seeds) of a chunk's pieces."""
    groups: dict[int, list] = {}
    for r in pieces.itertuples(index=False):
        places = np.frombuffer(r.places, np.int32).astype(np.int64)
        own = np.stack([np.full(len(places), r.block, np.int64), places], axis=1)
        matrix = np.frombuffer(r.matrix, r.kind).reshape(-1, r.dim)
        groups.setdefault(r.dim, []).append((matrix, np.frombuffer(r.ids, np.int64), own, np.frombuffer(r.seeds, np.float64)))
    return {dim: tuple(np.concatenate(x) for x in zip(*own)) for dim, own in groups.items()}


def _limits(blocks, dim: int) -> tuple[np.ndarray, np.ndarray]:
    return tuple(np.stack([np.frombuffer(x, np.float64) for x in blocks[c]]).reshape(-1, dim) for c in ("low", "high"))


def top_k(
    vectors: DataFrame,
    asked: Column,
    k: int = 5,
    scale: int = 256,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best other rows of each asked row.

    ``asked`` is a condition on the rows of ``vectors``.  Every row but the
    query's own is a candidate: rows that repeat an id or a vector count each,
    as queries and as candidates.  Ties go to the smaller id; fewer than k
    candidates give fewer rows; vectors of another length are no candidates;
    other columns do not matter.  What takes no part is said at
    :func:`packed_blocks`.  Scores are ranked exactly; those that 64 bits
    cannot hold are reported as the nearest that they can.
    """
    packed = packed_blocks(vectors, asked, k, scale, id_col, vec_col)
    blocks, n_asked = packed.agg(F.count(F.lit(1)), F.coalesce(F.sum("n_asked"), F.lit(0))).first()
    # Small inputs are cut finer, for all cores' sake; large ones by size.
    shards = max(1, min(16, blocks // 2), -(-blocks // SHARD_BLOCKS))
    chunks = max(1, -(-n_asked // CHUNK))
    shard = F.pmod(F.xxhash64("block"), F.lit(shards)).cast("int")
    queries = _queries(packed, chunks).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    limits = packed.select(
        "block", "dim", "low", "high", shard.alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk")
    )

    def reached(key, left, right):
        """(chunk, block) of blocks whose bound reaches some query's seed."""
        import pandas as pd

        out = [np.zeros(0, np.int64)]
        for dim, (q, _, _, seeds) in _by_dim(left).items():
            there = right[right["dim"] == dim]
            if len(there):
                hit = (bounds_of(q, *_limits(there, dim)) >= seeds[:, None]).any(axis=0)
                out.append(there["block"].to_numpy()[hit])
        found = np.concatenate(out)
        return pd.DataFrame({"chunk": np.full(len(found), key[0], np.int32), "block": found})

    pieces = queries.groupBy("chunk", "shard")
    pairs = written(pieces.cogroup(limits.groupBy("chunk", "shard")).applyInPandas(reached, "chunk int, block long"), "reached")
    if pairs.count() <= BROADCAST_PAIRS:
        pairs = F.broadcast(pairs)
    sent = packed.select("block", "dim", "ids", "kind", "matrix", "low", "high", shard.alias("shard")).join(pairs, "block")

    def search(key, left, right):
        import pandas as pd

        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), [], [])]
        for dim, (q, ids, own, seeds) in _by_dim(left).items():
            there = right[right["dim"] == dim]
            if not len(there):
                continue
            blocks = [
                (r.block, np.frombuffer(r.ids, np.int64), np.frombuffer(r.matrix, r.kind).reshape(-1, dim))
                for r in there.itertuples(index=False)
            ]
            row, vec, score, _ = search_shard(q, own, seeds, blocks, *_limits(there, dim), k)
            shown = [max(-LONG, min(LONG, int(x))) for x in score]
            out.append((own[row, 0], own[row, 1], ids[row], vec, shown, [sort_key(x) if abs(x) > LONG else None for x in score]))
        columns = list(zip(*out))
        return pd.DataFrame(
            {
                **{n: np.concatenate(c) for n, c in zip(("block", "place", "query_id", "vec_id"), columns)},
                "score": np.array([x for part in columns[4] for x in part], np.int64),
                "wide": pd.Series([x for part in columns[5] for x in part], dtype=object),
            }
        )

    found = (
        pieces.cogroup(sent.groupBy("chunk", "shard"))
        .applyInPandas(search, "block long, place long, query_id long, vec_id long, score long, wide binary")
    )
    # Scores of more than 64 bits stand at the ends, and are ranked by their bytes there.
    w = Window.partitionBy("block", "place").orderBy(F.desc("score"), F.desc("wide"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(w))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
