"""Best-fit packing by length-histogram planning (operator 6).

Documents become pieces of at most ``capacity`` tokens.  Only the histogram of
piece lengths (at most ``capacity`` entries) reaches the driver, which plans by
best fit over counts: all pieces of one length are placed together, longest
first, each into the fullest open sequences that still hold it.  A plan is a
short list of *slots* (length, first rank, number, first sequence, offset);
pieces take slots by their rank within their length.

Ranks are dealt without putting a length into one task: pieces are ranked
within (length, salt), with about ``RUN`` pieces a salt, and the salts'
totals, summed up in two levels, give each its first rank.  A salt carries
only those slots of the plan that its ranks fall into.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import WordCache, encoder_for, packed
from .common import require, spread, text_or_empty, written

#: Pieces of one length that are ranked in one group, about: few beside what a partition holds.
RUN = 100
#: Salts whose totals are summed up together.
SALTS = 1_000


def plan_slots(histogram: dict[int, int], capacity: int) -> list[tuple]:
    """Best fit, longest first, over counts of lengths.

    Returns slots (length, first_rank, number, first_sequence, offset): pieces
    ranked first_rank .. first_rank + number - 1 among those of this length go
    to sequences first_sequence, first_sequence + 1, ... at this offset.
    Sequences with the same content so far are one group, so the work follows
    the number of different lengths, not the number of pieces.
    """
    slots: list[tuple] = []
    rooms: list[int] = []
    open_groups: dict[int, list[list[int]]] = {}
    next_sequence = 0

    def add(room: int, first: int, number: int) -> None:
        if room:
            if room not in open_groups:
                insort(rooms, room)
                open_groups[room] = []
            open_groups[room].append([first, number])

    for length in sorted(histogram, reverse=True):
        if not 0 < length <= capacity:
            raise ValueError(f"length {length} outside 1..{capacity}")
        left, rank = histogram[length], 0
        while left:
            i = bisect_left(rooms, length)
            if i < len(rooms):
                room = rooms[i]
                group = open_groups[room][-1]
                take = min(left, group[1])
                slots.append((length, rank, take, group[0], capacity - room))
                first = group[0]
                group[0] += take
                group[1] -= take
                if not group[1]:
                    open_groups[room].pop()
                    if not open_groups[room]:
                        del open_groups[room]
                        rooms.pop(i)
                add(room - length, first, take)
            else:
                # Nothing open holds it: new sequences, each filled with as
                # many of this length as fit.
                each = min(capacity // length, left)
                take = left // each
                first, next_sequence = next_sequence, next_sequence + take
                for k in range(each):
                    slots.append((length, rank + k * take, take, first, k * length))
                rank += each * take
                left -= each * take
                add(capacity - each * length, first, take)
                continue
            rank += take
            left -= take
    return slots


def tokenized_pieces(
    docs: DataFrame,
    path: str,
    capacity: int,
    end_id: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(id, piece, start, length, ids_crc32): whole texts as token pieces.

    Each text's ids are followed by ``end_id``; longer ones are cut every
    ``capacity`` tokens.  Null and empty texts are one piece of one token.
    """
    require(docs, id_col, text_col)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        cache = WordCache(encoder_for(path), packed)
        end, width = packed([end_id]), 4 * capacity
        for batch in batches:
            owner, piece, start, length, crc = [], [], [], [], []
            for row, own in enumerate(cache.of_many(batch.column(1).to_pylist())):
                raw = b"".join([*own, end])
                for k, at in enumerate(range(0, len(raw), width)):
                    part = raw[at : at + width]
                    owner.append(row)
                    piece.append(k)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(owner, pa.int64())),
                    pa.array(piece, pa.int32()),
                    pa.array(start, pa.int64()),
                    pa.array(length, pa.int64()),
                    pa.array(crc, pa.int64()),
                ],
                names=["id", "piece", "start", "length", "ids_crc32"],
            )

    picked = spread(docs.select(docs[id_col].alias("id"), text_or_empty(text_col).alias("text")))
    return picked.mapInArrow(
        run, f"id {kind}, piece int, start long, length long, ids_crc32 long"
    )


def pack(pieces: DataFrame, capacity: int, order: list[str]) -> DataFrame:
    """``pieces`` with sequence_id and offset; it has a column ``length``.

    ``order`` names columns that put pieces of one length in order; repeated
    rows take slots of their own.  ``pieces`` should be a written table: it is
    read for the histogram and again for the ranks.  An empty table gives an
    empty result.  Columns named sequence_id or offset are replaced.
    """
    require(pieces, "length", *order)
    spark = pieces.sparkSession
    pieces = pieces.drop("sequence_id", "offset")
    counts = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}
    slots = plan_slots(counts, capacity)
    by_length: dict[int, list[tuple]] = {}
    for length, first, number, sequence, offset in slots:
        by_length.setdefault(length, []).append((first, number, sequence, offset))
    # At most ``capacity`` rows; its arrays follow the plan, not the pieces.
    plan = spark.createDataFrame(
        [
            (length, -(-counts[length] // RUN), sorted(own))
            for length, own in by_length.items()
        ],
        "length long, salts int, slots array<struct<first:long,number:long,sequence:long,place:long>>",
    )
    salted = pieces.join(F.broadcast(plan.select("length", "salts")), "length").withColumn(
        "salt", F.pmod(F.xxhash64(*order), F.col("salts").cast("long")).cast("int")
    )
    totals = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    firsts = written(_first_ranks(totals), "ranks").join(
        F.broadcast(plan.select("length", "slots")), "length"
    )
    reached = F.filter(
        "slots",
        lambda s: (s["first"] < F.col("base") + F.col("n"))
        & (F.col("base") < s["first"] + s["number"]),
    )
    firsts = firsts.select("length", "salt", "base", reached.alias("slots"))
    within = Window.partitionBy("length", "salt").orderBy(*order)
    ranked = (
        salted.withColumn("own_rank", F.row_number().over(within) - 1)
        .join(firsts, ["length", "salt"])
        .withColumn("place_rank", F.col("base") + F.col("own_rank"))
    )
    slot = F.element_at(
        F.filter(
            "slots",
            lambda s: (s["first"] <= F.col("place_rank"))
            & (F.col("place_rank") < s["first"] + s["number"]),
        ),
        1,
    )
    placed = ranked.withColumn("slot", slot)
    return placed.select(
        *pieces.columns,
        (F.col("slot.sequence") + F.col("place_rank") - F.col("slot.first")).alias(
            "sequence_id"
        ),
        F.col("slot.place").alias("offset"),
    )


def _first_ranks(totals: DataFrame) -> DataFrame:
    """(length, salt, n, base): the pieces of one length with a smaller salt.

    Blocks of SALTS salts are summed first, so that no group follows a length.
    """
    totals = totals.withColumn("block", F.floor(F.col("salt") / SALTS))

    def earlier(keys: list[str], order: str):
        window = Window.partitionBy(*keys).orderBy(order)
        return F.coalesce(F.sum("n").over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    blocks = totals.groupBy("length", "block").agg(F.sum("n").alias("n"))
    blocks = blocks.select("length", "block", earlier(["length"], "block").alias("before"))
    inside = totals.withColumn("inside", earlier(["length", "block"], "salt"))
    return inside.join(blocks, ["length", "block"]).select(
        "length", "salt", "n", (F.col("before") + F.col("inside")).alias("base")
    )


def pack_documents(
    docs: DataFrame,
    path: str,
    capacity: int = 2048,
    end_id: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Tokenizes whole texts once, writes the pieces' table, and packs it."""
    pieces = written(
        tokenized_pieces(docs, path, capacity, end_id, id_col, text_col), "pieces"
    )
    return pack(pieces, capacity, ["id", "piece", "start", "ids_crc32"])
