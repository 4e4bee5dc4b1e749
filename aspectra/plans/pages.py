"""Sorted pages as plans: a limit only where a page has a size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cut(rows: DataFrame, order: list, start: int = 0, size: int | None = None) -> DataFrame:
    """``rows`` in order, from ``start``, at most ``size``.

    With a size this is one top-n over all tasks; without one it is a sort by
    ranges, so no task sees all rows.
    """
    out = rows.orderBy(*order)
    if start > 0:
        out = out.offset(start)
    return out if size is None else out.limit(max(0, size))


def cut_by_key(rows: DataFrame, key: str, start: int = 0, size: int | None = None) -> DataFrame:
    """As :func:`cut`, by one unique column.

    Without a size the rows to skip are found first, one top-n, and the rest
    is filtered by the last of them: no task sees all rows.
    """
    if size is not None or start <= 0:
        return cut(rows, [F.col(key)], start, size)
    skipped = rows.select(key).orderBy(key).limit(start)
    last = skipped.agg(F.max(key)).first()[0]
    return (rows if last is None else rows.filter(F.col(key) > F.lit(last))).orderBy(key)
