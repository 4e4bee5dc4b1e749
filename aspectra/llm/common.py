"""Shared helpers: the shared folder, written tables and column checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import fresh_path, release, shared_dir, written

__all__ = ["bounded_sample", "fresh_path", "release", "require", "shared_dir", "spread", "text_or_empty", "written"]


def require(df: DataFrame, *names: str) -> None:
    """Raise ``ValueError`` where ``df`` lacks one of the columns."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; found {df.columns}")


def text_or_empty(name: str):
    """The text column with null as the empty text."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def bounded_sample(df: DataFrame, key: str, most: int, *ties: str) -> DataFrame:
    """At most ``most`` rows: those with the least hash of ``key``.

    Rows are counted first, and a hash threshold that about twice as many pass
    is applied where they are read, so tasks send few rows to be ordered.
    """
    n = df.count()
    share = min(1.0, 2.0 * most / n + 100.0 / n) if n else 1.0
    rank = F.pmod(F.xxhash64(key), F.lit(1 << 40))
    return df.filter(rank < int(share * (1 << 40))).orderBy(rank, key, *ties).limit(most)


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores where it is read in fewer parts than there are.

    Files of one row group are one task, however many cores wait.  Tables with
    enough parts, and plans with an exchange of their own, pass as they are.
    """
    execution = df._jdf.queryExecution()
    if "Exchange" in execution.executedPlan().toString():
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if execution.toRdd().getNumPartitions() >= cores else df.repartition(cores)
