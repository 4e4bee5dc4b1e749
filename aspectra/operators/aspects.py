"""The versioned aspect store: keys, versions, lists, retention, deletion.

Two layouts are read: the log (urn, aspect, version, metadata, createdon,
createdby, createdfor) and the wide entity table with one cell per aspect.
Key sets are data frames, so a batch of any size is one join.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import formats
from ..functions.envelopes import deletion, field, is_live, is_marker, unwrap
from ..model import Entity
from ..plans.criteria import Page
from ..sources.scratch import written

#: Key sets up to this number of rows, counted first, are broadcast.
BROADCAST_KEYS = 100_000


def small(keys: DataFrame) -> DataFrame:
    """Keys marked for broadcast if counting shows that they are few."""
    return F.broadcast(keys) if keys.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS else keys


# -- versions -----------------------------------------------------------------


def versioned(changes: DataFrame, tie: list[str] | None = None, keep_equal: bool = True) -> DataFrame:
    """Changes (urn, aspect, metadata, createdon, ...) with their version.

    The latest value has version 0, older ones count from 1, the oldest.
    Without ``keep_equal`` values equal to the one before make no version.
    """
    order = [F.col("createdon"), *map(F.col, tie or [])]
    own = Window.partitionBy("urn", "aspect")
    if not keep_equal:
        before = F.lag("metadata").over(own.orderBy(*order))
        first = F.row_number().over(own.orderBy(*order)) == 1
        changes = (
            changes.withColumn("_same", ~first & before.eqNullSafe(F.col("metadata")))
            .filter(~F.col("_same"))
            .drop("_same")
        )
    # One sort: the number of a row and the number of rows give both counts.
    number = F.row_number().over(own.orderBy(*order))
    total = F.count(F.lit(1)).over(own)
    return changes.withColumn(
        "version",
        F.when(number == total, F.lit(formats.LATEST_VERSION)).otherwise(number).cast("long"),
    )


# -- point reads --------------------------------------------------------------


def get(log: DataFrame, keys: DataFrame, fold_case: bool = False) -> DataFrame:
    """Values of (urn, aspect[, version]) keys; found is false for the rest.

    Without a version column keys ask for the latest.  Markers count as
    absent.  ``fold_case`` matches urns whatever their case.
    """
    if "version" not in keys.columns:
        keys = keys.withColumn("version", F.lit(formats.LATEST_VERSION).cast("long"))
    left = (F.lower if fold_case else (lambda c: c))(F.col("k.urn"))
    right = (F.lower if fold_case else (lambda c: c))(F.col("l.urn"))
    on = (left == right) & (F.col("k.aspect") == F.col("l.aspect")) & (F.col("k.version") == F.col("l.version"))
    live = log.filter(is_live(F.col("metadata")))
    return keys.distinct().alias("k").join(live.alias("l"), on, "left").select(
        "k.urn",
        "k.aspect",
        "k.version",
        F.col("l.metadata").alias("metadata"),
        F.col("l.urn").isNotNull().alias("found"),
    )


def get_many(log: DataFrame, urns: DataFrame, aspects: list[str]) -> DataFrame:
    """(urn, values): a map from aspect to latest value for each urn."""
    names = F.array(*[F.lit(a) for a in aspects])
    keys = urns.select("urn").distinct().withColumn("aspect", F.explode(names))
    entry = F.when(F.col("found"), F.struct(F.col("aspect").alias("key"), F.col("metadata").alias("value")))
    return (
        get(log, keys)
        .groupBy("urn")
        .agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("values"))
    )


def get_with_info(log: DataFrame, keys: DataFrame) -> DataFrame:
    """Values with version, audit stamp, emit time and emitter; absent keys go."""
    if "version" not in keys.columns:
        keys = keys.withColumn("version", F.lit(formats.LATEST_VERSION).cast("long"))
    live = log.filter(is_live(F.col("metadata")))
    optional = [c if c in log.columns else F.lit(None).cast(t).alias(c) for c, t in (("emittime", "long"), ("emitter", "string"))]
    return live.join(keys.distinct(), ["urn", "aspect", "version"]).select(
        "urn",
        "aspect",
        "version",
        "metadata",
        F.struct(
            F.unix_millis("createdon").alias("time"),
            F.col("createdby").alias("actor"),
            F.col("createdfor").alias("impersonator"),
        ).alias("audit"),
        *optional,
    )


def get_cells(
    table: DataFrame, entity: Entity, aspects: list[str], urns: DataFrame, include_deleted: bool = False
) -> DataFrame:
    """(urn, aspect, value, deleted, time, actor) from the wide table.

    Live cells give their value.  With ``include_deleted`` markers give rows
    with deleted true, and cells of deleted assets give marker rows with the
    asset's time.  Aspects without a column are left out.
    """
    present = [a for a in aspects if entity.aspect(a).column in table.columns]
    if not present:
        return table.sparkSession.createDataFrame(
            [], "urn string, aspect string, value string, deleted boolean, time long, actor string"
        )
    cells = F.array(
        *[F.struct(F.lit(a).alias("aspect"), F.col(entity.aspect(a).column).alias("cell")) for a in present]
    )
    rows = table.join(small(urns.select("urn").distinct()), "urn", "left_semi")
    rows = rows.select("urn", "deleted_ts", F.explode(cells).alias("c")).select(
        "urn", "deleted_ts", "c.aspect", "c.cell"
    )
    rows = rows.filter(F.col("cell").isNotNull())
    gone = F.col("deleted_ts").isNotNull()
    marked = is_marker(F.col("cell"))
    if not include_deleted:
        rows = rows.filter(~gone & ~marked)
    return rows.select(
        "urn",
        "aspect",
        F.when(~gone & ~marked, unwrap(F.col("cell"))).alias("value"),
        (gone | marked).alias("deleted"),
        F.when(gone, F.unix_millis("deleted_ts")).when(marked, deletion(F.col("cell"))["time"]).alias("time"),
        F.when(marked, deletion(F.col("cell"))["by"])
        .otherwise(field(F.col("cell"), "lastmodifiedby"))
        .alias("actor"),
    )


def exists(table: DataFrame, urns: DataFrame) -> DataFrame:
    """(urn, exists): whether the wide table has a live row."""
    # Urns are the table's key: no need to make them distinct.
    live = table.filter(F.col("deleted_ts").isNull()).select("urn", F.lit(True).alias("_here"))
    return urns.select("urn").distinct().join(live, "urn", "left").select(
        "urn", F.coalesce("_here", F.lit(False)).alias("exists")
    )


def exists_in_log(log: DataFrame, urns: DataFrame) -> DataFrame:
    """(urn, exists): whether the log has any row, deleted or not."""
    here = log.select("urn").distinct().withColumn("_here", F.lit(True))
    return urns.select("urn").distinct().join(here, "urn", "left").select(
        "urn", F.coalesce("_here", F.lit(False)).alias("exists")
    )


def _asked(table: DataFrame, urns: list[str] | DataFrame) -> DataFrame:
    """(urn) of a batch: lists are limited, data frames are joined at any size."""
    if isinstance(urns, DataFrame):
        return urns.select("urn").distinct()
    if len(urns) > formats.BATCH_DELETE_URNS:
        raise ValueError(f"at most {formats.BATCH_DELETE_URNS} urns")
    return table.sparkSession.createDataFrame([(u,) for u in set(urns)], "urn string")


def deletion_info(
    table: DataFrame, urns: list[str] | DataFrame, status: Column, status_on: Column, cells: list[str]
) -> DataFrame:
    """What deleting these assets would meet: at most 2000 listed urns.

    (urn, deleted_ts, removed, status_on, cells): deleted rows are included;
    ``cells`` maps columns to their values that are not null.
    """
    asked = _asked(table, urns)
    pairs = F.array(*[F.struct(F.lit(c).alias("key"), F.col(c).alias("value")) for c in cells])
    kept = F.filter(pairs, lambda p: p["value"].isNotNull())
    return table.join(small(asked), "urn", "left_semi").select(
        "urn",
        "deleted_ts",
        F.coalesce(status.cast("boolean"), F.lit(False)).alias("removed"),
        status_on.alias("status_on"),
        F.map_from_entries(kept).alias("cells"),
    )


# -- lists --------------------------------------------------------------------


def _not_marker(column: str = "metadata", legacy_only: bool = False) -> Column:
    if legacy_only:
        return F.col(column) != F.lit('{"%s":true}' % formats.DELETED_FLAG)
    return is_live(F.col(column))


def list_versions(log: DataFrame, aspect: str, urn: str) -> DataFrame:
    """Versions of an aspect in order; legacy markers are left out."""
    own = log.filter((F.col("aspect") == aspect) & (F.col("urn") == urn) & _not_marker(legacy_only=True))
    return own.select("version").orderBy("version")


def list_aspect(log: DataFrame, aspect: str, urn: str) -> DataFrame:
    """All versions of one aspect of one urn that are not deleted, ascending."""
    own = log.filter((F.col("aspect") == aspect) & (F.col("urn") == urn) & _not_marker())
    return own.orderBy("version")


def list_version(log: DataFrame, aspect: str, version: int = formats.LATEST_VERSION) -> DataFrame:
    """One version of an aspect across urns, by urn."""
    own = log.filter((F.col("aspect") == aspect) & (F.col("version") == version) & _not_marker())
    return own.orderBy("urn")


def list_urns_of(table: DataFrame, entity: Entity, aspect: str, compat: bool = False) -> DataFrame:
    """Urns that have the aspect, by urn.

    ``compat``: cells that are null pass as well, as in the statement that
    looks for markers only.
    """
    cell = F.col(entity.aspect(aspect).column)
    wanted = ~F.coalesce(is_marker(cell), F.lit(False)) if compat else is_live(cell)
    return table.filter(wanted & F.col("deleted_ts").isNull()).select("urn").orderBy("urn")


def page_of(df: DataFrame, order: list, start: int, size: int) -> Page:
    """An offset page of a sorted frame and its totals; negatives count as 0."""
    start, size = max(start, 0), max(size, 0)
    total = df.count()
    rows = df.orderBy(*order).offset(start).limit(size)
    returned = max(0, min(size, total - start))
    return Page(rows, min(start, total) if returned else start if start <= total else total, size, total, returned)


# -- retention and deletion ---------------------------------------------------


def retain_versions(log: DataFrame, most: int) -> DataFrame:
    """The latest version and the ``most`` - 1 largest others of each key."""
    if most < 1:
        raise ValueError("at least one version stays")
    largest = F.max("version").over(Window.partitionBy("urn", "aspect"))
    doomed = (F.col("version") != formats.LATEST_VERSION) & (F.col("version") <= largest - most + 1)
    return log.withColumn("_gone", doomed).filter(~F.col("_gone")).drop("_gone")


def retain_time(log: DataFrame, now: dt.datetime, age: dt.timedelta) -> DataFrame:
    """Rows created within ``age``; the latest version may go as well."""
    return log.filter(F.col("createdon") >= F.lit(now - age))


def retain_all(log: DataFrame) -> DataFrame:
    """Indefinite retention, the default."""
    return log


def soft_delete_assets(
    table: DataFrame, urns: list[str] | DataFrame, cutoff: str, status: Column, status_on: Column, now: Column
) -> DataFrame:
    """Sets deleted_ts where the asset is live, removed, and so since before.

    ``cutoff`` is text in the stored format and compared as text; it must be
    written in full.  At most 2000 listed urns.
    """
    asked = _asked(table, urns)
    dt.datetime.strptime(cutoff, "%Y-%m-%d %H:%M:%S.%f")
    if len(cutoff) != 23:
        raise ValueError("the cutoff needs three fractional digits")
    marked = table.join(small(asked.withColumn("_asked", F.lit(True))), "urn", "left")
    hit = (
        F.coalesce("_asked", F.lit(False))
        & F.col("deleted_ts").isNull()
        & F.coalesce(status.cast("string") == "true", F.lit(False))
        & (status_on < F.lit(cutoff))
    )
    out = marked.withColumn("deleted_ts", F.when(hit, now).otherwise(F.col("deleted_ts")))
    return out.select(*table.columns)


def compare_layouts(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows that only one of two layouts has, with the side that has them.

    Rows count as often as they occur.  Each side is read once: one aggregate
    over both counts how often the old side has a row more than the new one.
    """
    sides = old.withColumn("_n", F.lit(1)).union(new.withColumn("_n", F.lit(-1)))
    names = [F.col(f"`{c}`") for c in old.columns]
    more = sides.groupBy(*names).agg(F.sum("_n").alias("_n")).filter("_n <> 0")
    side = F.when(F.col("_n") > 0, F.lit("old")).otherwise(F.lit("new")).alias("only_in")
    # Repeats in two steps, so that no array is long.
    parts = more.withColumn("_part", F.expr("explode(sequence(0, (abs(_n) - 1) div 10000))"))
    return parts.withColumn("_copy", F.expr("explode(sequence(1, least(10000, abs(_n) - 10000 * _part)))")).select(*names, side)


def shadow_read(local: DataFrame, shadow: DataFrame) -> DataFrame:
    """(urn, aspect, value, matches): local values, checked against a shadow.

    Values that only the shadow has are dropped.
    """
    left, right = local.alias("l"), shadow.alias("s")
    joined = left.join(right, ["urn", "aspect"], "full_outer").filter(F.col("l.value").isNotNull())
    return joined.select(
        "urn", "aspect", F.col("l.value").alias("value"), F.col("l.value").eqNullSafe(F.col("s.value")).alias("matches")
    )


def new_ids(existing: DataFrame, rows: DataFrame, order: list[str]) -> DataFrame:
    """Numbers after the largest of (namespace, id) for rows of a namespace.

    Rows are sorted by ranges and written with their partition and place; the
    partitions' totals give each its first number.  So no namespace is sorted
    in one task, and a repeated task cannot number rows otherwise.
    """
    top = existing.groupBy("namespace").agg(F.max("id").alias("_top"))
    ranged = rows.repartitionByRange("namespace", *order).sortWithinPartitions("namespace", *order)
    marked = written(
        ranged.withColumn("_part", F.spark_partition_id()).withColumn("_pos", F.monotonically_increasing_id()),
        "numbered",
    )
    totals = marked.groupBy("namespace", "_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_pos").alias("_first"))
    before = Window.partitionBy("namespace").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = totals.select("namespace", "_part", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    return (
        marked.join(shifts, ["namespace", "_part"])
        .join(top, "namespace", "left")
        .withColumn("id", F.coalesce("_top", F.lit(0)) + F.col("_shift") + F.col("_pos") - F.col("_first") + 1)
        .drop("_part", "_pos", "_first", "_shift", "_top")
    )
