"""Ingestion: the update decision, writes, events and backfill.

A batch of changes is joined with the current state once; the decision is a
column expression; what is written and which events follow are projections of
the decided rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import formats
from ..functions.envelopes import deletion, is_marker
from ..functions.urns import is_valid
from ..model import Entity, Registry

Equality = Callable[[Column, Column], Column]

# -- equality -----------------------------------------------------------------


def structural(old: Column, new: Column) -> Column:
    """JSON values are equal whatever their spacing and key order.

    The paths and values of the parsed variants decide; text equality is the
    short way.
    """
    return old.eqNullSafe(new) | F.coalesce(
        F.to_json(F.try_parse_json(old)) == F.to_json(F.try_parse_json(new)), F.lit(False)
    )


def never_equal(old: Column, new: Column) -> Column:
    """Nothing is equal: every change is written."""
    return F.lit(False)


# -- decision -----------------------------------------------------------------

#: Ingestion modes that write whatever the other rules say.
FORCED = ("LIVE_OVERRIDE", "FORCE_UPDATE")

#: Columns of a change beside urn, aspect and value, with their types.
CHANGE_FIELDS = {
    "emit_time": "long",
    "etag_time": "long",
    "backfill": "boolean",
    "mode": "string",
    "at": "timestamp",
    "by": "string",
    "test_mode": "boolean",
}


def complete(changes: DataFrame) -> DataFrame:
    """Changes with all fields; missing ones are null."""
    missing = {c: F.lit(None).cast(t) for c, t in CHANGE_FIELDS.items() if c not in changes.columns}
    return changes.withColumns(missing) if missing else changes


def accept_backfill(existed: Column, emit: Column, deleted_at: Column, old_emit: Column, old_time: Column) -> Column:
    """Whether a backfill event is newer than what is stored."""
    return (
        F.when(~existed, F.lit(True))
        .when(emit.isNull(), F.lit(False))
        .when(deleted_at.isNotNull(), emit > deleted_at)
        .when(old_emit.isNotNull(), emit > old_emit)
        .otherwise(F.coalesce(emit > old_time, F.lit(True)))
    )


def semantic_version(value: Column, path: str = "$.baseSemanticVersion") -> Column:
    """(major, minor, patch) of a value; a missing version ranks lowest."""
    part = lambda n: F.coalesce(F.get_json_object(value, f"{path}.{n}").cast("int"), F.lit(-1))
    return F.struct(part("major").alias("major"), part("minor").alias("minor"), part("patch").alias("patch"))


def decide(joined: DataFrame, equality: Equality = structural, force_if: Column | None = None) -> DataFrame:
    """Adds accepted, equal, version_skip, etag_skip and write.

    ``joined``: changes with the stored old_value (null for none and for
    markers), old_exists, old_deleted_at, old_emit and old_time in
    milliseconds.  The order is: stale backfills are rejected; then equal
    values, lower semantic versions and older eTags are skipped, unless the
    mode forces the write (for FORCE_UPDATE only where ``force_if`` holds).
    """
    old, new = F.col("old_value"), F.col("value")
    accepted = F.when(
        F.coalesce("backfill", F.lit(False)),
        accept_backfill(
            F.coalesce("old_exists", F.lit(False)),
            F.col("emit_time"),
            F.col("old_deleted_at"),
            F.col("old_emit"),
            F.col("old_time"),
        ),
    ).otherwise(F.lit(True))
    equal = (old.isNull() & new.isNull()) | (
        old.isNotNull() & new.isNotNull() & equality(old, new)
    )
    lower = old.isNotNull() & new.isNotNull() & (semantic_version(new) < semantic_version(old))
    stale = F.coalesce(F.col("etag_time") < F.col("old_time"), F.lit(False))
    forced = F.coalesce(F.col("mode") == "LIVE_OVERRIDE", F.lit(False)) | (
        F.coalesce(F.col("mode") == "FORCE_UPDATE", F.lit(False))
        & (F.lit(True) if force_if is None else F.coalesce(force_if, F.lit(False)))
    )
    return (
        joined.withColumn("accepted", accepted)
        .withColumn("equal", F.coalesce(equal, F.lit(False)))
        .withColumn("version_skip", F.coalesce(lower, F.lit(False)))
        .withColumn("etag_skip", stale)
        .withColumn(
            "write",
            F.col("accepted")
            & (forced | ~(F.col("equal") | F.col("version_skip") | F.col("etag_skip"))),
        )
    )


def with_current(changes: DataFrame, log: DataFrame) -> DataFrame:
    """Changes with what the log holds at version 0; keys fold case.

    ``urn`` becomes the stored, canonical form where there is one.
    """
    now = log.filter(F.col("version") == formats.LATEST_VERSION).select(
        F.lower("urn").alias("_u"),
        F.col("urn").alias("_stored"),
        F.col("aspect").alias("_a"),
        F.col("metadata").alias("_m"),
        F.unix_millis("createdon").alias("old_time"),
        (F.col("emittime") if "emittime" in log.columns else F.lit(None).cast("long")).alias("old_emit"),
    )
    rows = complete(changes)
    joined = rows.join(now, (F.lower(rows["urn"]) == F.col("_u")) & (rows["aspect"] == F.col("_a")), "left")
    gone = is_marker(F.col("_m"))
    return joined.select(
        F.coalesce("_stored", rows["urn"]).alias("urn"),
        *[c for c in rows.columns if c != "urn"],
        F.when(F.col("_m").isNotNull() & ~gone, F.col("_m")).alias("old_value"),
        F.col("_m").isNotNull().alias("old_exists"),
        F.when(gone, F.coalesce(deletion(F.col("_m"))["time"], F.col("old_time"))).alias("old_deleted_at"),
        "old_emit",
        "old_time",
    )


def split_conflicts(joined: DataFrame, expected: str = "expected_time") -> tuple[DataFrame, DataFrame]:
    """(writable, conflicting): optimistic locking by the stored time.

    A change that expects a time other than the stored one (in milliseconds;
    null expects that nothing is stored) conflicts and is to be retried.
    """
    fits = F.col(expected).eqNullSafe(F.col("old_time"))
    return joined.filter(fits), joined.filter(~fits)


def sequential(changes: DataFrame, log: DataFrame, order: list[str]) -> DataFrame:
    """Decides several changes of one key one after the other.

    (urn, aspect, *order, value, write): each change is compared with the
    value that was accepted before it: equal values and lower semantic
    versions are skipped.  A key's changes are folded in order as one array in
    the JVM, since each decision needs the one before; batches should hold few
    changes of one key.
    """
    now = with_current(changes.select("urn", "aspect").distinct().withColumn("value", F.lit(None).cast("string")), log)
    start = now.select(F.lower("urn").alias("_u"), F.col("urn").alias("_stored"), F.col("aspect").alias("_a"), "old_value")
    grouped = changes.groupBy("urn", "aspect").agg(F.sort_array(F.collect_list(F.struct(*order, "value"))).alias("all"))
    rows = grouped.join(start, (F.lower(grouped["urn"]) == F.col("_u")) & (grouped["aspect"] == F.col("_a")))
    kind = rows.schema["all"].dataType.elementType.simpleString()
    zero = F.struct(
        F.col("old_value").alias("now"),
        F.array().cast(f"array<struct<change:{kind},write:boolean>>").alias("out"),
    )

    def step(state, change):
        old, new = state["now"], change["value"]
        same = (old.isNull() & new.isNull()) | (old.isNotNull() & new.isNotNull() & structural(old, new))
        lower = old.isNotNull() & new.isNotNull() & (semantic_version(new) < semantic_version(old))
        write = ~(F.coalesce(same, F.lit(False)) | F.coalesce(lower, F.lit(False)))
        return F.struct(
            F.when(write, new).otherwise(old).alias("now"),
            F.array_append(state["out"], F.struct(change.alias("change"), write.alias("write"))).alias("out"),
        )

    folded_rows = rows.select(
        F.coalesce("_stored", grouped["urn"]).alias("urn"),
        grouped["aspect"],
        F.explode(F.aggregate("all", zero, step, lambda s: s["out"])).alias("d"),
    )
    return folded_rows.select("urn", "aspect", *[F.col(f"d.change.{c}").alias(c) for c in [*order, "value"]], F.col("d.write").alias("write"))


# -- writes -------------------------------------------------------------------


def duplicate_aspects(changes: DataFrame) -> DataFrame:
    """(urn, aspect, n) given more than once: a batch with these is rejected."""
    return changes.groupBy("urn", "aspect").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)


def latest_per_key(changes: DataFrame, order: list[str]) -> DataFrame:
    """The last of several changes of one key, by partial aggregation."""
    names = [c for c in changes.columns if c not in ("urn", "aspect", *order)]
    picked = F.max(F.struct(*order, *names)).alias("_x")
    return changes.groupBy("urn", "aspect").agg(picked).select("urn", "aspect", "_x.*").select(*changes.columns)


def accepted_rows(decided: DataFrame) -> DataFrame:
    """(urn, aspect, metadata, createdon, createdby) of the decided writes.

    A null value becomes a marker.
    """
    gone = F.to_json(
        F.struct(
            F.lit(True).alias(formats.DELETED_FLAG),
            F.unix_millis("at").alias(formats.DELETED_TIME),
            F.col("by").alias(formats.DELETED_BY),
        )
    )
    return decided.filter("write").select(
        "urn",
        "aspect",
        F.coalesce(F.col("value"), gone).alias("metadata"),
        F.col("at").alias("createdon"),
        F.col("by").alias("createdby"),
    )


def apply_changes(log: DataFrame, decided: DataFrame, overwrite: bool = False) -> DataFrame:
    """The log after the decided writes.

    The stored value moves to the next version and the new one takes version
    0; a null value writes a marker.  With ``overwrite`` no history is kept.
    Where nothing is written rows pass unchanged.
    """
    writes = accepted_rows(decided)
    keys = writes.select("urn", "aspect").withColumn("_new", F.lit(True))
    # The window has the join's partitioning: one exchange of the log.
    top = F.max("version").over(Window.partitionBy("urn", "aspect"))
    moved = (
        log.join(keys, ["urn", "aspect"], "left")
        .withColumn("_top", top)
        .withColumn("_moves", F.coalesce("_new", F.lit(False)) & (F.col("version") == formats.LATEST_VERSION))
    )
    if overwrite:
        moved = moved.filter(~F.col("_moves"))
    version = F.when(F.col("_moves"), F.col("_top") + 1).otherwise(F.col("version"))
    kept = moved.withColumn("version", version).select(*log.columns)
    new = writes.withColumn("version", F.lit(formats.LATEST_VERSION).cast("long"))
    for c in log.columns:
        if c not in new.columns:
            new = new.withColumn(c, F.lit(None).cast(log.schema[c].dataType))
    return kept.unionByName(new.select(*log.columns))


def create_assets(table: DataFrame, assets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(the table with new assets, rejected ones that exist and are live).

    Deleted assets revive with their new cells.
    """
    live = table.filter(F.col("deleted_ts").isNull()).select("urn")
    rejected = assets.join(live, "urn", "left_semi")
    accepted = assets.join(live, "urn", "left_anti")
    rest = table.join(accepted.select("urn"), "urn", "left_anti")
    new = accepted
    for c in table.columns:
        if c not in new.columns:
            new = new.withColumn(c, F.lit(None).cast(table.schema[c].dataType))
    return rest.unionByName(new.withColumn("deleted_ts", F.lit(None).cast("timestamp")).select(*table.columns)), rejected


def upsert_cells(table: DataFrame, cells: DataFrame, entity: Entity | None = None) -> DataFrame:
    """Wide rows after new cells (urn, column, cell, at, by); writing revives.

    Of several cells of one place the latest counts, of equal times the
    greatest text.  Paths that are materialised as columns follow their cells
    where ``entity`` is given.  One aggregation over named columns, one full
    outer join.
    """
    names = [c for c in table.columns if c.startswith(formats.ASPECT_PREFIX)]
    last = lambda c: F.max(F.when(F.col("column") == c, F.struct("at", "cell")))["cell"].alias(c)
    stamp = F.max(F.struct("at", "by"))
    new = cells.groupBy("urn").agg(*map(last, names), stamp["at"].alias("_at"), stamp["by"].alias("_by")).alias("n")
    paths = entity.materialised(table.columns) if entity else {}
    joined = table.alias("t").join(new, F.col("t.urn") == F.col("n.urn"), "full_outer")
    touched = F.col("n.urn").isNotNull()
    out = []
    for c in table.columns:
        if c == "urn":
            out.append(F.coalesce("t.urn", "n.urn").alias("urn"))
        elif c in names:
            out.append(F.coalesce(F.col(f"n.{c}"), F.col(f"t.{c}")).alias(c))
        elif c in paths:
            cell, path = paths[c]
            out.append(F.when(F.col(f"n.{cell}").isNotNull(), F.get_json_object(f"n.{cell}", path)).otherwise(F.col(f"t.`{c}`")).alias(c))
        elif c == "deleted_ts":
            out.append(F.when(~touched, F.col("t.deleted_ts")).alias(c))
        elif c == "lastmodifiedon":
            out.append(F.coalesce("n._at", "t.lastmodifiedon").alias(c))
        elif c == "lastmodifiedby":
            out.append(F.coalesce("n._by", "t.lastmodifiedby").alias(c))
        else:
            out.append(F.col(f"t.`{c}`").alias(c))
    return joined.select(*out)


def delete_all(log: DataFrame, table: DataFrame, urns: DataFrame, at: Column, by: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(changes that delete each aspect, the table, events) for whole assets.

    Each aspect yields two events, one for itself and one for DELETE_ALL.
    """
    own = urns.select("urn").distinct()
    live = log.filter((F.col("version") == formats.LATEST_VERSION) & ~is_marker(F.col("metadata")))
    changes = live.join(own, "urn", "left_semi").select(
        "urn", "aspect", F.lit(None).cast("string").alias("value"), at.alias("at"), by.alias("by")
    )
    marked = table.join(own.withColumn("_hit", F.lit(True)), "urn", "left")
    table = marked.withColumn("deleted_ts", F.when(F.col("_hit"), at).otherwise(F.col("deleted_ts"))).drop("_hit")
    kinds = F.array(F.lit("DELETE"), F.lit("DELETE_ALL"))
    events = changes.select("urn", "aspect", F.explode(kinds).alias("change_type"))
    return changes, table, events


# -- validation and failures ---------------------------------------------------


def split_invalid(changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good, failed): rows with malformed urns go to the dead letters."""
    good = F.coalesce(is_valid(F.col("urn")), F.lit(False))
    failed = changes.filter(~good).withColumn("error", F.lit("malformed urn"))
    return changes.filter(good), failed


def with_defaults(value: Column, schema: str, required: tuple[str, ...], defaults: dict[str, object]) -> tuple[Column, Column]:
    """(value with defaults, error): missing required fields without default
    and fields that the schema lacks are errors."""
    parsed = F.from_json(value, schema)
    from pyspark.sql import types as T

    kinds = T.DataType.fromDDL(schema)
    fields = [
        F.coalesce(parsed[f.name], F.lit(defaults[f.name]).cast(f.dataType)).alias(f.name)
        if f.name in defaults
        else parsed[f.name].alias(f.name)
        for f in kinds
    ]
    extra = F.array_except(F.json_object_keys(value), F.array(*[F.lit(f.name) for f in kinds]))
    missing = F.array_compact(
        F.array(*[F.when(parsed[r].isNull(), F.lit(r)) for r in required if r not in defaults])
    ).cast("array<string>")
    error = (
        F.when(F.size(extra) > 0, F.concat(F.lit("unknown fields: "), F.array_join(extra, ",")))
        .when(F.size(missing) > 0, F.concat(F.lit("missing fields: "), F.array_join(missing, ",")))
    )
    return F.to_json(F.struct(*fields)), error


# -- events -------------------------------------------------------------------


def audit_events(decided: DataFrame, always: bool = False) -> DataFrame:
    """Old and new value of what changed (or of everything, with ``always``)."""
    rows = decided if always else decided.filter("write")
    kind = (
        F.when(F.col("value").isNull(), F.lit("DELETE"))
        .when(F.col("old_value").isNull(), F.lit("CREATE"))
        .otherwise(F.lit("UPDATE"))
    )
    return rows.select(
        "urn",
        "aspect",
        F.col("old_value").alias("oldValue"),
        F.col("value").alias("newValue"),
        kind.alias("changeType"),
        F.coalesce("mode", F.lit("LIVE")).alias("ingestionMode"),
        F.struct(F.unix_millis("at").alias("time"), F.col("by").alias("actor")).alias("audit"),
    )


def with_topics(events: DataFrame, event: str, entity: Column, per_aspect: bool = True) -> DataFrame:
    """Events with their topic: event, entity and aspect joined by underscores."""
    parts = [F.lit(event), entity] + ([F.col("aspect")] if per_aspect else [])
    return events.withColumn("topic", F.concat_ws("_", *parts))


#: Backfill modes and the ingestion mode of their events; others emit nothing.
BACKFILL_MODES = {"BACKFILL_ALL": "BACKFILL", "BACKFILL_INCLUDING_LIVE_INDEX": "LIVE_INDEX", "BOOTSTRAP": "BOOTSTRAP"}
SILENT_MODES = ("MAE_ONLY_WITH_OLD_VALUE_NULL", "SCSI_ONLY")


def backfill_events(log: DataFrame, aspects: list[str], mode: str, last_urn: str | None = None, size: int | None = None) -> DataFrame:
    """Events with old = new for latest values, for one page of urns."""
    if mode not in BACKFILL_MODES and mode not in SILENT_MODES:
        raise ValueError(f"unknown backfill mode {mode}")
    rows = log.filter(
        (F.col("version") == formats.LATEST_VERSION)
        & F.col("aspect").isin(aspects)
        & F.col("metadata").isNotNull()
        & ~is_marker(F.col("metadata"))
    )
    if last_urn is not None:
        rows = rows.filter(F.col("urn") > last_urn)
    if size is not None:
        page = rows.select("urn").distinct().orderBy("urn").limit(size)
        rows = rows.join(page, "urn", "left_semi")
    if mode in SILENT_MODES:
        rows = rows.limit(0)
    return rows.select(
        "urn",
        "aspect",
        F.col("metadata").alias("oldValue"),
        F.col("metadata").alias("newValue"),
        F.lit(BACKFILL_MODES.get(mode, mode)).alias("ingestionMode"),
    )


def backfilled(events: DataFrame) -> DataFrame:
    """(urn, aspects): what a backfill found for each urn."""
    return events.groupBy("urn").agg(F.array_sort(F.collect_set("aspect")).alias("aspects"))


def wide_from_log(log: DataFrame, columns: dict[str, str]) -> DataFrame:
    """The wide table from the log: one column per aspect of ``columns``."""
    now = log.filter((F.col("version") == formats.LATEST_VERSION) & F.col("aspect").isin(list(columns)))
    wide = now.groupBy("urn").pivot("aspect", list(columns)).agg(F.first("metadata"))
    stamps = now.groupBy("urn").agg(F.max("createdon").alias("lastmodifiedon"), F.max_by("createdby", "createdon").alias("lastmodifiedby"))
    out = wide.join(stamps, "urn")
    for aspect, column in columns.items():
        out = out.withColumnRenamed(aspect, column)
    return out.withColumn("deleted_ts", F.lit(None).cast("timestamp"))


def raw_add(changes: DataFrame, log: DataFrame, equality: Equality = structural) -> tuple[DataFrame, DataFrame]:
    """Decide and apply without lambdas and hooks: (new log, events)."""
    decided = decide(with_current(changes, log), equality)
    return apply_changes(log, decided), audit_events(decided)


def generic_save(changes: DataFrame, log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Type-erased writes: (new log, events).

    Equal values are skipped, and backfills that are not newer than the stored
    audit time; deletions give no events.
    """
    joined = with_current(changes, log)
    stale = F.coalesce(F.col("backfill"), F.lit(False)) & F.col("old_exists") & ~F.coalesce(
        F.col("emit_time") > F.col("old_time"), F.lit(False)
    )
    decided = decide(joined.withColumn("_stale", stale).withColumn("backfill", F.lit(False)))
    decided = decided.withColumn("write", F.col("write") & ~F.col("_stale"))
    events = audit_events(decided).filter(F.col("newValue").isNotNull())
    return apply_changes(log, decided), events


def snapshot_events(decided: DataFrame) -> DataFrame:
    """(urn, aspects): what was written of each urn as one snapshot."""
    one = F.struct("aspect", "value")
    return decided.filter("write").groupBy("urn").agg(F.array_sort(F.collect_list(one)).alias("aspects"))


def add(registry: Registry, aspect: str, changes: DataFrame, log: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The whole write path of one aspect: (new log, events, dead letters).

    Lambdas see the changes first and may alter or drop rows; hooks before and
    after see what is decided.
    """
    good, failed = split_invalid(changes)
    for step in registry.lambdas.get(aspect, []):
        good = step(good)
    decided = decide(with_current(good, log), registry.equality.get(aspect, structural))
    for hook in registry.pre_hooks.get(aspect, []):
        hook(decided)
    events = audit_events(decided)
    out = apply_changes(log, decided)
    for hook in registry.post_hooks.get(aspect, []):
        hook(events)
    return out, events, failed


def folded(changes: DataFrame, order: list[str]) -> DataFrame:
    """Changes whose value differs from the one before it in its key.

    Exact for equality alone: one sort per key.
    """
    own = Window.partitionBy("urn", "aspect").orderBy(*order)
    first = F.row_number().over(own) == 1
    same = F.lag("value").over(own).eqNullSafe(F.col("value"))
    return changes.withColumn("_same", ~first & same).filter(~F.col("_same")).drop("_same")
