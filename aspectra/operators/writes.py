"""One write path: from a batch of changes to the log, the table and the edges.

A batch may hold many aspects of many urns.  It is checked, decided against
the log with one join, and the decision is written once; the new log, wide
table, edge tables and events are projections of it.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import formats
from ..functions.envelopes import is_marker, marker
from ..model import EdgeFields, Entity, Registry
from ..sources.scratch import written
from . import aspects, graph, ingest


@dataclass
class Stored:
    """What is stored of one entity type: log, wide table, edges by relationship."""

    log: DataFrame
    table: DataFrame | None = None
    edges: dict[str, DataFrame] = field(default_factory=dict)


@dataclass
class Outcome:
    """What a batch led to; ``decided`` has a row per change that was checked."""

    live: Stored
    test: Stored | None
    decided: DataFrame
    events: DataFrame
    failed: DataFrame


# -- checks ---------------------------------------------------------------------


def _failed(rows: DataFrame, why: str) -> DataFrame:
    return rows.withColumn("error", F.lit(why))


def without_repeats(changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(changes, rejected): keys given more than once are rejected as a whole."""
    key = changes.withColumn("_u", F.lower("urn"))
    times = F.count(F.lit(1)).over(Window.partitionBy("_u", "aspect"))
    counted = key.withColumn("_n", times).drop("_u")
    return counted.filter("_n = 1").drop("_n"), _failed(counted.filter("_n > 1").drop("_n"), "aspect given twice")


def with_lambdas(registry: Registry, changes: DataFrame) -> DataFrame:
    """Changes after the lambdas of their aspects, which may alter or drop rows."""
    names = [a for a, steps in registry.lambdas.items() if steps]
    out = changes.filter(~F.col("aspect").isin(names)) if names else changes
    for name in names:
        own = changes.filter(F.col("aspect") == name)
        for step in registry.lambdas[name]:
            own = step(own)
        out = out.unionByName(own)
    return out


def validated(entity: Entity | None, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(changes with defaults, failed) by the schemas of the aspects that have one."""
    value, error = F.col("value"), F.lit(None).cast("string")
    for name, a in (entity.aspects if entity else {}).items():
        if a.schema:
            full, wrong = ingest.with_defaults(F.col("value"), a.schema, a.required, a.defaults)
            own = (F.col("aspect") == name) & F.col("value").isNotNull()
            value, error = F.when(own, full).otherwise(value), F.when(own, wrong).otherwise(error)
    rows = changes.withColumns({"_value": value, "error": error})
    good = rows.filter(F.col("error").isNull()).withColumn("value", F.col("_value")).drop("_value", "error")
    return good, rows.filter(F.col("error").isNotNull()).drop("_value")


def equality_of(registry: Registry) -> ingest.Equality:
    """Each aspect's own equality; the structural one where none is registered."""

    def equal(old: Column, new: Column) -> Column:
        out = ingest.structural(old, new)
        for name, own in registry.equality.items():
            out = F.when(F.col("aspect") == name, own(old, new)).otherwise(out)
        return out

    return equal


# -- what follows from a decision -------------------------------------------------


def retained(registry: Registry, log: DataFrame, writes: DataFrame) -> DataFrame:
    """The log after retention of the keys of ``writes`` (urn, aspect, at).

    By number, the latest version and the largest others stay; by age, rows
    older than the write less the age go.
    """
    if not registry.retention:
        return log
    touched = writes.filter(F.col("aspect").isin(list(registry.retention)))
    marked = log.join(touched.select("urn", "aspect", F.col("at").alias("_at")), ["urn", "aspect"], "left")
    top = F.max("version").over(Window.partitionBy("urn", "aspect"))
    marked = marked.withColumn("_top", top)
    gone = F.lit(False)
    for name, rule in registry.retention.items():
        if rule.versions is not None:
            old = (F.col("version") != formats.LATEST_VERSION) & (F.col("version") <= F.col("_top") - rule.versions + 1)
        else:
            old = F.col("createdon") < F.col("_at") - F.lit(rule.age)
        gone = gone | ((F.col("aspect") == name) & F.col("_at").isNotNull() & old)
    return marked.filter(~F.coalesce(gone, F.lit(False))).select(*log.columns)


def cells_of(entity: Entity, writes: DataFrame) -> DataFrame:
    """(urn, column, cell, at, by): written values in their envelopes, or markers."""
    known = {name: a.column for name, a in entity.aspects.items() if not a.is_urn}
    rows = writes.filter(F.col("aspect").isin(list(known)))
    place = F.element_at(F.create_map(*[F.lit(x) for pair in known.items() for x in pair]), F.col("aspect"))
    rest = F.struct(
        F.col("aspect").alias("canonicalName"),
        F.date_format("at", formats.STAMP_FORMAT).alias("lastmodifiedon"),
        F.col("by").alias("lastmodifiedby"),
    )
    envelope = F.concat(F.lit('{"aspect":'), F.col("value"), F.lit(","), F.substring(F.to_json(rest), 2, 1 << 30))
    cell = F.when(F.col("value").isNull(), marker(F.col("at"), F.col("by"))).otherwise(envelope)
    return rows.select("urn", place.alias("column"), cell.alias("cell"), "at", "by")


def edge_rows(edges: DataFrame, relationship: str, found: DataFrame, aspect: str) -> DataFrame:
    """Found edges (source, destination, metadata, at, by) with the columns of ``edges``.

    Ids continue those of ``edges``; indexed paths are taken from the metadata.
    """
    kind = lambda c: F.element_at(F.split(c, ":"), 3)
    rows = found.withColumns(
        {
            "source_type": kind(F.col("source")),
            "destination_type": kind(F.col("destination")),
            "lastmodifiedon": F.col("at"),
            "lastmodifiedby": F.col("by"),
            "aspect": F.lit(aspect),
        }
    )
    if "id" in edges.columns:
        numbered = edges.select(F.lit(relationship).alias("namespace"), "id")
        own = rows.filter(F.col("destination").isNotNull()).withColumn("namespace", F.lit(relationship))
        own = aspects.new_ids(numbered, own, ["source", "destination"]).drop("namespace")
        rows = own.unionByName(rows.filter(F.col("destination").isNull()).withColumn("id", F.lit(None).cast("long")))
    out = []
    for c in edges.schema:
        prefix = formats.metadata_column("/") + "$"
        if c.name in rows.columns:
            out.append(F.col(c.name).cast(c.dataType).alias(c.name))
        elif c.name.startswith(prefix):
            out.append(F.get_json_object("metadata", "$." + c.name.removeprefix(prefix)).cast(c.dataType).alias(c.name))
        else:
            out.append(F.lit(None).cast(c.dataType).alias(c.name))
    return rows.select(*out)


def found_edges(registry: Registry, aspect: str, own: EdgeFields, rows: DataFrame) -> DataFrame:
    """(source, destination, relationship, metadata) of rows (urn, value) of an aspect."""
    schema = T.DataType.fromDDL(own.schema)
    return graph.built_edges(registry, aspect, rows, schema, list(own.fields))


def with_edges(registry: Registry, stored: dict[str, DataFrame], writes: DataFrame, now: Column) -> dict[str, DataFrame]:
    """The edge tables after the writes: each aspect's edges are replaced as a whole.

    A null value only clears.  Edges of other aspects stay.
    """
    out = dict(stored)
    for aspect, own in registry.edge_fields.items():
        rows = writes.filter(F.col("aspect") == aspect)
        stamps = rows.select(F.col("urn").alias("source"), "at", "by")
        found = found_edges(registry, aspect, own, rows.filter(F.col("value").isNotNull()).select("urn", "value"))
        for name, relationship in own.fields.items():
            if relationship not in out:
                continue
            edges = out[relationship]
            new = found.filter(F.col("relationship") == name).join(stamps, "source")
            clear = stamps.select("source", F.lit(None).cast("string").alias("destination"), F.lit(None).cast("string").alias("metadata"), "at", "by")
            update = edge_rows(edges, relationship, new.select(*clear.columns).unionByName(clear), aspect)
            out[relationship] = graph.replace_edges(edges, update, now, own.removal, same_aspect=True)
    return out


def edges_from_log(registry: Registry, log: DataFrame, edges: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Edge tables filled from the latest values of the log, for a backfill."""
    now = log.filter((F.col("version") == formats.LATEST_VERSION) & ~is_marker(F.col("metadata")))
    rows = now.select("urn", "aspect", F.col("metadata").alias("value"), F.col("createdon").alias("at"), F.col("createdby").alias("by"))
    return with_edges(registry, edges, rows, F.current_timestamp())


# -- the write ----------------------------------------------------------------------


def _apply(registry: Registry, entity: Entity | None, rows: DataFrame, stored: Stored, now: Column) -> tuple[Stored, DataFrame]:
    decided = ingest.decide(ingest.with_current(rows, stored.log), equality_of(registry))
    decided = written(decided, "decided")
    writes = decided.filter("write").select("urn", "aspect", "value", "at", "by")
    log = retained(registry, ingest.apply_changes(stored.log, decided), writes)
    table = stored.table
    if table is not None and entity is not None:
        table = ingest.upsert_cells(table, cells_of(entity, writes), entity)
    return Stored(log, table, with_edges(registry, stored.edges, writes, now)), decided


def write(
    registry: Registry,
    entity: Entity | None,
    changes: DataFrame,
    stored: Stored,
    test: Stored | None = None,
    now: Column | None = None,
    always: bool = False,
) -> Outcome:
    """The whole write of a batch of changes (urn, aspect, value, at, by, ...).

    In order: malformed urns and keys given twice are rejected; lambdas;
    validation and defaults; hooks before; the decision; log, retention, wide
    table and edges; events; hooks after.  A urn with a change in test mode is
    written to ``test`` as a whole, without events.  ``always`` emits events
    for changes that were not written as well.
    """
    now = F.current_timestamp() if now is None else now
    good, failed = ingest.split_invalid(ingest.complete(changes))
    good, again = without_repeats(good)
    good, wrong = validated(entity, with_lambdas(registry, good))
    failed = failed.unionByName(again).unionByName(wrong.select(*failed.columns))
    if test is not None:
        tested = F.max(F.coalesce("test_mode", F.lit(False))).over(Window.partitionBy(F.lower("urn")))
        good = written(good.withColumn("_test", tested), "batch")
        test, _ = _apply(registry, entity, good.filter("_test").drop("_test"), test, now)
        good = good.filter("NOT _test").drop("_test")
    for name, hooks in registry.pre_hooks.items():
        for hook in hooks:
            hook(good.filter(F.col("aspect") == name))
    live, decided = _apply(registry, entity, good, stored, now)
    events = ingest.audit_events(decided, always)
    for name, hooks in registry.post_hooks.items():
        for hook in hooks:
            hook(events.filter(F.col("aspect") == name))
    return Outcome(live, test, decided, events, failed)


def delete_assets(registry: Registry, entity: Entity, urns: DataFrame, stored: Stored, at: Column, by: Column) -> tuple[Stored, DataFrame]:
    """(stored, events) after whole assets are deleted, their edges with them.

    Each aspect yields two events, one for itself and one for DELETE_ALL.
    """
    changes, _, events = ingest.delete_all(stored.log, stored.table, urns, at, by)
    out = write(registry, entity, changes, stored, now=at)
    hit = urns.select("urn").distinct().withColumn("_hit", F.lit(True))
    table = out.live.table.join(hit, "urn", "left")
    table = table.withColumn("deleted_ts", F.when(F.col("_hit"), at).otherwise(F.col("deleted_ts"))).drop("_hit")
    return Stored(out.live.log, table.select(*stored.table.columns), out.live.edges), events
