"""Relationship queries: find, traverse, history and keyset scans."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import formats
from ..model import Registry
from ..plans.criteria import Cursor, RelCriterion, RelFilter, UrnField, flattened
from ..plans.pages import cut_by_key
from ..plans.predicates import edge_resolver, entity_resolver, rel_predicate
from .aspects import new_ids


class Graph:
    """Entity and edge tables by name, with the registry that describes them."""

    def __init__(self, registry: Registry, entities: dict[str, DataFrame], edges: dict[str, DataFrame]):
        self.registry = registry
        self.entities = entities
        self.edges = edges

    # -- parts ------------------------------------------------------------

    def _entity(self, name: str, alias: str) -> tuple[DataFrame, Column | None]:
        if name not in self.entities:
            raise ValueError(f"no entity table for {name}")
        return self.entities[name].alias(alias)

    def _where(self, name: str | None, alias: str, wanted: RelFilter | None) -> Column | None:
        if wanted is None or wanted.empty:
            return None
        if name is None:
            raise ValueError("a filter needs its entity type")
        entity = self.registry.entities.get(name)
        return rel_predicate(wanted, entity_resolver(entity, self.entities[name], alias))

    def _edge_where(self, edge: str, alias: str, wanted: RelFilter | None) -> Column | None:
        return rel_predicate(wanted, edge_resolver(self.edges[edge], alias))

    # -- entities ---------------------------------------------------------

    def find_entities(self, name: str, wanted: RelFilter = RelFilter(), offset: int = 0, count: int | None = 10) -> DataFrame:
        """Entities by filter, in the order of urns; deleted ones included."""
        rows = self._entity(name, "st")
        where = self._where(name, "st", wanted)
        if where is not None:
            rows = rows.filter(where)
        return cut_by_key(rows, "urn", max(0, offset), None if count is None else max(1, count))

    def find_entities_v2(self, name: str, wanted: RelFilter, offset: int = 0, count: int | None = 10) -> DataFrame:
        """As :meth:`find_entities`, with a logical expression only."""
        if wanted.criteria:
            raise ValueError("only logical expressions are taken")
        return self.find_entities(name, wanted, offset, count)

    def _hop(self, source: str, source_filter, edge: str, edge_filter, destination: str, destination_filter, live: bool = True) -> DataFrame:
        rt = self.edges[edge].alias("rt")
        if live:
            rt = rt.filter(F.col("rt.deleted_ts").isNull())
        joined = rt.join(self._entity(destination, "dt"), F.col("dt.urn") == F.col("rt.destination")).join(
            self._entity(source, "st"), F.col("st.urn") == F.col("rt.source")
        )
        for where in (
            self._edge_where(edge, "rt", edge_filter),
            self._where(destination, "dt", destination_filter),
            self._where(source, "st", source_filter),
        ):
            if where is not None:
                joined = joined.filter(where)
        return joined

    def traverse(
        self,
        source: str,
        source_filter: RelFilter,
        edge: str,
        edge_filter: RelFilter,
        destination: str,
        destination_filter: RelFilter,
        min_hops: int = 1,
        max_hops: int = 1,
        offset: int = 0,
        count: int | None = 10,
        compat: bool = False,
    ) -> DataFrame:
        """Entities one hop away, in the direction of ``edge_filter``.

        Undirected hops need both ends in one table and give both ends of the
        matching edges; ``compat`` ignores paging and the live check there.
        """
        if min_hops != 1 or max_hops != 1:
            raise ValueError("only one hop is supported")
        if edge_filter.direction is None:
            raise ValueError("a direction is required")
        if edge_filter.direction == "UNDIRECTED":
            return self._undirected(source, source_filter, edge, edge_filter, destination, destination_filter, offset, count, compat)
        hop = self._hop(source, source_filter, edge, edge_filter, destination, destination_filter)
        outgoing = edge_filter.direction == "OUTGOING"
        ends = hop.select(F.col("rt.destination" if outgoing else "rt.source").alias("urn"))
        found = self.entities[destination if outgoing else source].join(ends, "urn", "left_semi")
        return cut_by_key(found, "urn", max(0, offset), None if count is None else max(1, count))

    def _undirected(self, source, source_filter, edge, edge_filter, destination, destination_filter, offset, count, compat):
        """First hop both ways, then the entities across any edge from there."""
        if source != destination:
            raise ValueError("undirected hops need one entity type")
        hop = self._hop(source, source_filter, edge, edge_filter, destination, destination_filter)
        ends = hop.select(F.col("rt.source").alias("urn")).union(hop.select(F.col("rt.destination").alias("urn"))).distinct()
        edges = self.edges[edge]
        if not compat:
            edges = edges.filter(F.col("deleted_ts").isNull())
        forth = edges.join(ends, edges["source"] == ends["urn"], "left_semi").select(F.col("destination").alias("urn"))
        back = edges.join(ends, edges["destination"] == ends["urn"], "left_semi").select(F.col("source").alias("urn"))
        found = self.entities[source].join(forth.union(back).distinct(), "urn", "left_semi")
        if compat:
            return found
        return cut_by_key(found, "urn", max(0, offset), None if count is None else max(1, count))

    def traverse_path(self, source: str, source_filter: RelFilter, hops: list[tuple[str, str, RelFilter, RelFilter]]) -> DataFrame:
        """Entities at the end of a list of (edge, entity, edge and entity filter)."""
        now = self._entity(source, "st")
        where = self._where(source, "st", source_filter)
        urns = (now.filter(where) if where is not None else now).select(F.col("st.urn").alias("urn"))
        for edge, entity, edge_filter, entity_filter in hops:
            rt = self.edges[edge].filter(F.col("deleted_ts").isNull()).alias("rt")
            where = self._edge_where(edge, "rt", edge_filter)
            rt = rt.filter(where) if where is not None else rt
            near, far = ("destination", "source") if edge_filter.direction == "INCOMING" else ("source", "destination")
            ends = rt.join(urns.distinct(), F.col(f"rt.{near}") == F.col("urn"), "left_semi").select(F.col(f"rt.{far}").alias("end"))
            dt = self._entity(entity, "dt")
            where = self._where(entity, "dt", entity_filter)
            dt = dt.filter(where) if where is not None else dt
            found = dt.join(ends, F.col("dt.urn") == F.col("end"), "left_semi")
            urns = found.select(F.col("dt.urn").alias("urn"))
        return found.orderBy("urn")

    # -- edges ------------------------------------------------------------

    def _check(self, source, source_filter, destination, destination_filter, edge_filter, logical: bool) -> None:
        filters = [f for f in (source_filter, destination_filter, edge_filter) if f is not None]
        if any((f.criteria if logical else f.logic is not None) for f in filters):
            raise ValueError("only logical expressions are taken" if logical else "only flat criteria are taken")
        for name, wanted in ((source, source_filter), (destination, destination_filter)):
            if name is None and wanted is not None and not wanted.empty:
                raise ValueError("a filter needs its entity type")
        if edge_filter is None or edge_filter.direction is None:
            raise ValueError("a direction is required")

    def _edges(self, source, source_filter, edge, edge_filter, destination, destination_filter, live=True) -> DataFrame:
        rt = self.edges[edge].alias("rt")
        if live:
            rt = rt.filter(F.col("rt.deleted_ts").isNull())
        where = [self._edge_where(edge, "rt", edge_filter)]
        for name, wanted, alias, end in (
            (destination, destination_filter, "dt", "destination"),
            (source, source_filter, "st", "source"),
        ):
            if name is None:
                continue
            if name in self.entities:
                # The joined row only decides; urns are unique in their table.
                table = self._entity(name, alias)
                own = self._where(name, alias, wanted)
                if own is not None:
                    table = table.filter(own)
                rt = rt.join(table, F.col(f"{alias}.urn") == F.col(f"rt.{end}"), "left_semi")
            elif alias == "dt" and wanted is not None and not wanted.empty:
                # No table: at most one condition, on the edge's own column.
                leaves = flattened(wanted.logic) if wanted.logic is not None else list(wanted.criteria)
                if len(leaves) > 1 or not isinstance(leaves[0].field, UrnField):
                    raise ValueError("an end without a table takes one condition on its urn")
                leaf = RelCriterion(UrnField("destination"), leaves[0].condition, leaves[0].value)
                where.append(rel_predicate(RelFilter((leaf,)), edge_resolver(self.edges[edge], "rt")))
        for w in where:
            if w is not None:
                rt = rt.filter(w)
        return rt

    def find_relationships(
        self,
        source: str | None,
        source_filter: RelFilter | None,
        destination: str | None,
        destination_filter: RelFilter | None,
        edge: str,
        edge_filter: RelFilter,
        offset: int = -1,
        count: int = -1,
        history: bool = False,
        subtype: str | None = None,
        rank_last: bool = False,
        logical: bool = False,
    ) -> DataFrame:
        """Edges by filters on both ends and on themselves, by id.

        An end whose type has no table is not joined.  A count of 0 or less is
        no limit.  ``history`` takes deleted edges in and gives the latest of
        each (source[, metadata path ``subtype``], destination); ``rank_last``
        applies the page before that, as the original statement does.
        """
        self._check(source, source_filter, destination, destination_filter, edge_filter, logical)
        rows = self._edges(source, source_filter, edge, edge_filter, destination, destination_filter, live=not history)

        def page(df):
            df = df.orderBy("id")
            if offset > 0:
                df = df.offset(offset)
            return df.limit(count) if count > 0 else df

        if not history:
            return page(rows)
        keys = [F.col("source"), F.col("destination")]
        if subtype:
            keys.append(edge_resolver(self.edges[edge], "rt")(_field(subtype)))
        latest = Window.partitionBy(*keys).orderBy(F.col("lastmodifiedon").desc(), F.col("id").desc())
        if rank_last:
            rows = page(rows)
        ranked = rows.withColumn("_rank", F.row_number().over(latest)).filter(F.col("_rank") == 1).drop("_rank")
        return ranked.orderBy("id") if rank_last else page(ranked)

    def find_relationships_v2(self, source, source_filter, destination, destination_filter, edge, edge_filter, offset=-1, count=-1) -> DataFrame:
        """Ends by type name; an end is joined if its type has a table."""
        return self.find_relationships(source, source_filter, destination, destination_filter, edge, edge_filter, offset, count)

    def find_relationships_v3(self, *args, wrap: str | None = None, **kwargs) -> DataFrame:
        """Edges wrapped as (source, relatedTo); needs the wrapper's name."""
        return wrapped(self.find_relationships(*args, **kwargs), wrap)

    def find_relationships_v4(self, *args, wrap: str | None = None, **kwargs) -> DataFrame:
        """As V3, with logical expressions only."""
        return wrapped(self.find_relationships(*args, logical=True, **kwargs), wrap)

    # -- keyset scans -----------------------------------------------------

    def first_cursor(self, edge: str, now: str) -> Cursor:
        """A cursor at the start: the largest id and the time of the scan."""
        top = self.edges[edge].agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
        return Cursor(edge, 0, int(top), now)

    def scan(
        self,
        cursor: Cursor,
        source: str | None = None,
        source_filter: RelFilter | None = None,
        destination: str | None = None,
        destination_filter: RelFilter | None = None,
        edge_filter: RelFilter = RelFilter(direction="OUTGOING"),
        size: int = formats.KEYSET_PAGE,
        wrap: str | None = None,
        logical: bool = False,
    ) -> tuple[DataFrame, Cursor | None]:
        """A page of edges as they were when the scan began, and the next cursor.

        Edges that were deleted since then still count.  There is a next
        cursor if the page is full and does not end at the last id.
        """
        if not 0 < size <= formats.KEYSET_PAGE:
            raise ValueError(f"a page has 1 to {formats.KEYSET_PAGE} edges")
        edge = cursor.table
        self._check(source, source_filter, destination, destination_filter, edge_filter, logical)
        rows = self._edges(source, source_filter, edge, edge_filter, destination, destination_filter, live=False)
        rows = scan_page(rows, cursor, size)
        page = rows.collect()  # at most ``size``: one job gives the page and where it ends
        following = None
        if len(page) == size and page[-1]["id"] < cursor.max_id:
            following = Cursor(edge, page[-1]["id"], cursor.max_id, cursor.scan_start)
        rows = rows.sparkSession.createDataFrame(page, rows.schema)
        return (wrapped(rows, wrap) if wrap else rows), following

    def scan_pages(
        self,
        cursor: Cursor,
        source: str | None = None,
        source_filter: RelFilter | None = None,
        destination: str | None = None,
        destination_filter: RelFilter | None = None,
        edge_filter: RelFilter = RelFilter(direction="OUTGOING"),
        size: int = formats.KEYSET_PAGE,
    ) -> DataFrame:
        """All pages from ``cursor`` on, as rows with a page number from 0.

        What :meth:`scan` gives page after page, from one pass over the edges:
        rows are sorted by ranges of ids and numbered by the ranges' totals.
        """
        if not 0 < size <= formats.KEYSET_PAGE:
            raise ValueError(f"a page has 1 to {formats.KEYSET_PAGE} edges")
        edge = cursor.table
        self._check(source, source_filter, destination, destination_filter, edge_filter, False)
        rows = self._edges(source, source_filter, edge, edge_filter, destination, destination_filter, live=False)
        rows = seen_by(rows, cursor).withColumnRenamed("id", "_id").withColumn("namespace", F.lit(edge))
        none = rows.limit(0).select("namespace", F.lit(0).cast("long").alias("id"))
        numbered = new_ids(none, rows, ["_id"])
        page = F.floor((F.col("id") - 1) / size).cast("long")
        return numbered.withColumn("page", page).drop("id", "namespace").withColumnRenamed("_id", "id")


def seen_by(edges: DataFrame, cursor: Cursor) -> DataFrame:
    """Edges in (last, max] that were live at the scan's start."""
    start = F.to_timestamp(F.lit(cursor.scan_start), formats.CURSOR_STAMP_FORMAT)
    seen = F.col("deleted_ts").isNull() | (F.col("deleted_ts") > start)
    return edges.filter((F.col("id") > cursor.last_id) & (F.col("id") <= cursor.max_id) & seen)


def scan_page(edges: DataFrame, cursor: Cursor, size: int) -> DataFrame:
    """The first ``size`` of the cursor's edges, by id."""
    return seen_by(edges, cursor).orderBy("id").limit(size)


def _field(path: str):
    from ..plans.criteria import RelationshipField

    return RelationshipField(path)


def wrapped(edges: DataFrame, name: str | None, order: str = "id") -> DataFrame:
    """Edges as {source, relatedTo: {<name>: metadata}}."""
    if not name:
        raise ValueError("wrapping needs the relationship's name")
    label = name[0].lower() + name[1:]
    extra = [order] if order in edges.columns else []
    return edges.select(
        *extra, "source", F.struct(F.col("metadata").alias(label)).alias("relatedTo")
    )


# -- writing edges ------------------------------------------------------------


def edges_of_aspect(rows: DataFrame, schema: T.StructType, fields: list[str], urn: str = "urn", cell: str = "value") -> DataFrame:
    """(source, destination, relationship, metadata) from relationship fields.

    ``fields`` are records or arrays of records of ``schema`` that have a
    destination; null members give no edge.
    """
    value = F.from_json(F.col(cell), schema)
    parts = []
    for name in fields:
        kind = schema[name].dataType
        own = rows.select(F.col(urn).alias("source"), value[name].alias("r"))
        if isinstance(kind, T.ArrayType):
            own = own.withColumn("r", F.explode("r"))
        own = own.filter(F.col("r").isNotNull() & F.col("r.destination").isNotNull())
        parts.append(own.select("source", F.col("r.destination").alias("destination"), F.lit(name).alias("relationship"), F.to_json("r").alias("metadata")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def built_edges(registry: Registry, aspect: str, rows: DataFrame, schema: T.StructType, fields: list[str]) -> DataFrame:
    """Edges from the registered builder; where it gives none, from the aspect."""
    extracted = edges_of_aspect(rows, schema, fields)
    builder = registry.edge_builders.get(aspect)
    if builder is None:
        return extracted
    own = builder(rows)
    rest = extracted.join(own.select("source").distinct(), "source", "left_anti")
    return own.unionByName(rest)


REMOVAL_KEYS = {
    "REMOVE_NONE": None,
    "FROM_SOURCE": ["source"],
    "TO_DESTINATION": ["destination"],
    "FROM_SOURCE_TO_DESTINATION": ["source", "destination"],
}


def replace_edges(live: DataFrame, update: DataFrame, now: Column, option: str = "FROM_SOURCE", same_aspect: bool = False) -> DataFrame:
    """Edges after an update: matching live ones get deleted_ts, new ones join.

    ``update`` has the columns of ``live``; its sources with a null
    destination only clear.  ``same_aspect`` spares edges of other aspects; a
    schema prefix of aspect names does not count.
    """
    keys = REMOVAL_KEYS[option]
    out = live
    if keys:
        plain = lambda c: F.regexp_replace(c, "^" + re.escape(formats.SCHEMA_PREFIX), "")
        own = list(keys)
        marked = update.select(*keys, *([plain("aspect").alias("_a")] if same_aspect else [])).distinct().withColumn("_hit", F.lit(True))
        if same_aspect:
            out = out.withColumn("_a", plain("aspect"))
            own.append("_a")
        out = out.join(marked, own, "left")
        out = out.withColumn(
            "deleted_ts", F.when(F.col("_hit") & F.col("deleted_ts").isNull(), now).otherwise(F.col("deleted_ts"))
        ).select(*live.columns)
    return out.unionByName(update.filter(F.col("destination").isNotNull()))


def mixed_sources(update: DataFrame, group: str) -> DataFrame:
    """Groups whose edges do not all have one source: they must not be written."""
    return update.groupBy(group).agg(F.count_distinct("source").alias("sources")).filter(F.col("sources") > 1)
