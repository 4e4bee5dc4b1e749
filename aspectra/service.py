"""A façade over the operators, in the shape of resource methods."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import formats
from .model import Document, Entity, Registry
from .operators import aspects, browse, index, ingest, search, writes
from .plans.criteria import IndexFilter, IndexSort, Page, SearchCriterion, SearchSort


def routed(local: DataFrame, remote: DataFrame) -> DataFrame:
    """(urn, aspect, value): local values, and those of another service for
    aspects that it owns; its values win where both have one."""
    joined = local.alias("l").join(remote.alias("r"), ["urn", "aspect"], "full_outer")
    return joined.select("urn", "aspect", F.coalesce("r.value", "l.value").alias("value"))


@dataclass
class EntityService:
    """One entity type: its wide table, its log and what is registered."""

    registry: Registry
    entity: Entity
    table: DataFrame
    log: DataFrame
    routes: dict[str, Callable[[DataFrame], DataFrame]] = field(default_factory=dict)
    edges: dict[str, DataFrame] = field(default_factory=dict)
    test: writes.Stored | None = None

    def _names(self, names: list[str] | None) -> list[str]:
        known = [n for n, a in self.entity.aspects.items() if not a.is_urn]
        for n in names or []:
            self.entity.aspect(n)
        return list(names) if names else known

    def batch_get(self, urns: DataFrame, names: list[str] | None = None, include_deleted: bool = False) -> DataFrame:
        """Cells of the named aspects (default all), routed ones included."""
        own = self._names(names)
        here = aspects.get_cells(self.table, self.entity, [n for n in own if n not in self.routes], urns, include_deleted)
        out = here.select("urn", "aspect", "value")
        for n in own:
            if n in self.routes:
                there = self.routes[n](urns).select("urn", F.lit(n).alias("aspect"), "value")
                out = routed(out, there)
        return out

    def get(self, urn: str, names: list[str] | None = None) -> DataFrame:
        one = self.table.sparkSession.createDataFrame([(urn,)], "urn string")
        return self.batch_get(one, names)

    def get_asset(self, urns: DataFrame, names: list[str] | None = None, shadow: DataFrame | None = None) -> DataFrame:
        """One row per urn with a column per aspect, checked against a shadow."""
        own = self._names(names)
        cells = self.batch_get(urns, own)
        if shadow is not None:
            cells = aspects.shadow_read(cells, shadow)
        return cells.groupBy("urn").pivot("aspect", own).agg(F.first("value"))

    def exists(self, urns: DataFrame) -> DataFrame:
        return aspects.exists(self.table, urns)

    def filter(
        self,
        wanted: IndexFilter = IndexFilter(),
        names: list[str] | None = None,
        sort: IndexSort | None = None,
        last_urn: str | None = None,
        count: int = formats.FINDER_COUNT,
    ) -> DataFrame:
        """Urns only where no aspects are named; otherwise their values too."""
        return index.find(self.table, self.entity, wanted, names or [], sort, last_urn, count)

    def filter_page(self, wanted: IndexFilter = IndexFilter(), sort: IndexSort | None = None, start: int = 0, count: int = formats.FINDER_COUNT) -> Page:
        return index.list_urns_page(self.table, self.entity, wanted, sort, start, count)

    def count_aggregate(self, wanted: IndexFilter, aspect: str, path: str) -> DataFrame:
        return index.count_aggregate(self.table, self.entity, wanted, aspect, path)

    def _keep(self, stored: writes.Stored) -> None:
        self.log, self.table, self.edges = stored.log, stored.table, stored.edges

    def ingest(self, aspect: str, changes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(new log, events, dead letters) of changes of one aspect."""
        out = self.ingest_many(changes)
        return out.live.log, out.events, out.failed

    def ingest_many(self, changes: DataFrame) -> writes.Outcome:
        """Writes a batch of any aspects; later calls see what was written."""
        stored = writes.Stored(self.log, self.table, self.edges)
        out = writes.write(self.registry, self.entity, changes, stored, self.test)
        self._keep(out.live)
        self.test = out.test
        return out

    def ingest_asset(self, assets: DataFrame) -> writes.Outcome:
        """Writes assets (urn, at, by, one JSON column per aspect); null columns are not written."""
        names = [n for n in assets.columns if n in self.entity.aspects]
        pairs = F.array(*[F.struct(F.lit(n).alias("aspect"), F.col(n).alias("value")) for n in names])
        rows = assets.select("urn", "at", "by", F.explode(pairs).alias("p")).select("urn", "p.aspect", "p.value", "at", "by")
        return self.ingest_many(rows.filter(F.col("value").isNotNull()))

    def delete_assets(self, urns: DataFrame, at: Column, by: Column) -> DataFrame:
        """Deletes whole assets with their edges; gives the events."""
        stored = writes.Stored(self.log, self.table, self.edges)
        stored, events = writes.delete_assets(self.registry, self.entity, urns, stored, at, by)
        self._keep(stored)
        return events

    def raw_ingest(self, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
        out = ingest.raw_add(changes, self.log)
        self.log = out[0]
        return out

    def backfill(self, names: list[str], mode: str = "BACKFILL_ALL", last_urn: str | None = None, size: int | None = None) -> DataFrame:
        return ingest.backfilled(ingest.backfill_events(self.log, names, mode, last_urn, size))

    def versions(self, aspect: str, urn: str) -> DataFrame:
        return aspects.list_versions(self.log, aspect, urn)


@dataclass
class Services:
    """Dispatch by entity type, for callers that know types by name only."""

    by_type: dict[str, EntityService]

    def of(self, entity_type: str) -> EntityService:
        if entity_type not in self.by_type:
            raise ValueError(f"unknown entity type {entity_type}")
        return self.by_type[entity_type]

    def list_urns(self, entity_type: str, last_urn: str | None = None, count: int = formats.FINDER_COUNT) -> DataFrame:
        return self.of(entity_type).filter(last_urn=last_urn, count=count)

    def backfill(self, urns: DataFrame, names: list[str]) -> DataFrame:
        """Over all types: the aspects found for each urn."""
        out = None
        for name in sorted(self.by_type):
            s = self.by_type[name]
            events = ingest.backfill_events(s.log, names, "BACKFILL_ALL").join(urns.select("urn").distinct(), "urn", "left_semi")
            out = events if out is None else out.unionByName(events)
        return ingest.backfilled(out)


@dataclass
class SearchService:
    """Search and browse over one document table, with entities joined."""

    document: Document
    documents: DataFrame
    entities: EntityService | None = None

    def search(self, text: str, criteria: list[SearchCriterion] = [], sort: SearchSort | None = None, start: int = 0, count: int = 10, version: int = 1) -> search.SearchResult:
        return search.search(self.documents, self.document, text, criteria, sort, start, count, version)

    def with_entities(self, result: search.SearchResult, names: list[str], sort: SearchSort | None = None) -> DataFrame:
        """A page of hits in their order, each with its stored aspects."""
        from pyspark.sql import Window

        if self.entities is None:
            raise ValueError("no entity service")
        ranked = result.hits.select("urn", F.row_number().over(Window.orderBy(*search.order_of(sort))).alias("rank"))
        cells = self.entities.batch_get(ranked, names)
        return search.hits_with_entities(ranked, cells)

    def autocomplete(self, text: str, name: str | None = None, limit: int = 10) -> DataFrame:
        return search.autocomplete(self.documents, self.document, text, name, limit=limit)

    def browse(self, path: str, request: dict[str, str] | None = None, start: int = 0, count: int = 10) -> browse.BrowseResult:
        wanted = browse.request_criteria(self.document, request or {})
        return browse.Browser(self.documents, self.document).browse(path, wanted, start, count)
