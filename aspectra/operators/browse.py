"""Hierarchical browse: groups below a path and the entities on it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import formats
from ..model import Document
from ..plans.criteria import SearchCriterion
from ..plans.predicates import search_predicate
from .search import path_hierarchy


def depth(path: str) -> int:
    """Slashes of a normal path: the root has none."""
    return normal(path).count("/")


def normal(path: str) -> str:
    """Lower-cased, one slash in front, none behind; the root is empty."""
    inner = path.strip().strip("/").lower()
    return f"/{inner}" if inner else ""


def _tokens(doc: Document) -> Column:
    """All paths above and including each of a document's paths."""
    paths = F.filter(F.coalesce(F.col(doc.path_field), F.array().cast("array<string>")), lambda p: p.isNotNull())
    return F.array_distinct(F.flatten(F.transform(paths, path_hierarchy)))


def _slashes(path: Column) -> Column:
    return F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit("")))


def _visible(df: DataFrame, criteria: list[SearchCriterion]) -> DataFrame:
    rows = df
    if "removed" in df.columns:
        rows = rows.filter(~F.coalesce("removed", F.lit(False)))
    return rows.filter(search_predicate(rows, criteria))


def request_criteria(doc: Document, request: dict[str, str]) -> list[SearchCriterion]:
    """EQUAL criteria of a request map; fields the document lacks are ignored."""
    known = set(doc.fields) | set(doc.facets)
    return [SearchCriterion(k, v) for k, v in request.items() if k in known]


def groups(df: DataFrame, doc: Document, path: str, criteria: list[SearchCriterion] = []) -> DataFrame:
    """(name, count) of the groups one level below ``path``, rarest first.

    A document counts in every group that holds one of its longer paths.
    """
    at = normal(path)
    level = depth(path) + 1
    rows = _visible(df, criteria).select("urn", F.explode(_tokens(doc)).alias("token"))
    deeper = rows.filter(F.col("token").startswith(at + "/") & (_slashes(F.col("token")) == level + 1))
    parents = deeper.select("urn", F.substring_index("token", "/", level + 1).alias("group")).distinct()
    return (
        parents.groupBy("group")
        .agg(F.count(F.lit(1)).alias("count"))
        .select(F.element_at(F.split("group", "/"), -1).alias("name"), "count")
        .orderBy("count", "name")
    )


def entities(df: DataFrame, doc: Document, path: str, criteria: list[SearchCriterion] = []) -> DataFrame:
    """(urn, name) of documents directly on ``path``, by urn."""
    at, level = normal(path), depth(path) + 1
    paths = F.filter(
        F.coalesce(F.col(doc.path_field), F.array().cast("array<string>")),
        lambda p: (_slashes(p) == level) & F.lower(p).startswith(at + "/"),
    )
    rows = _visible(df, criteria).withColumn("_p", paths).filter(F.size("_p") > 0)
    return rows.select("urn", F.element_at(F.split(F.element_at("_p", 1), "/"), -1).alias("name")).orderBy("urn")


@dataclass
class BrowseResult:
    """A page of entities below the groups of a path, with totals."""

    path: str
    groups: DataFrame
    entities: DataFrame
    num_groups: int
    num_entities: int
    returned: int

    @property
    def total(self) -> int:
        return self.num_groups + self.num_entities


class Browser:
    """Browsing over one document table, with a cache of shallow groups."""

    def __init__(self, df: DataFrame, doc: Document):
        self.df, self.doc = df, doc
        self.cache: dict[str, DataFrame] = {}

    def groups(self, path: str, criteria: list[SearchCriterion] = []) -> DataFrame:
        at = normal(path)
        if criteria or depth(path) > formats.BROWSE_CACHE_DEPTH:
            return groups(self.df, self.doc, path, criteria)
        if at not in self.cache:
            if len(self.cache) >= formats.BROWSE_CACHE_ENTRIES:
                self.cache.pop(next(iter(self.cache))).unpersist()
            self.cache[at] = groups(self.df, self.doc, path).cache()
        return self.cache[at]

    def refresh(self) -> None:
        for df in self.cache.values():
            df.unpersist()
        self.cache.clear()

    def browse(self, path: str, criteria: list[SearchCriterion] = [], start: int = 0, size: int = 10) -> BrowseResult:
        own = self.groups(path, criteria)
        rows = entities(self.df, self.doc, path, criteria)
        total = rows.count()
        page = rows.offset(max(0, start)).limit(max(0, size))
        return BrowseResult(normal(path), own, page, own.count(), total, max(0, min(size, total - start)))

    def paths_of(self, urn: str) -> DataFrame:
        """The browse paths of one document, or none."""
        return self.df.filter(F.col("urn") == urn).select(F.explode(self.doc.path_field).alias("path"))
