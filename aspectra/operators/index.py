"""Secondary-index queries over the wide entity table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import Entity
from ..plans.criteria import IndexCriterion, IndexFilter, IndexSort, Page
from ..plans.predicates import index_predicate
from ..plans.pages import cut
from .aspects import get_cells, page_of


def filtered(table: DataFrame, entity: Entity, wanted: IndexFilter) -> DataFrame:
    """Live rows that meet all criteria."""
    return table.filter(index_predicate(entity, table, wanted))


def sort_order(table: DataFrame, entity: Entity, sort: IndexSort | None) -> list:
    """By urn, or by a path with nulls as MySQL has them and urns for ties.

    Numbers sort as numbers; a path that is not indexed does not sort; arrays
    cannot sort.
    """
    if sort is None:
        return [F.col("urn").asc()]
    kind = entity.aspect(sort.aspect).path_type(sort.path)
    column = entity.indexed(table, sort.aspect, sort.path)
    if column is None:
        return [F.col("urn").asc()]
    if kind == "array":
        raise ValueError("arrays do not sort")
    if kind in ("int", "long"):
        column = column.try_cast("long")
    elif kind in ("float", "double"):
        column = column.try_cast("double")
    return [
        column.desc_nulls_last() if sort.descending else column.asc_nulls_first(),
        F.col("urn").asc(),
    ]


def list_urns(
    table: DataFrame,
    entity: Entity,
    wanted: IndexFilter = IndexFilter(),
    sort: IndexSort | None = None,
    last_urn: str | None = None,
    size: int | None = 10,
) -> DataFrame:
    """Up to ``size`` urns (None: all) after ``last_urn``, which seeks by urn in any order."""
    rows = filtered(table, entity, wanted)
    if last_urn:
        rows = rows.filter(F.col("urn") > F.lit(last_urn))
    return cut(rows, sort_order(table, entity, sort), 0, size).select("urn")


def list_urns_page(
    table: DataFrame,
    entity: Entity,
    wanted: IndexFilter = IndexFilter(),
    sort: IndexSort | None = None,
    start: int = 0,
    size: int = 10,
) -> Page:
    """An offset page of urns with totals; an empty result skips the page."""
    page = page_of(filtered(table, entity, wanted), sort_order(table, entity, sort), start, size)
    page.rows = page.rows.select("urn")
    return page


def list_urns_of_class(table: DataFrame, entity: Entity, urn_aspect: str, last_urn: str | None, size: int) -> DataFrame:
    """Urns of an entity type: a filter with its urn class only."""
    wanted = IndexFilter((IndexCriterion(urn_aspect),))
    return list_urns(table, entity, wanted, None, last_urn, size)


def count_aggregate(table: DataFrame, entity: Entity, wanted: IndexFilter, aspect: str, path: str) -> DataFrame:
    """(value, count) by an indexed path; null counts as "null".

    A path that is not indexed gives an empty result.
    """
    column = entity.indexed(table, aspect, path)
    if column is None:
        return table.sparkSession.createDataFrame([], "value string, count long")
    rows = filtered(table, entity, wanted)
    return rows.groupBy(F.coalesce(column.cast("string"), F.lit("null")).alias("value")).agg(
        F.count(F.lit(1)).alias("count")
    )


def total_count(table: DataFrame, entity: Entity, wanted: IndexFilter) -> int:
    return filtered(table, entity, wanted).count()


def with_total(df: DataFrame) -> DataFrame:
    """Rows with the count of all in ``_total_count``, counted first."""
    return df.withColumn("_total_count", F.lit(df.count()).cast("long"))


def get_aspects(table: DataFrame, entity: Entity, aspects: list[str], urns: DataFrame) -> DataFrame:
    """(position, urn, aspect, value): urns in order, kept without a value too.

    ``urns`` has urn and position.
    """
    cells = get_cells(table, entity, aspects, urns)
    return urns.select("position", "urn").join(cells.select("urn", "aspect", "value"), "urn", "left")


def find(
    table: DataFrame,
    entity: Entity,
    wanted: IndexFilter,
    aspects: list[str],
    sort: IndexSort | None = None,
    last_urn: str | None = None,
    size: int = 10,
) -> DataFrame:
    """Filter, then fetch: one lazy plan.  No aspects: urns only."""
    from pyspark.sql import Window

    urns = list_urns(table, entity, wanted, sort, last_urn, size)
    if not aspects:
        return urns
    order = sort_order(table, entity, sort)
    # A page is at most ``size`` rows, so one task numbers it.
    rows = filtered(table, entity, wanted)
    if last_urn:
        rows = rows.filter(F.col("urn") > F.lit(last_urn))
    page = rows.orderBy(*order).limit(max(size, 0))
    numbered = page.select("urn", (F.row_number().over(Window.orderBy(*order)) - 1).alias("position"))
    return get_aspects(table, entity, aspects, numbered).orderBy("position", "aspect")
