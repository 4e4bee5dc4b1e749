"""Three filter dialects as column expressions.

They differ on purpose.  The index dialect compares numbers as numbers, the
relationship dialect compares everything as text, and the search dialect takes
wildcard characters literally.
"""

from __future__ import annotations

import operator
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import formats
from ..functions.envelopes import is_live
from ..model import Entity
from .criteria import (
    RANGES,
    AspectField,
    Condition,
    IndexFilter,
    Logic,
    RelCriterion,
    RelFilter,
    RelationshipField,
    SearchCriterion,
    UrnField,
    normalised,
)


def both(columns: list[Column]) -> Column:
    """All hold; true for none."""
    return reduce(operator.and_, columns) if columns else F.lit(True)


# -- index dialect ------------------------------------------------------------


def index_condition(column: Column, condition: Condition, value) -> Column:
    """A condition on the text of an indexed path."""
    numeric = isinstance(value, (int, float)) and not isinstance(value, bool)
    if condition is Condition.EQUAL:
        if isinstance(value, bool):
            return column == F.lit(str(value).lower())
        if numeric:
            return column.try_cast("double") == F.lit(float(value))
        if isinstance(value, list):
            members = F.array(*[F.lit(str(v)) for v in value]) if value else F.array().cast("array<string>")
            return F.from_json(column, "array<string>") == members
        return column == F.lit(value)
    if condition is Condition.IN:
        if not isinstance(value, list) or not value:
            raise ValueError("IN needs a list that is not empty")
        return column.isin(*[str(v) for v in value])
    if condition is Condition.START_WITH:
        return column.like(f"{value}%")
    if condition is Condition.END_WITH:
        return column.like(f"%{value}")
    if condition in RANGES:
        if not numeric:
            raise ValueError("ranges compare numbers")
        return getattr(operator, RANGES[condition])(column.try_cast("double"), F.lit(float(value)))
    if condition is Condition.CONTAIN:
        # Some string member is like the value; a plain string is one member.
        members = F.coalesce(F.from_json(column, "array<string>"), F.array(column))
        return F.exists(members, lambda m: m.like(str(value)))
    if condition is Condition.ARRAY_CONTAINS:
        if isinstance(value, list):
            raise ValueError("ARRAY_CONTAINS takes one member")
        kind = "double" if numeric else "boolean" if isinstance(value, bool) else "string"
        members = F.from_json(column, f"array<{kind}>")
        return F.coalesce(F.array_contains(members, F.lit(float(value) if numeric else value)), F.lit(False))
    raise ValueError(f"unsupported condition {condition}")


def index_predicate(entity: Entity, df: DataFrame, wanted: IndexFilter) -> Column:
    """All criteria and the live check of the row.

    A criterion without path asks for the aspect's presence.  A criterion on a
    path that is not indexed asks for that as well, and for nothing else.
    """
    out: list[Column] = []
    for c in wanted.criteria:
        aspect = entity.aspect(c.aspect)
        column = entity.indexed(df, c.aspect, c.path) if c.path else None
        if column is not None:
            out.append(index_condition(column, c.condition, c.value))
        elif not aspect.is_urn and aspect.column in df.columns:
            out.append(is_live(F.col(aspect.column)))
    if "deleted_ts" in df.columns:
        out.append(F.col("deleted_ts").isNull())
    return both(out)


# -- relationship dialect -----------------------------------------------------

#: Conditions of filters on edges and their ends.
REL_CONDITIONS = {Condition.EQUAL, Condition.IN, Condition.START_WITH, *RANGES}


def rel_condition(column: Column, condition: Condition, value) -> Column:
    """A condition on text: values are always compared as strings."""
    text = column.cast("string")
    if condition not in REL_CONDITIONS:
        raise ValueError(f"unsupported condition {condition}")
    if condition is Condition.IN:
        if not isinstance(value, list) or not value:
            raise ValueError("IN needs a list that is not empty")
        return text.isin(*[str(v) for v in value])
    if isinstance(value, list):
        raise ValueError(f"{condition.name} takes one value")
    if condition is Condition.START_WITH:
        return text.like(f"{value}%")
    if condition is Condition.EQUAL:
        return text == F.lit(str(value))
    return getattr(operator, RANGES[condition])(text, F.lit(str(value)))


Resolve = Callable[[UrnField | AspectField | RelationshipField], Column]


def logic_column(tree: Logic | RelCriterion, resolve: Resolve) -> Column:
    """A tree as one column."""
    if isinstance(tree, RelCriterion):
        return rel_condition(resolve(tree.field), tree.condition, tree.value)
    if tree.op in ("AND", "OR"):
        if len(tree.children) < 2:
            raise ValueError(f"{tree.op} needs two or more")
        parts = [logic_column(c, resolve) for c in tree.children]
        return reduce(operator.and_ if tree.op == "AND" else operator.or_, parts)
    if tree.op == "NOT":
        if len(tree.children) != 1 or not isinstance(tree.children[0], RelCriterion):
            raise ValueError("NOT takes one criterion")
        return ~logic_column(tree.children[0], resolve)
    raise ValueError(f"unknown operator {tree.op}")


def rel_predicate(wanted: RelFilter | None, resolve: Resolve) -> Column | None:
    """A filter as a column; None where it is empty."""
    if wanted is None or wanted.empty:
        return None
    tree = wanted.logic if wanted.logic is not None else normalised(wanted.criteria)
    return logic_column(tree, resolve)


def entity_resolver(entity: Entity | None, df: DataFrame, alias: str) -> Resolve:
    """Fields of an entity table: real columns and indexed aspect paths."""

    def resolve(f):
        if isinstance(f, UrnField):
            return F.col(f"{alias}.{f.name}")
        if isinstance(f, AspectField):
            if entity is None:
                raise ValueError("an aspect field needs an entity type")
            if entity.indexed(df, f.aspect, f.path) is None:
                raise ValueError(f"{f.path} of {f.aspect} is not indexed")
            a = entity.aspect(f.aspect)
            for separator in (entity.separator, "$", "0"):
                name = formats.index_column(a.alias, f.path, separator)
                if name in df.columns:
                    return F.col(f"{alias}.`{name}`")
            inner = ".".join(formats.path_segments(f.path))
            return F.get_json_object(F.col(f"{alias}.{a.column}"), f"$.aspect.{inner}")
        raise ValueError("edge fields belong to relationship filters")

    return resolve


def edge_resolver(df: DataFrame, alias: str) -> Resolve:
    """Fields of an edge table: real columns and metadata paths."""

    def resolve(f):
        if isinstance(f, UrnField):
            return F.col(f"{alias}.{f.name}")
        if isinstance(f, RelationshipField):
            name = formats.metadata_column(f.path)
            if name in df.columns:
                return F.col(f"{alias}.`{name}`")
            inner = ".".join(formats.path_segments(f.path))
            return F.get_json_object(F.col(f"{alias}.metadata"), f"$.{inner}")
        raise ValueError("aspect fields belong to entity filters")

    return resolve


# -- search dialect -----------------------------------------------------------


def value_list(value: str) -> list[str]:
    """A filter value's alternatives: split at commas, unless it is a urn."""
    text = value.strip()
    if text.startswith(formats.URN_PREFIX):
        return [text]
    return [p for p in (x.strip() for x in text.split(",")) if p]


def _is_array(df: DataFrame, name: str) -> bool:
    return df.schema[name].dataType.typeName() == "array"


def search_condition(df: DataFrame, c: SearchCriterion, analysed: bool = False) -> Column | None:
    """A search criterion; None where its value is blank.

    ``analysed``: EQUAL matches any lower-cased token, as a search's own
    filters do; otherwise it compares whole values.
    """
    if c.field not in df.columns:
        raise ValueError(f"no field {c.field}")
    if not c.value.strip():
        return None
    column, array = F.col(c.field), _is_array(df, c.field)
    each = (lambda test: F.exists(column, test)) if array else (lambda test: test(column.cast("string")))
    text = c.value.strip()
    if c.condition is Condition.EQUAL:
        values = value_list(c.value)
        if analysed:
            wanted = sorted({t for v in values for t in v.lower().split()})
            tokens = F.array(*[F.lit(t) for t in wanted])
            return each(lambda x: F.arrays_overlap(F.split(F.lower(x), r"\s+"), tokens))
        return each(lambda x: x.isin(*values))
    if c.condition in RANGES:
        compare = getattr(operator, RANGES[c.condition])
        if array:
            return each(lambda x: compare(x, F.lit(text)))
        kind = df.schema[c.field].dataType.simpleString()
        return compare(column, F.lit(text).cast(kind))
    if c.condition is Condition.CONTAIN:
        return each(lambda x: x.contains(text))
    if c.condition is Condition.START_WITH:
        return each(lambda x: x.startswith(text))
    if c.condition is Condition.END_WITH:
        return each(lambda x: x.endswith(text))
    raise ValueError(f"unsupported condition {c.condition}")


def search_predicate(df: DataFrame, criteria: list[SearchCriterion], analysed: bool = False) -> Column:
    parts = [search_condition(df, c, analysed) for c in criteria]
    return both([p for p in parts if p is not None])
