"""Filters, sorts, pages and cursors as plain values."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from enum import Enum
from typing import Union

from pyspark.sql import DataFrame

from .. import formats


class Condition(Enum):
    CONTAIN = "CONTAIN"
    END_WITH = "END_WITH"
    EQUAL = "EQUAL"
    GREATER_THAN = "GREATER_THAN"
    GREATER_THAN_OR_EQUAL_TO = "GREATER_THAN_OR_EQUAL_TO"
    IN = "IN"
    LESS_THAN = "LESS_THAN"
    LESS_THAN_OR_EQUAL_TO = "LESS_THAN_OR_EQUAL_TO"
    START_WITH = "START_WITH"
    ARRAY_CONTAINS = "ARRAY_CONTAINS"


#: Conditions that order values.
RANGES = {
    Condition.GREATER_THAN: "gt",
    Condition.GREATER_THAN_OR_EQUAL_TO: "ge",
    Condition.LESS_THAN: "lt",
    Condition.LESS_THAN_OR_EQUAL_TO: "le",
}

Value = Union[str, bool, int, float, list]


# -- secondary index ----------------------------------------------------------


@dataclass(frozen=True)
class IndexCriterion:
    """A condition on an aspect's path, or (without path) its presence."""

    aspect: str
    path: str | None = None
    condition: Condition = Condition.EQUAL
    value: Value | None = None


@dataclass(frozen=True)
class IndexFilter:
    """Criteria that must all hold."""

    criteria: tuple[IndexCriterion, ...] = ()


@dataclass(frozen=True)
class IndexSort:
    aspect: str
    path: str
    descending: bool = False


# -- relationships ------------------------------------------------------------


@dataclass(frozen=True)
class UrnField:
    name: str = "urn"


@dataclass(frozen=True)
class AspectField:
    aspect: str
    path: str


@dataclass(frozen=True)
class RelationshipField:
    path: str


@dataclass(frozen=True)
class RelCriterion:
    """A condition on a real column, an aspect's path or edge metadata."""

    field: UrnField | AspectField | RelationshipField
    condition: Condition
    value: str | list


@dataclass(frozen=True)
class Logic:
    """AND and OR of two or more, NOT of one criterion."""

    op: str
    children: tuple[Logic | RelCriterion, ...]


@dataclass(frozen=True)
class RelFilter:
    """Either flat criteria or a logical expression; a direction for edges."""

    criteria: tuple[RelCriterion, ...] = ()
    logic: Logic | RelCriterion | None = None
    direction: str | None = None

    def __post_init__(self):
        if self.criteria and self.logic is not None:
            raise ValueError("a filter has criteria or a logical expression, not both")
        if self.direction not in (None, "OUTGOING", "INCOMING", "UNDIRECTED"):
            raise ValueError(f"unknown direction {self.direction}")

    @property
    def empty(self) -> bool:
        return not self.criteria and self.logic is None


def normalised(criteria: tuple[RelCriterion, ...]) -> Logic | RelCriterion | None:
    """Flat criteria as a tree: same field OR, different fields AND."""
    by_field: dict[object, list[RelCriterion]] = {}
    for c in criteria:
        by_field.setdefault(c.field, []).append(c)
    groups = [g[0] if len(g) == 1 else Logic("OR", tuple(g)) for g in by_field.values()]
    if not groups:
        return None
    return groups[0] if len(groups) == 1 else Logic("AND", tuple(groups))


def flattened(tree: Logic | RelCriterion | None) -> list[RelCriterion]:
    """The leaves of a tree from left to right."""
    if tree is None:
        return []
    if isinstance(tree, RelCriterion):
        return [tree]
    return [leaf for child in tree.children for leaf in flattened(child)]


# -- search -------------------------------------------------------------------


@dataclass(frozen=True)
class SearchCriterion:
    field: str
    value: str
    condition: Condition = Condition.EQUAL


@dataclass(frozen=True)
class SearchSort:
    field: str
    descending: bool = False


# -- pages --------------------------------------------------------------------


def page_count(total: int, size: int) -> int:
    """Pages of ``size`` in ``total``; no size, no pages."""
    return -(-total // size) if size > 0 else 0


def has_more(start: int, size: int, pages: int) -> bool:
    """Whether a page follows the one that begins at ``start``."""
    return size > 0 and (start + size) // size < pages


@dataclass
class Page:
    """A page of a result and what is known about the rest."""

    rows: DataFrame
    start: int
    size: int
    total: int
    returned: int
    next_start: int = field(init=False)
    more: bool = field(init=False)
    pages: int = field(init=False)

    NONE = -1

    def __post_init__(self):
        size = self.size or formats.PAGE_SIZE_WHEN_ZERO
        if self.start + self.returned > self.total:
            raise ValueError("the page holds rows beyond the total")
        self.pages = page_count(self.total, size)
        self.more = self.start + self.returned < self.total
        self.next_start = self.start + self.returned if self.more else self.NONE


@dataclass(frozen=True)
class Cursor:
    """Where a keyset scan over edges stands."""

    table: str
    last_id: int
    max_id: int
    scan_start: str

    def __post_init__(self):
        if self.last_id < 0 or self.max_id < 0:
            raise ValueError("cursor ids must not be negative")
        if self.last_id > self.max_id:
            raise ValueError("the cursor is beyond its end")
        if not re.fullmatch(r"\d{4}-\d\d-\d\d \d\d:\d\d:\d\d\.\d{6}", self.scan_start):
            raise ValueError("the scan start needs six fractional digits")
