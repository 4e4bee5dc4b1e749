"""The registry: entity types, aspects, indexed paths, edges and documents.

What the catalogue of a database would answer (does this column exist, is
there an entity table for this type) is answered here at plan time.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import formats

#: Types that a path may have; they decide how values are compared and sorted.
PATH_TYPES = ("string", "boolean", "enum", "int", "long", "float", "double", "array")


@dataclass(frozen=True)
class Aspect:
    """An aspect of an entity: its column alias and its indexed paths."""

    alias: str
    paths: dict[str, str] = field(default_factory=dict)
    expressions: dict[str, Callable[[Column], Column]] = field(default_factory=dict)
    is_urn: bool = False
    required: tuple[str, ...] = ()
    defaults: dict[str, object] = field(default_factory=dict)
    schema: str = ""

    def __post_init__(self):
        for path, kind in self.paths.items():
            if kind not in PATH_TYPES:
                raise ValueError(f"path {path} has unknown type {kind}")

    @property
    def column(self) -> str:
        return formats.aspect_column(self.alias)

    def path_type(self, path: str) -> str | None:
        own = "/".join(formats.path_segments(path))
        for known, kind in self.paths.items():
            if "/".join(formats.path_segments(known)) == own:
                return kind
        if own in {"/".join(formats.path_segments(p)) for p in self.expressions}:
            return "string"
        return None


@dataclass(frozen=True)
class Entity:
    """An entity type and its aspects by name."""

    name: str
    aspects: dict[str, Aspect]
    separator: str = "$"

    def aspect(self, name: str) -> Aspect:
        if name not in self.aspects:
            raise ValueError(f"{name} is no aspect of {self.name}")
        return self.aspects[name]

    def materialised(self, columns: list[str]) -> dict[str, tuple[str, str]]:
        """column -> (cell column, JSON path) of the paths that are among ``columns``."""
        out = {}
        for a in self.aspects.values():
            for path in a.paths:
                inner = formats.path_segments(path)
                where = f"$['/{'/'.join(inner)}']" if a.is_urn else f"$.aspect.{'.'.join(inner)}"
                for separator in (self.separator, "$", "0"):
                    name = formats.index_column(a.alias, path, separator)
                    if name in columns:
                        out[name] = (a.column, where)
        return out

    def indexed(self, df: DataFrame, aspect: str, path: str) -> Column | None:
        """The column of an indexed path, or None where it is not indexed.

        Materialised columns are preferred: filters on them reach the scan.
        """
        a = self.aspect(aspect)
        if a.path_type(path) is None:
            return None
        own = "/".join(formats.path_segments(path))
        for known, build in a.expressions.items():
            if "/".join(formats.path_segments(known)) == own:
                return build(F.col(a.column))
        for separator in (self.separator, "$", "0"):
            name = formats.index_column(a.alias, path, separator)
            if name in df.columns:
                return F.col(f"`{name}`")
        if a.column not in df.columns:
            return None
        if a.is_urn:
            return F.get_json_object(a.column, f"$['/{own}']")
        inner = ".".join(formats.path_segments(path))
        return F.get_json_object(a.column, f"$.aspect.{inner}")


@dataclass(frozen=True)
class Relationship:
    """A relationship: its name, metadata paths and version.

    Version 1 edges name both ends in the record; version 2 edges have a
    destination only, and the source is supplied.
    """

    name: str
    paths: tuple[str, ...] = ()
    version: int = 1

    def __post_init__(self):
        if self.version not in (1, 2):
            raise ValueError("a relationship has version 1 or 2")


@dataclass(frozen=True)
class EdgeFields:
    """The relationship fields of an aspect: its schema, and field -> relationship."""

    schema: str
    fields: dict[str, str]
    removal: str = "FROM_SOURCE"


@dataclass(frozen=True)
class Retention:
    """What stays of an aspect's versions: at most so many, or none above an age."""

    versions: int | None = None
    age: dt.timedelta | None = None

    def __post_init__(self):
        if (self.versions is None) == (self.age is None):
            raise ValueError("give the versions or the age")
        if self.versions is not None and self.versions < 1:
            raise ValueError("at least one version stays")


@dataclass(frozen=True)
class Document:
    """A search document: facets, low-cardinality fields, weights and so on."""

    name: str
    facets: tuple[str, ...] = ()
    low_cardinality: tuple[str, ...] = ()
    boosts: dict[str, float] = field(default_factory=dict)
    highlighted: tuple[str, ...] = ()
    fields: tuple[str, ...] = ()
    path_field: str = "browsePaths"
    default_autocomplete: str = ""

    @property
    def index_name(self) -> str:
        return self.name.lower()


class Registry:
    """Everything that plans need to know about the data."""

    def __init__(self):
        self.entities: dict[str, Entity] = {}
        self.relationships: dict[str, Relationship] = {}
        self.documents: dict[str, Document] = {}
        self.equality: dict[str, Callable[[Column, Column], Column]] = {}
        self.lambdas: dict[str, list[Callable[[DataFrame], DataFrame]]] = {}
        self.pre_hooks: dict[str, list[Callable[[DataFrame], None]]] = {}
        self.post_hooks: dict[str, list[Callable[[DataFrame], None]]] = {}
        self.retention: dict[str, Retention] = {}
        self.edge_fields: dict[str, EdgeFields] = {}
        self.edge_builders: dict[str, Callable[[DataFrame], DataFrame]] = {}
        self.urn_paths: dict[str, Callable[[Column], dict[str, Column]]] = {}

    def add(self, thing: Entity | Relationship | Document) -> Registry:
        place = {
            Entity: self.entities,
            Relationship: self.relationships,
            Document: self.documents,
        }[type(thing)]
        place[thing.name] = thing
        return self

    def entity(self, name: str) -> Entity:
        if name not in self.entities:
            raise ValueError(f"unknown entity type {name}")
        return self.entities[name]

    def is_entity(self, name: str) -> bool:
        return name in self.entities

    def entity_types(self) -> list[str]:
        """All entity types, in order."""
        return sorted(self.entities)
