"""Stored formats: names and constants that data written elsewhere relies on."""

from __future__ import annotations

# Fixed values of the stored formats.
URN_PREFIX = "urn:li:"
DELETED_FLAG = "gma_deleted"
DELETED_TIME = "deleted_timestamp"
DELETED_BY = "deleted_by"
ASPECT_PREFIX = "a_"
INDEX_PREFIX = "i_"
EXPRESSION_PREFIX = "e_"
ENTITY_TABLE_PREFIX = "metadata_entity_"
EDGE_TABLE_PREFIX = "metadata_relationship_"
LOG_TABLE = "metadata_aspect"
TEST_SUFFIX = "_test"
SCHEMA_PREFIX = "pegasus."
LATEST_VERSION = 0
STAMP_FORMAT = "yyyy-MM-dd HH:mm:ss.SSS"
CURSOR_STAMP_FORMAT = "yyyy-MM-dd HH:mm:ss.SSSSSS"
TOPIC_PATTERN = "%EVENT%_%ENTITY%_%ASPECT%"

# Fixed limits of the query interface.
KEYS_PER_STATEMENT = 50
PAGE_SIZE_WHEN_ZERO = 1000
BATCH_DELETE_URNS = 2000
KEYSET_PAGE = 1000
FACET_BUCKETS = 100
AUTOCOMPLETE_HITS = 100
LOW_CARDINALITY_BUCKETS = 10
BROWSE_CACHE_ENTRIES = 100
BROWSE_CACHE_DEPTH = 2
FINDER_COUNT = 10


def entity_table(entity: str, test: bool = False) -> str:
    """Table of an entity type; shadow tables of test mode have a suffix."""
    return f"{ENTITY_TABLE_PREFIX}{entity.lower()}{TEST_SUFFIX if test else ''}"


def edge_table(relationship: str, test: bool = False) -> str:
    return f"{EDGE_TABLE_PREFIX}{relationship.lower()}{TEST_SUFFIX if test else ''}"


def aspect_column(alias: str) -> str:
    return f"{ASPECT_PREFIX}{alias.lower()}"


def path_segments(path: str) -> list[str]:
    """``/a/b/`` -> [a, b]; surrounding slashes and spaces do not count."""
    inner = path.strip(" /")
    return inner.split("/") if inner else []


def index_column(alias: str, path: str, separator: str = "$") -> str:
    """Column of an indexed path: ``i_<alias>$a$b``, or with ``0`` for ``$``."""
    if separator not in ("$", "0"):
        raise ValueError("separator must be $ or 0")
    return separator.join([f"{INDEX_PREFIX}{alias.lower()}", *path_segments(path)])


def expression_index(alias: str, path: str) -> str:
    """Name of an expression index, which always uses ``0``."""
    return "0".join([f"{EXPRESSION_PREFIX}{alias.lower()}", *path_segments(path)])


def metadata_column(path: str, separator: str = "$") -> str:
    """Column of a relationship metadata path: ``metadata$a$b``."""
    return separator.join(["metadata", *path_segments(path)])


def topic_name(event: str, entity: str, aspect: str = "", overrides: dict | None = None) -> str:
    """Topic of an event; a missing aspect drops its part."""
    key = (event, entity, aspect)
    if overrides and key in overrides:
        return overrides[key]
    name = TOPIC_PATTERN.replace("%EVENT%", event).replace("%ENTITY%", entity)
    return name.replace("%ASPECT%", aspect) if aspect else name.replace("_%ASPECT%", "")
