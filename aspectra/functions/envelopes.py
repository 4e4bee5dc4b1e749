"""Aspect cells: the audited envelope, deletion markers and typed paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import formats


def wrap(
    value: Column,
    name: str,
    on: Column,
    by: Column,
    created_for: Column | None = None,
    emit_time: Column | None = None,
    emitter: Column | None = None,
) -> Column:
    """The JSON envelope around a struct; null extras are left out."""
    fields = [
        value.alias("aspect"),
        F.lit(name).alias("canonicalName"),
        F.date_format(on, formats.STAMP_FORMAT).alias("lastmodifiedon"),
        by.alias("lastmodifiedby"),
    ]
    for extra, label in ((created_for, "createdfor"), (emit_time, "emitTime"), (emitter, "emitter")):
        if extra is not None:
            fields.append(extra.alias(label))
    return F.to_json(F.struct(*fields))


def marker(on: Column | None = None, by: Column | None = None) -> Column:
    """The cell of a deleted aspect; without time and actor the legacy form."""
    fields = [F.lit(True).alias(formats.DELETED_FLAG)]
    if on is not None:
        fields.append(F.unix_millis(on).alias(formats.DELETED_TIME))
    if by is not None:
        fields.append(by.alias(formats.DELETED_BY))
    return F.to_json(F.struct(*fields))


def is_marker(cell: Column) -> Column:
    """True for markers; false for values and nulls."""
    return F.get_json_object(cell, f"$.{formats.DELETED_FLAG}").isNotNull()


def is_live(cell: Column) -> Column:
    return cell.isNotNull() & ~is_marker(cell)


def unwrap(cell: Column) -> Column:
    """The value inside an envelope as JSON text; null for markers and nulls."""
    return F.get_json_object(cell, "$.aspect")


def field(cell: Column, name: str) -> Column:
    """A field of the envelope itself, such as lastmodifiedby."""
    return F.get_json_object(cell, f"$.{name}")


def deletion(cell: Column) -> Column:
    """(time, by) of a marker; both null in the legacy form."""
    return F.struct(
        F.get_json_object(cell, f"$.{formats.DELETED_TIME}").cast("long").alias("time"),
        F.get_json_object(cell, f"$.{formats.DELETED_BY}").alias("by"),
    )


def value_at(root: Column, schema: T.DataType, path: str) -> Column:
    """A typed value by path in a struct column.

    Array members on the way give the array of the members' values, nulls
    left out; ``*`` stands for all members; a number is no step.  Maps and
    arrays of arrays cannot be walked.  Unknown fields raise ``ValueError``.
    """
    steps = [s for s in formats.path_segments(path) if s != "*"]

    def walk(column: Column, kind: T.DataType, rest: list[str]) -> Column:
        if isinstance(kind, T.ArrayType):
            if isinstance(kind.elementType, T.ArrayType):
                raise ValueError("arrays of arrays have no paths")
            if not rest:
                return column
            if rest[0].isdigit():
                raise ValueError("array members have no numbers in paths")
            inner = F.transform(column, lambda x: walk(x, kind.elementType, rest))
            return F.filter(inner, lambda x: x.isNotNull())
        if not rest:
            return column
        if not isinstance(kind, T.StructType):
            raise ValueError(f"{rest[0]} is below {kind.simpleString()}")
        if rest[0] not in kind.names:
            raise ValueError(f"no field {rest[0]} among {kind.names}")
        return walk(column[rest[0]], kind[rest[0]].dataType, rest[1:])

    return walk(root, schema, steps)
