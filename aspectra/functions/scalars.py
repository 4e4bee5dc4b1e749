"""The scalar functions of the stored statements, as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Codes of the statements' date formats and their counterparts (fixed values).
DATE_CODES = {
    "%Y": "yyyy", "%m": "MM", "%d": "dd", "%H": "HH", "%i": "mm", "%s": "ss", "%S": "ss", "%f": "SSSSSS", "%T": "HH:mm:ss",
}


def json_extract(doc: Column, path: str) -> Column:
    """The value at a path; strings come without quotes."""
    return F.get_json_object(doc, path)


def json_unquote(text: Column) -> Column:
    """A JSON string without its quotes and escapes; other text as it is."""
    quoted = text.rlike('(?s)^".*"$')
    return F.when(quoted, F.get_json_object(F.concat(F.lit("["), text, F.lit("]")), "$[0]")).otherwise(text)


def json_contains(doc: Column, value: str | bool | int | float) -> Column:
    """Whether an array has the member, or a scalar is the value; types count."""
    if isinstance(value, bool):
        kind, wanted, scalar = "boolean", F.lit(value), str(value).lower()
    elif isinstance(value, (int, float)):
        kind, wanted, scalar = "double", F.lit(float(value)), None
    else:
        kind, wanted, scalar = "string", F.lit(value), '"' + value + '"'
    member = F.array_contains(F.from_json(doc, f"array<{kind}>"), wanted)
    alone = doc.try_cast("double") == wanted if scalar is None else doc == F.lit(scalar)
    return F.when(doc.isNull(), F.lit(None).cast("boolean")).otherwise(
        F.coalesce(F.when(doc.startswith("["), member).otherwise(alone), F.lit(False))
    )


def json_search(doc: Column, pattern: str) -> Column:
    """The path of the first string member that is like the pattern, or null."""
    members = F.from_json(doc, "array<string>")
    at = F.array_position(F.transform(members, lambda m: m.like(pattern)), True)
    return F.when(at > 0, F.concat(F.lit('"$['), (at - 1).cast("string"), F.lit(']"')))


def date_pattern(codes: str) -> str:
    """A format of % codes as a pattern; unknown codes raise ``ValueError``."""
    out = []
    for part in re.findall(r"%.|[^%]+", codes):
        if part.startswith("%"):
            if part not in DATE_CODES:
                raise ValueError(f"unknown date code {part}")
            out.append(DATE_CODES[part])
        else:
            out.append(re.sub(r"([A-Za-z]+)", r"'\1'", part))
    return "".join(out)


def date_format(time: Column, codes: str) -> Column:
    return F.date_format(time, date_pattern(codes))


def str_to_date(text: Column, codes: str) -> Column:
    """The time that a text names; null where it does not fit."""
    return F.try_to_timestamp(text, F.lit(date_pattern(codes)))


def if_(condition: Column, then: Column, other: Column) -> Column:
    """A null condition counts as false."""
    return F.when(F.coalesce(condition, F.lit(False)), then).otherwise(other)


def now(at: Column | None = None) -> Column:
    """The time of the statement; pass one for repeatable results."""
    return F.current_timestamp() if at is None else at
