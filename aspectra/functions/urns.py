"""URNs as column expressions: parts, checks and normal form."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Rules of well-formed URNs (fixed values): type, then a key that is not empty.
_SHAPE = r"^urn:[^\s:]+:[a-z]\w*:.+$"
_ODD = r"[\s\p{Cc}\p{Cf}]"


def namespace(urn: Column) -> Column:
    return F.regexp_extract(urn, r"^urn:([^:]+):", 1)


def entity_type(urn: Column) -> Column:
    return F.regexp_extract(urn, r"^urn:[^:]+:([^:]+):", 1)


def key(urn: Column) -> Column:
    """Everything after the type."""
    return F.regexp_extract(urn, r"(?s)^urn:[^:]+:[^:]+:(.*)$", 1)


def key_parts(urn: Column) -> Column:
    """Parts of the key: a tuple's members, split outside nested parentheses.

    The fold keeps (parts, current, depth); everything stays in the JVM.
    """
    own = key(urn)
    tupled = own.startswith("(") & own.endswith(")")
    inner = F.when(tupled, F.substring(own, F.lit(2), F.length(own) - 2)).otherwise(own)
    empty = F.struct(
        F.array().cast("array<string>").alias("parts"),
        F.lit("").alias("now"),
        F.lit(0).alias("depth"),
    )

    def step(state: Column, c: Column) -> Column:
        cut = (c == ",") & (state["depth"] == 0)
        return F.struct(
            F.when(cut, F.array_append(state["parts"], state["now"])).otherwise(state["parts"]).alias("parts"),
            F.when(cut, F.lit("")).otherwise(F.concat(state["now"], c)).alias("now"),
            (state["depth"] + F.when(c == "(", 1).when(c == ")", -1).otherwise(0)).alias("depth"),
        )

    split = F.aggregate(
        F.split(inner, ""), empty, step, lambda s: F.array_append(s["parts"], s["now"])
    )
    return F.when(tupled, split).otherwise(F.array(own))


def id_long(urn: Column) -> Column:
    """The single-part key as a number; null where it is none."""
    return key(urn).try_cast("long")


def id_int(urn: Column) -> Column:
    return key(urn).try_cast("int")


def is_valid(urn: Column) -> Column:
    """Well-formed, without white space or control and format characters, and
    with balanced parentheses."""
    opened = F.length(F.regexp_replace(urn, r"[^(]", ""))
    closed = F.length(F.regexp_replace(urn, r"[^)]", ""))
    nested = ~urn.rlike(r"[(,]urn:(?![^\s:]+:[a-z]\w*:[^\s])")
    good = urn.rlike(_SHAPE) & ~urn.rlike(_ODD) & (opened == closed) & nested
    return F.coalesce(good & ~urn.rlike(r"^urn:[^:]+:[^:]+:\(\)$"), F.lit(False))


def normal(urn: Column) -> Column:
    """A tuple of one part loses its parentheses."""
    return F.when(
        (F.size(key_parts(urn)) == 1) & key(urn).startswith("(") & key(urn).endswith(")"),
        F.concat(
            F.regexp_extract(urn, r"^(urn:[^:]+:[^:]+:)", 1), F.element_at(key_parts(urn), 1)
        ),
    ).otherwise(urn)


def same(left: Column, right: Column, lower: bool = True) -> Column:
    """Keys match urns whatever their case."""
    return F.lower(left) == F.lower(right) if lower else left == right


def path_map(paths: dict[str, Column]) -> Column:
    """The JSON map path -> value that is stored beside an entity."""
    entries = [F.struct(F.lit(p).alias("key"), c.cast("string").alias("value")) for p, c in paths.items()]
    if not entries:
        return F.lit("{}")
    kept = F.filter(F.array(*entries), lambda e: e["value"].isNotNull())
    return F.to_json(F.map_from_entries(kept))
