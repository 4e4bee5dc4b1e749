"""Document search: text queries, filters, facets, highlights, autocomplete.

Documents are one row each.  Text is analysed into lower-cased tokens by
column expressions; a query term matches a token within 0, 1 or 2 edits by its
length, and a match counts with its field's weight.  Scores order results by
weight; they are not the scores of a search server.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import formats
from ..model import Document
from ..plans.criteria import SearchCriterion, SearchSort
from ..plans.pages import cut
from ..plans.predicates import search_predicate

# -- analysers ----------------------------------------------------------------


def whitespace_tokens(text: Column) -> Column:
    """Lower-cased, accents folded, split at white space."""
    return F.filter(F.split(F.lower(fold(text)), r"\s+"), lambda t: t != "")


def word_parts(text: Column) -> Column:
    """Split also where letters, digits and signs meet, and in camelCase."""
    spaced = F.regexp_replace(fold(text), r"([a-z])([A-Z])", "$1 $2")
    spaced = F.regexp_replace(spaced, r"([A-Za-z])([0-9])", "$1 $2")
    spaced = F.regexp_replace(spaced, r"([0-9])([A-Za-z])", "$1 $2")
    return F.filter(F.split(F.lower(spaced), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def slash_tokens(path: Column) -> Column:
    return F.filter(F.split(F.lower(path), "/"), lambda t: t != "")


def path_hierarchy(path: Column) -> Column:
    """/a/b/c -> [/a, /a/b, /a/b/c], lower-cased."""
    parts = slash_tokens(path)
    return F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(parts), F.lit(1))),
        lambda n: F.concat(F.lit("/"), F.array_join(F.slice(parts, F.lit(1), n), "/")),
    )


def edge_ngrams(token: Column, least: int = 3, most: int = 20) -> Column:
    """The beginnings of a token; a shorter token has none."""
    top = F.least(F.length(token), F.lit(most))
    return F.when(
        top >= least, F.transform(F.sequence(F.lit(least), top), lambda n: F.substring(token, F.lit(1), n))
    ).otherwise(F.array().cast("array<string>"))


#: Letters with their plain forms, for folding (fixed values, in pairs).
_ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝ"
_PLAIN = "aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUY"


def fold(text: Column) -> Column:
    return F.translate(text, _ACCENTED, _PLAIN)


# -- scoring ------------------------------------------------------------------


def edits_allowed(term: str) -> int:
    """Edits that still match a term: none to 2 letters, one to 5, else two."""
    return 0 if len(term) <= 2 else 1 if len(term) <= 5 else 2


def _values(df: DataFrame, name: str) -> Column:
    column = F.col(name)
    if df.schema[name].dataType.typeName() == "array":
        return F.coalesce(column, F.array().cast("array<string>"))
    return F.when(column.isNull(), F.array().cast("array<string>")).otherwise(F.array(column.cast("string")))


def _matches(tokens: Column, term: str, fuzzy: bool) -> Column:
    k = edits_allowed(term) if fuzzy else 0
    if k == 0:
        return F.array_contains(tokens, term)
    # The length test spares most distance computations.
    return F.exists(
        tokens,
        lambda t: (F.abs(F.length(t) - len(term)) <= k) & (F.levenshtein(t, F.lit(term), k) >= 0),
    )


def scored(df: DataFrame, doc: Document, text: str, fuzzy: bool = True) -> DataFrame:
    """Rows in which every term matches some field, with a _score.

    The score of a term is the largest weight of a field that it matches.
    ``*`` or blank text matches all rows with score 1.
    """
    terms = text.lower().split()
    if not terms or terms == ["*"]:
        return df.withColumn("_score", F.lit(1.0))
    fields = [f for f in (doc.fields or tuple(doc.boosts)) if f in df.columns]
    if not fields:
        raise ValueError("the document has no text fields")
    tokens = {f: F.flatten(F.transform(_values(df, f), whitespace_tokens)) for f in fields}
    df = df.withColumns({f"_t_{f}": c for f, c in tokens.items()})
    per_term = []
    for term in terms:
        weights = [
            F.when(_matches(F.col(f"_t_{f}"), term, fuzzy), F.lit(float(doc.boosts.get(f, 1.0)))).otherwise(0.0)
            for f in fields
        ]
        per_term.append(F.greatest(*weights) if len(weights) > 1 else weights[0])
    df = df.withColumn("_per", F.array(*per_term))
    hits = df.filter(F.forall("_per", lambda s: s > 0))
    total = F.aggregate("_per", F.lit(0.0), lambda a, s: a + s)
    return hits.withColumn("_score", total).drop("_per", *[f"_t_{f}" for f in fields])


# -- search -------------------------------------------------------------------


@dataclass
class SearchResult:
    """Lazy parts of a search: hits, facet counts, highlights and the total."""

    hits: DataFrame
    facets: DataFrame
    total: DataFrame
    highlights: DataFrame | None = None


def order_of(sort: SearchSort | None) -> list[Column]:
    """Score then urn; a field then urn; urn alone once."""
    if sort is None:
        return [F.col("_score").desc(), F.col("urn").asc()]
    by = F.col(sort.field).desc() if sort.descending else F.col(sort.field).asc()
    return [by] if sort.field == "urn" else [by, F.col("urn").asc()]


def facet_counts(
    hits: DataFrame, facets: tuple[str, ...], criteria: list[SearchCriterion] = [], mode: str = "plain", most: int = formats.FACET_BUCKETS
) -> DataFrame:
    """(facet, value, count): the most frequent values of each facet.

    Buckets are chosen by their count among all hits, before post-filters.
    ``plain`` counts those.  ``others`` counts, per facet, the hits that meet
    the last criterion on another facet; ``all`` the hits that meet every
    criterion.  Buckets that count zero are left out.
    """
    if not facets:
        return hits.sparkSession.createDataFrame([], "facet string, value string, count long")
    entries = []
    for facet in facets:
        array = hits.schema[facet].dataType.typeName() == "array"
        chosen = criteria if mode == "all" else []
        if mode == "others":
            chosen = [c for c in criteria if c.field != facet and c.field in facets][-1:]
        test = search_predicate(hits, chosen, analysed=True)
        values = F.array_distinct(facet) if array else F.array(F.col(facet))
        entries.append(_facet_entries(facet, F.coalesce(values, F.array().cast("array<string>")), test))
    # All facets in one pass over the hits.
    rows = hits.select(F.explode(F.flatten(F.array(*entries))).alias("e")).select("e.*")
    counted = rows.filter(F.col("value").isNotNull()).groupBy("facet", "value").agg(
        F.count(F.lit(1)).alias("_n"), F.count_if("_ok").alias("count")
    )
    rank = Window.partitionBy("facet").orderBy(F.desc("_n"), "value")
    top = counted.withColumn("_rank", F.row_number().over(rank)).filter(F.col("_rank") <= most)
    return top.filter(F.col("count") > 0).select("facet", "value", "count")


def _facet_entries(facet: str, values: Column, test: Column) -> Column:
    return F.transform(
        values,
        lambda v: F.struct(
            F.lit(facet).alias("facet"), v.cast("string").alias("value"), F.coalesce(test, F.lit(False)).alias("_ok")
        ),
    )


def _named(field: str, values: Column) -> Column:
    return F.transform(values, lambda v: F.struct(F.lit(field).alias("field"), v.alias("value")))


def highlighted(hits: DataFrame, doc: Document, text: str) -> DataFrame:
    """(urn, matches): per hit the (field, value) pairs that match, in order.

    A name ``f.*`` stands for sub-fields of f.  Hits without any are left out.
    """
    terms = [t for t in text.lower().split() if t != "*"]
    pairs = []
    for name in doc.highlighted:
        field = name.removesuffix(".*")
        if field not in hits.columns or not terms:
            continue
        test = lambda v: F.exists(
            whitespace_tokens(v), lambda t: F.greatest(*[(F.abs(F.length(t) - len(x)) <= edits_allowed(x)) & (F.levenshtein(t, F.lit(x), edits_allowed(x)) >= 0) for x in terms], F.lit(False))
        )
        found = F.filter(_values(hits, field), test)
        pairs.append(_named(field, found))
    if not pairs:
        return hits.sparkSession.createDataFrame([], "urn string, matches array<struct<field:string,value:string>>")
    return hits.select("urn", F.flatten(F.array(*pairs)).alias("matches")).filter(F.size("matches") > 0)


def search(
    df: DataFrame,
    doc: Document,
    text: str,
    criteria: list[SearchCriterion] = [],
    sort: SearchSort | None = None,
    start: int = 0,
    size: int | None = 10,
    version: int = 1,
    preference: str | None = None,
) -> SearchResult:
    """A text query with post-filter, facets, highlights and a page of hits.

    Version 1 counts facets by the last criterion on another facet, version 2
    by all criteria together.  ``preference`` is a request hint that has no
    meaning here.
    """
    found = scored(df, doc, text)
    kept = found.filter(search_predicate(found, criteria, analysed=True))
    mode = "plain" if not criteria else "others" if version == 1 else "all"
    hits = cut(kept, order_of(sort), start, size)
    return SearchResult(
        hits,
        facet_counts(found, doc.facets, criteria, mode),
        kept.agg(F.count(F.lit(1)).alias("total")),
        highlighted(hits, doc, text),
    )


def filter_documents(df: DataFrame, criteria: list[SearchCriterion], sort: SearchSort | None = None, start: int = 0, size: int | None = 10) -> DataFrame:
    """Rows by filters only; all score the same."""
    rows = df.filter(search_predicate(df, criteria)).withColumn("_score", F.lit(1.0))
    return cut(rows, order_of(sort), start, size)


def template_query(template: str, text: str) -> dict:
    """A configured query template with the input in place of $INPUT."""
    import json

    return json.loads(template.replace("$INPUT", json.dumps(text)[1:-1]))


# -- autocomplete -------------------------------------------------------------


def autocomplete(
    df: DataFrame, doc: Document, text: str, field: str | None = None, criteria: list[SearchCriterion] = [], limit: int = 10
) -> DataFrame:
    """(suggestion) for a field; low-cardinality fields have their own way."""
    field = field or doc.default_autocomplete
    if not field:
        raise ValueError("no field to complete")
    if field in doc.low_cardinality:
        return autocomplete_low(df, field, text, criteria)
    return autocomplete_high(df, field, text, criteria, limit)


def autocomplete_high(df: DataFrame, field: str, text: str, criteria: list[SearchCriterion] = [], limit: int = 10) -> DataFrame:
    """Values containing the input, from the first 100 hits in urn order.

    Values keep the order of their first appearance; documents are taken whole
    until ``limit`` values are reached.
    """
    needle = text.lower()
    values = F.filter(_values(df, field), lambda v: F.lower(v).contains(needle))
    rows = df.filter(search_predicate(df, criteria)).select("urn", values.alias("_v"))
    hits = rows.filter(F.size("_v") > 0).orderBy("urn").limit(formats.AUTOCOMPLETE_HITS)
    # At most 100 rows from here on.
    own = hits.select("urn", F.posexplode("_v").alias("_p", "suggestion"))
    first = own.groupBy("suggestion").agg(F.min(F.struct("urn", "_p")).alias("_at"))
    per_doc = first.groupBy("_at.urn").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("urn").rowsBetween(Window.unboundedPreceding, -1)
    begun = per_doc.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    kept = first.select("suggestion", "_at", F.col("_at.urn").alias("urn")).join(
        begun.filter(F.col("_before") < limit), "urn"
    )
    return kept.orderBy("_at").select("suggestion", F.col("urn").alias("first_urn"))


def autocomplete_low(df: DataFrame, field: str, text: str, criteria: list[SearchCriterion] = []) -> DataFrame:
    """The ten most frequent values of which a token begins with the input."""
    needle = text.lower()
    starts = lambda v: F.exists(F.array_append(whitespace_tokens(v), F.lower(v)), lambda t: t.startswith(needle))
    rows = df.filter(search_predicate(df, criteria)).select(F.explode(_values(df, field)).alias("suggestion"))
    return (
        rows.filter(starts(F.col("suggestion")))
        .groupBy("suggestion")
        .agg(F.count(F.lit(1)).alias("count"))
        .orderBy(F.desc("count"), "suggestion")
        .limit(formats.LOW_CARDINALITY_BUCKETS)
    )


# -- hits and documents ---------------------------------------------------------


def hits_with_entities(hits: DataFrame, cells: DataFrame) -> DataFrame:
    """Hits joined with stored aspects, in hit order; unknown urns drop out.

    ``hits`` has urn and rank.
    """
    return hits.join(cells, "urn").orderBy("rank")


def upsert_documents(stored: DataFrame, updates: DataFrame) -> DataFrame:
    """Partial updates: fields that an update has replace those stored."""
    names = stored.columns
    old, new = stored.alias("o"), updates.alias("n")
    joined = old.join(new, F.col("o.urn") == F.col("n.urn"), "full_outer")
    return joined.select(
        *[
            F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c) if c in updates.columns else F.col(f"o.{c}").alias(c)
            for c in names
        ]
    )


def delete_documents(stored: DataFrame, urns: DataFrame) -> DataFrame:
    return stored.join(urns.select("urn").distinct(), "urn", "left_anti")


