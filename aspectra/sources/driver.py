"""The driver's tables as entities, edges, a log and documents.

Markers and deletions are set by fixed rules on keys, so every deletion
mechanism occurs: customers whose key is divisible by 17 have a marker in
their info cell, by 23 are deleted as assets; orders of priority 1-URGENT are
deleted edges a month after their date.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.envelopes import marker, wrap
from ..model import Aspect, Document, Entity, Registry, Relationship

STAMP = "2024-01-01 00:00:00"


def registry() -> Registry:
    """Everything that the queries need to know about these tables."""
    urn = Aspect("urn", {"/id": "long"}, is_urn=True)
    out = Registry()
    out.add(
        Entity(
            "customer",
            {
                "CustomerUrn": urn,
                "CustomerInfo": Aspect(
                    "info",
                    {"/segment": "string", "/balance": "double", "/nation": "int", "/tags": "array", "/name": "string"},
                ),
                "Status": Aspect("status", {"/removed": "boolean"}),
            },
        )
    )
    out.add(Entity("order", {"OrderUrn": urn, "OrderInfo": Aspect("info", {"/status": "string", "/priority": "string", "/total": "double"})}))
    out.add(Entity("nation", {"NationUrn": urn, "NationInfo": Aspect("info", {"/name": "string", "/region": "int"})}))
    out.add(Entity("region", {"RegionUrn": urn, "RegionInfo": Aspect("info", {"/name": "string"})}))
    out.add(Relationship("PlacedBy", ("/status", "/priority")))
    out.add(Relationship("LocatedIn", ("/kind",)))
    out.add(Relationship("PartOf"))
    out.add(
        Document(
            "PartDocument",
            facets=("brand", "type", "words"),
            low_cardinality=("type",),
            boosts={"words": 32.0, "brand": 2.0, "type": 1.0},
            highlighted=("words", "brand"),
            fields=("words", "brand", "type", "size"),
            default_autocomplete="words",
        )
    )
    out.add(Document("PageDocument", fields=("scheme",), facets=("scheme",)))
    return out


def _read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _urn(kind: str, key):
    return F.concat(F.lit(f"urn:li:{kind}:"), key.cast("string"))



def _stamped(df: DataFrame) -> DataFrame:
    on = F.lit(STAMP).cast("timestamp")
    return df.withColumn("lastmodifiedon", on).withColumn("lastmodifiedby", F.lit("urn:li:corpuser:loader"))


def customers(spark: SparkSession, d: str) -> DataFrame:
    """The wide customer table with materialised paths."""
    df = _stamped(_read(spark, d, "customer"))
    key = F.col("c_custkey")
    marked = key % 17 == 0
    tags = F.array(F.lower("c_mktsegment"), F.concat(F.lit("n"), F.col("c_nationkey").cast("string")))
    info = F.struct(
        F.col("c_name").alias("name"),
        F.col("c_mktsegment").alias("segment"),
        F.col("c_acctbal").alias("balance"),
        F.col("c_nationkey").alias("nation"),
        tags.alias("tags"),
    )
    on, by = F.col("lastmodifiedon"), F.col("lastmodifiedby")
    own = lambda c: F.when(~marked, c)
    return df.select(
        _urn("customer", key).alias("urn"),
        key.alias("key"),
        "lastmodifiedon",
        "lastmodifiedby",
        F.when(key % 23 == 0, on).alias("deleted_ts"),
        F.when(marked, marker(on, by)).otherwise(wrap(info, "CustomerInfo", on, by)).alias("a_info"),
        wrap(F.struct((F.col("c_acctbal") < 0).alias("removed")), "Status", on, by).alias("a_status"),
        F.to_json(F.create_map(F.lit("/id"), key.cast("string"))).alias("a_urn"),
        own(F.col("c_mktsegment")).alias("i_info$segment"),
        own(F.col("c_acctbal").cast("string")).alias("i_info$balance"),
        own(F.col("c_nationkey").cast("string")).alias("i_info$nation"),
        own(F.to_json(tags)).alias("i_info$tags"),
        (F.col("c_acctbal") < 0).cast("string").alias("i_status$removed"),
    )


def orders(spark: SparkSession, d: str) -> DataFrame:
    df = _stamped(_read(spark, d, "orders"))
    info = F.struct(
        F.col("o_orderstatus").alias("status"),
        F.col("o_orderpriority").alias("priority"),
        F.col("o_totalprice").alias("total"),
    )
    return df.select(
        _urn("order", F.col("o_orderkey")).alias("urn"),
        "lastmodifiedon",
        "lastmodifiedby",
        F.lit(None).cast("timestamp").alias("deleted_ts"),
        wrap(info, "OrderInfo", F.col("lastmodifiedon"), F.col("lastmodifiedby")).alias("a_info"),
        F.col("o_orderstatus").alias("i_info$status"),
        F.col("o_orderpriority").alias("i_info$priority"),
        F.col("o_totalprice").cast("string").alias("i_info$total"),
    )


def nations(spark: SparkSession, d: str) -> DataFrame:
    df = _stamped(_read(spark, d, "nation"))
    info = F.struct(F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"))
    return df.select(
        _urn("nation", F.col("n_nationkey")).alias("urn"),
        "lastmodifiedon",
        "lastmodifiedby",
        F.lit(None).cast("timestamp").alias("deleted_ts"),
        wrap(info, "NationInfo", F.col("lastmodifiedon"), F.col("lastmodifiedby")).alias("a_info"),
        F.col("n_name").alias("i_info$name"),
        F.col("n_regionkey").cast("string").alias("i_info$region"),
    )


def regions(spark: SparkSession, d: str) -> DataFrame:
    df = _stamped(_read(spark, d, "region"))
    return df.select(
        _urn("region", F.col("r_regionkey")).alias("urn"),
        "lastmodifiedon",
        "lastmodifiedby",
        F.lit(None).cast("timestamp").alias("deleted_ts"),
        F.col("r_name").alias("i_info$name"),
    )


def placed_by(spark: SparkSession, d: str) -> DataFrame:
    """Edges from orders to customers."""
    df = _read(spark, d, "orders")
    metadata = F.struct(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"))
    return df.select(
        (F.col("o_orderkey") + 1).alias("id"),
        F.to_json(metadata).alias("metadata"),
        _urn("order", F.col("o_orderkey")).alias("source"),
        F.lit("order").alias("source_type"),
        _urn("customer", F.col("o_custkey")).alias("destination"),
        F.lit("customer").alias("destination_type"),
        F.col("o_orderdate").cast("timestamp").alias("lastmodifiedon"),
        F.lit("urn:li:corpuser:loader").alias("lastmodifiedby"),
        F.when(
            F.col("o_orderpriority") == "1-URGENT", F.col("o_orderdate").cast("timestamp") + F.expr("INTERVAL 30 DAYS")
        ).alias("deleted_ts"),
        F.lit("OrderInfo").alias("aspect"),
        F.col("o_orderstatus").alias("metadata$status"),
        F.col("o_orderpriority").alias("metadata$priority"),
    )


def located_in(spark: SparkSession, d: str) -> DataFrame:
    """Edges from customers to nations."""
    df = _read(spark, d, "customer")
    return df.select(
        (F.col("c_custkey") + 1).alias("id"),
        F.to_json(F.struct(F.lower("c_mktsegment").alias("kind"))).alias("metadata"),
        _urn("customer", F.col("c_custkey")).alias("source"),
        F.lit("customer").alias("source_type"),
        _urn("nation", F.col("c_nationkey")).alias("destination"),
        F.lit("nation").alias("destination_type"),
        F.lit(STAMP).cast("timestamp").alias("lastmodifiedon"),
        F.lit("urn:li:corpuser:loader").alias("lastmodifiedby"),
        F.lit(None).cast("timestamp").alias("deleted_ts"),
        F.lit("CustomerInfo").alias("aspect"),
    )


def part_of(spark: SparkSession, d: str) -> DataFrame:
    """Edges from nations to regions."""
    df = _read(spark, d, "nation")
    return df.select(
        (F.col("n_nationkey") + 1).cast("long").alias("id"),
        F.lit("{}").alias("metadata"),
        _urn("nation", F.col("n_nationkey")).alias("source"),
        F.lit("nation").alias("source_type"),
        _urn("region", F.col("n_regionkey")).alias("destination"),
        F.lit("region").alias("destination_type"),
        F.lit(STAMP).cast("timestamp").alias("lastmodifiedon"),
        F.lit("urn:li:corpuser:loader").alias("lastmodifiedby"),
        F.lit(None).cast("timestamp").alias("deleted_ts"),
        F.lit("NationInfo").alias("aspect"),
    )


def next_nation(spark: SparkSession, d: str) -> DataFrame:
    """Edges between nations: each to the one three keys on, a ring."""
    df = _read(spark, d, "nation")
    return df.select(
        (F.col("n_nationkey") + 1).cast("long").alias("id"),
        F.lit("{}").alias("metadata"),
        _urn("nation", F.col("n_nationkey")).alias("source"),
        _urn("nation", (F.col("n_nationkey") + 3) % 25).alias("destination"),
        F.lit(STAMP).cast("timestamp").alias("lastmodifiedon"),
        F.lit(None).cast("timestamp").alias("deleted_ts"),
    )


def supplied_by(spark: SparkSession, d: str) -> DataFrame:
    """Edges from parts to suppliers, many between the same two."""
    df = _read(spark, d, "lineitem")
    return df.select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"),
        _urn("part", F.col("l_partkey")).alias("source"),
        _urn("supplier", F.col("l_suppkey")).alias("destination"),
        F.to_json(F.struct(F.col("l_returnflag").alias("flag"))).alias("metadata"),
        F.col("l_returnflag").alias("metadata$flag"),
        F.col("l_quantity").alias("quantity"),
        F.col("l_shipdate").cast("timestamp").alias("lastmodifiedon"),
        F.when(F.col("l_returnflag") == "R", F.col("l_shipdate").cast("timestamp")).alias("deleted_ts"),
    )


def changes(spark: SparkSession, d: str) -> DataFrame:
    """The events as changes of users' aspects: (urn, aspect, metadata, ...)."""
    df = _read(spark, d, "events")
    value = F.struct(F.col("value").alias("value"), F.get_json_object("props", "$.k").cast("long").alias("k"))
    return df.select(
        _urn("user", F.col("user_id")).alias("urn"),
        F.col("event_type").alias("aspect"),
        F.to_json(value).alias("metadata"),
        F.col("ts").cast("timestamp").alias("createdon"),
        F.lit("urn:li:corpuser:loader").alias("createdby"),
        F.lit(None).cast("string").alias("createdfor"),
        "event_id",
    )


def log(spark: SparkSession, d: str) -> DataFrame:
    """The aspect log of the events."""
    from ..operators.aspects import versioned

    return versioned(changes(spark, d), ["event_id"])


def parts(spark: SparkSession, d: str) -> DataFrame:
    """Parts as search documents."""
    df = _read(spark, d, "part")
    return df.select(
        _urn("part", F.col("p_partkey")).alias("urn"),
        F.split("p_name", " ").alias("words"),
        F.col("p_brand").alias("brand"),
        F.col("p_type").alias("type"),
        F.col("p_size").alias("size"),
        F.col("p_retailprice").alias("price"),
        (F.col("p_partkey") % 19 == 0).alias("removed"),
    )


def pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages as browse documents: host and path of their address."""
    df = _read(spark, d, "pages")
    bare = F.regexp_replace(F.regexp_replace("url", r"^[a-z]+://", ""), r"[?#].*$", "")
    path = F.concat(F.lit("/"), F.regexp_replace(F.lower(bare), r"/+$", ""))
    return df.select(
        _urn("page", F.col("page_id")).alias("urn"),
        F.array(path).alias("browsePaths"),
        F.regexp_extract("url", r"^([a-z]+)://", 1).alias("scheme"),
        (F.col("page_id") % 13 == 0).alias("removed"),
    )


def graph(spark: SparkSession, d: str):
    """All entity and edge tables, for relationship queries."""
    from ..operators.graph import Graph

    return Graph(
        registry(),
        {
            "customer": customers(spark, d),
            "order": orders(spark, d),
            "nation": nations(spark, d),
            "region": regions(spark, d),
        },
        {
            "PlacedBy": placed_by(spark, d),
            "LocatedIn": located_in(spark, d),
            "PartOf": part_of(spark, d),
            "NextNation": next_nation(spark, d),
        },
    )
