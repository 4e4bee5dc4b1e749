"""Sources and sinks: stored tables, urn-keyed JSON files, events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import formats


def read_entity(spark: SparkSession, root: str, entity: str, test: bool = False) -> DataFrame:
    """The wide table of an entity type."""
    return spark.read.parquet(f"{root}/{formats.entity_table(entity, test)}")


def read_edges(spark: SparkSession, root: str, relationship: str, test: bool = False) -> DataFrame:
    return spark.read.parquet(f"{root}/{formats.edge_table(relationship, test)}")


def read_log(spark: SparkSession, root: str, aspect: str | None = None) -> DataFrame:
    """The aspect log, partitioned by aspect; naming one prunes the rest."""
    log = spark.read.parquet(f"{root}/{formats.LOG_TABLE}")
    return log.filter(F.col("aspect") == aspect) if aspect else log


def write_log(log: DataFrame, root: str) -> None:
    log.repartition("aspect", "urn").write.mode("overwrite").partitionBy("aspect").parquet(
        f"{root}/{formats.LOG_TABLE}"
    )


def read_documents(spark: SparkSession, root: str, document: str) -> DataFrame:
    """Search documents, stored under the document's name in lower case."""
    return spark.read.parquet(f"{root}/{document.lower()}")


def read_seed(spark: SparkSession, path: str) -> DataFrame:
    """(urn, value) from JSON files that are one object keyed by urn.

    Null values are left out; values stay JSON text.  The source is read-only.
    """
    whole = spark.read.option("wholetext", True).text(path)
    entries = F.explode(F.from_json("value", "map<string,string>")).alias("urn", "json")
    return whole.select(entries).select("urn", F.col("json").alias("value")).filter(F.col("value").isNotNull())


def entity_types(spark: SparkSession) -> list[str]:
    """Entity types that have a table in the current catalogue."""
    names = [t.name for t in spark.catalog.listTables()]
    prefix = formats.ENTITY_TABLE_PREFIX
    return sorted(n.removeprefix(prefix) for n in names if n.startswith(prefix) and not n.endswith(formats.TEST_SUFFIX))


def estimated_rows(df: DataFrame) -> int:
    """Rows by the optimiser's statistics, or else by counting file metadata."""
    stats = df._jdf.queryExecution().optimizedPlan().stats().rowCount()
    return int(str(stats.get())) if stats.isDefined() else df.count()


def compacted(table: DataFrame, columns: dict) -> DataFrame:
    """A wide table with indexed paths as real columns, clustered by urn.

    Filters on these columns reach the Parquet scan, which JSON text cannot.
    """
    return table.withColumns(columns).repartitionByRange("urn").sortWithinPartitions("urn")
