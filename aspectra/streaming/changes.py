"""Change streams: micro-batches through the same decision as batches.

The store is append-only.  A micro-batch writes what it accepted as one delta,
partitioned by a hash bucket of the urn; the state that it decides against is
read from the buckets that it touches.  Versions are ranks over the history,
so nothing is rewritten when a value changes.  ``compact`` folds deltas into a
new base from time to time.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators.aspects import small, versioned
from ..operators.ingest import (
    accepted_rows,
    audit_events,
    decide,
    latest_per_key,
    split_invalid,
    structural,
    with_current,
)

_STAMP = "struct<time:bigint,actor:string,impersonator:string>"


def _schema(ddl: str) -> T.StructType:
    return T._parse_datatype_string(ddl)


#: A proposed change.
PROPOSED = _schema(
    f"urn string, aspect string, value string, emit_time bigint, backfill boolean, mode string, audit {_STAMP}"
)
#: A committed change.
COMMITTED = _schema(
    f"urn string, aspect string, oldValue string, newValue string, changeType string, ingestionMode string, audit {_STAMP}"
)
#: A change that failed, with the reason.
FAILED = _schema("urn string, aspect string, value string, error string")
#: What a delta holds; batch and bucket are its folders.
HISTORY = _schema(
    "urn string, aspect string, metadata string, createdon timestamp, createdby string, batch bigint, bucket int"
)


class Store:
    """An append-only history of aspects under one folder."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = 64):
        self.spark, self.folder, self.buckets = spark, folder.rstrip("/"), buckets

    def bucket(self, urn: Column) -> Column:
        """Buckets ignore case, as keys do."""
        return F.pmod(F.xxhash64(F.lower(urn)), F.lit(self.buckets)).cast("int")

    def _children(self, name: str) -> list[int]:
        """Numbers of the folders ``key=number`` below ``name``."""
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(path):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(path) if s.isDirectory()]
        return sorted(int(n.split("=")[1]) for n in names if "=" in n)

    def _read(self, paths: list[str], base: str) -> DataFrame:
        return self.spark.read.schema(HISTORY).option("basePath", base).parquet(*paths)

    def history(self, upto: int) -> DataFrame:
        """All accepted changes of batches up to ``upto``."""
        bases = [n for n in self._children("base") if n <= upto]
        start = bases[-1] if bases else -1
        out = self.spark.createDataFrame([], HISTORY)
        if bases:
            base = f"{self.folder}/base/upto={start}"
            out = out.unionByName(self._read([base], base))
        deltas = [n for n in self._children("delta") if start < n <= upto]
        if deltas:
            root = f"{self.folder}/delta"
            out = out.unionByName(self._read([f"{root}/batch={n}" for n in deltas], root))
        return out

    def log(self, upto: int) -> DataFrame:
        """The log: the history with versions."""
        rows = versioned(self.history(upto), ["batch"])
        return rows.withColumn("createdfor", F.lit(None).cast("string")).drop("batch", "bucket")

    def current(self, upto: int, keys: DataFrame) -> DataFrame:
        """Version 0 of the urns in ``keys``: only their buckets are read."""
        own = keys.select(F.lower("urn").alias("_u"), self.bucket(F.col("urn")).alias("_b")).distinct()
        touched = [r[0] for r in own.select("_b").distinct().collect()]  # at most ``buckets``
        rows = self.history(upto).filter(F.col("bucket").isin(touched))
        rows = rows.join(small(own.select("_u")), F.lower(rows["urn"]) == F.col("_u"), "left_semi")
        latest = F.max(F.struct("createdon", "batch", "metadata", "createdby", "urn")).alias("x")
        return rows.groupBy(F.lower("urn").alias("_u"), "aspect").agg(latest).select(
            "x.urn", "aspect", F.lit(0).cast("long").alias("version"), "x.metadata", "x.createdon", "x.createdby"
        )

    def append(self, rows: DataFrame, batch: int) -> None:
        """One delta; repeating a batch replaces its own."""
        placed = rows.withColumn("bucket", self.bucket(F.col("urn")))
        placed.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/delta/batch={batch}")

    def compact(self, upto: int) -> None:
        """A new base of all batches up to ``upto``; old files stay for readers."""
        rows = self.history(upto).repartition("bucket").sortWithinPartitions("bucket", "urn", "aspect", "createdon")
        rows.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/base/upto={upto}")


def ingest(
    spark: SparkSession,
    changes: DataFrame,
    folder: str,
    order: list[str] | None = None,
    equality=structural,
    trigger: dict | None = None,
    then: Callable[[DataFrame, int], None] | None = None,
    compact_every: int = 100,
) -> StreamingQuery:
    """Applies a stream of (urn, aspect, value, at, by, ...) to the store.

    In a micro-batch the last change of a key counts, by ``order`` (default
    ``at``).  Events and dead letters are written beside the deltas.
    """
    store = Store(spark, folder)
    order = order or ["at"]

    def batch(df: DataFrame, number: int) -> None:
        # Read for the keys, the decision and the dead letters.
        df = df.persist()
        good, failed = split_invalid(df)
        news = latest_per_key(good, order)
        decided = decide(with_current(news, store.current(number - 1, news)), equality).persist()
        store.append(accepted_rows(decided), number)
        events = audit_events(decided)
        events.write.mode("overwrite").parquet(f"{store.folder}/events/batch={number}")
        failed.select("urn", "aspect", "value", "error").write.mode("overwrite").parquet(
            f"{store.folder}/failed/batch={number}"
        )
        if then:
            then(events, number)
        if compact_every and number and number % compact_every == 0:
            store.compact(number)
        decided.unpersist()
        df.unpersist()

    writer = changes.writeStream.foreachBatch(batch).option("checkpointLocation", f"{store.folder}/checkpoint")
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def event_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int = 1) -> DataFrame:
    """Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def to_topics(events: DataFrame, servers: str):
    """A Kafka writer for events with a topic column, keyed by urn.

    Keys keep the order of a urn's events.  Needs the Kafka connector on the
    class path.
    """
    body = F.to_json(F.struct(*[c for c in events.columns if c != "topic"]))
    rows = events.select("topic", F.col("urn").alias("key"), body.alias("value"))
    return rows.write.format("kafka").option("kafka.bootstrap.servers", servers)
