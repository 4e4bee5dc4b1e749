"""Tables that cut lineage, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import contextlib
import gc
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Folders used where the session names none (single-machine tests only).
_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The shared folder, from ``spark.checkpoint.dir``.

    Where the setting is unset on a local master (tests on one machine) a
    temporary folder is made once per application; on a cluster that raises,
    as executors would not see such a folder.
    """
    context = spark.sparkContext
    named = (
        spark.conf.get("spark.checkpoint.dir", None)
        or context.getConf().get("spark.checkpoint.dir")
        or context.getCheckpointDir()
    )
    if named:
        return named.rstrip("/")
    if not re.match(r"local(\[|$)", context.master):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = context.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = "file://" + tempfile.mkdtemp(prefix="aspectra-")
    return _LOCAL[app]


#: (JVM, Hadoop settings, path) of what this application has made.
_MADE: list[tuple[object, object, str]] = []


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new path under the shared folder.

    What is there is deleted when the driver ends (what :func:`written` made, as
    soon as nothing can read it): frames that read it cannot be used any longer
    then.
    """
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    _MADE.append((spark._jvm, spark._jsc.hadoopConfiguration(), path))
    return path


#: Weak references to the file indexes of written tables, by path.
_READ: dict[str, object] = {}


def _delete(jvm, settings, path: str) -> None:
    with contextlib.suppress(Exception):  # the JVM may have gone
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(settings).delete(where, True)


@atexit.register
def _clean() -> None:
    for made in _MADE:
        _delete(*made)


def _watch(table: DataFrame, path: str) -> None:
    """Notes the file index that every plan over ``table`` refers to."""
    plan = table._jdf.queryExecution().analyzed()
    if plan.getClass().getSimpleName() == "LogicalRelation":
        _READ[path] = table.sparkSession._jvm.java.lang.ref.WeakReference(plan.relation().location())


def sweep() -> None:
    """Deletes written tables that no frame and no plan of the JVM can read any longer."""
    for made in [*_MADE]:
        index = _READ.get(made[-1])
        gone = False
        with contextlib.suppress(Exception):  # of a JVM that has gone
            gone = index is not None and index.refersTo(None)
        if gone:
            del _READ[made[-1]]
            _MADE.remove(made)
            _delete(*made)


def release(spark: SparkSession) -> None:
    """Collects garbage here and in the JVM, then sweeps; Spark's cleaner drops shuffle files then."""
    gc.collect()
    spark._jvm.System.gc()
    sweep()


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again.

    This cuts lineage: a lost executor never makes later stages repeat what
    led to the table.  The table stays while a frame can read it.
    """
    spark = df.sparkSession
    sweep()
    path = fresh_path(spark, label)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _watch(out, path)
    return out
