"""Written tables go when nothing can read them any longer, and not before."""

import os
import time

from pyspark.sql import functions as F

from aspectra.sources import scratch


def released(spark, path):
    for _ in range(20):
        scratch.release(spark)
        if not os.path.exists(path):
            return True
        time.sleep(0.1)
    return False


def test_written_tables_go_with_their_last_reader(spark):
    table = scratch.written(spark.range(100), "swept")
    path = os.path.dirname(table.inputFiles()[0]).removeprefix("file://")
    assert os.path.isdir(path)
    derived = table.join(table.groupBy((F.col("id") % 7).alias("id")).count(), "id")
    del table
    for _ in range(3):
        scratch.release(spark)
    assert derived.count() == 7 and os.path.isdir(path)
    other = derived.filter("count > 14")
    del derived
    scratch.release(spark)
    assert sorted(r.id for r in other.collect()) == [0, 1]
    del other
    assert released(spark, path)


def test_kept_tables_and_views_stay_readable(spark):
    scratch.written(spark.range(10), "viewed").createOrReplaceTempView("viewed_table")
    for _ in range(3):
        scratch.release(spark)
    assert spark.table("viewed_table").count() == 10
    spark.catalog.dropTempView("viewed_table")
