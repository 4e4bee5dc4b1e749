"""Sessions with the settings that the library's results rely on."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def build_session(
    master: str | None = None, app: str = "aspectra", partitions: int | None = None
) -> SparkSession:
    """A session in UTC with adaptive execution; existing ones are reused.

    ``master``: left to spark-submit where None and a cluster is configured.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if master:
        builder = builder.master(master).config(
            "spark.driver.memory", os.environ.get("ASPECTRA_DRIVER_MEMORY", "8g")
        )
    if partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(partitions))
    return builder.getOrCreate()
