"""Session construction and the few settings that every plan relies on."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

#: Results are compared in UTC; AQE re-plans joins and merges small shuffle partitions at run time.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def get_session(app: str = "brindle", cpus: int | None = None, partitions: int = 8, **extra: str) -> SparkSession:
    """A local session for tests and benchmarks; on a cluster pass the cluster's own session instead."""
    conf = SETTINGS | {
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": os.environ.get("BRINDLE_DRIVER_MEMORY", "12g"),
    } | extra
    spark = SparkSession.builder.master(f"local[{cpus or '*'}]").appName(app).config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
