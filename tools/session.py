"""A local session for tests, comparison and the benchmark."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def session(cpus: int | None = None, partitions: int = 8, memory: str = "8g") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus or 8}]")
        .appName("medcorpus")
        .config("spark.driver.memory", os.environ.get("MEDCORPUS_MEMORY", memory))
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark
