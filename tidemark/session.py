"""Session defaults shared by the bench, the tests and scripts."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cpus: int | None = None, memory: str = "8g", app: str = "tidemark", **extra: str) -> SparkSession:
    """A local[N] session for tests and benchmarks; on a cluster pass your own session instead."""
    n = cpus or int(os.environ.get("BENCH_CPUS", os.cpu_count() or 8))
    builder = SparkSession.builder.master(f"local[{n}]").appName(app).config("spark.driver.memory", memory)
    for key, value in {**DEFAULTS, "spark.sql.shuffle.partitions": str(n), **extra}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
