"""Session helper shared by bench, tests and ad-hoc jobs."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def build_session(app: str = "evidex", cpus: int | None = None, **conf: str) -> SparkSession:
    """A local session; on a cluster the submitter's own session is used instead."""
    cpus = cpus or os.cpu_count() or 8
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
