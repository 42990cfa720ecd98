"""Session defaults shared by the bench, the tests and the command line."""

from __future__ import annotations

from pyspark.sql import SparkSession


def get_session(master: str = "local[8]", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session with AQE on, UTC, and as many shuffle partitions as asked for."""
    builder = (
        SparkSession.builder.master(master)
        .appName("ridgeline")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
