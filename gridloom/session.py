"""Session factory for tests, the benchmark and local use; clusters bring their own session."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def local_session(cores: int = 8, app: str = "gridloom", **extra: str) -> SparkSession:
    """A local session with adaptive execution, UTC timestamps and few shuffle partitions."""
    conf = {
        "spark.sql.shuffle.partitions": str(max(2, cores)),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": os.environ.get("GRIDLOOM_DRIVER_MEMORY", "8g"),
        "spark.driver.host": "127.0.0.1",
    } | extra
    spark = SparkSession.builder.master(f"local[{cores}]").appName(app).config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
