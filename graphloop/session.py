"""A session with the settings that the engine expects; on a cluster these come from its own configuration."""

from __future__ import annotations

from pyspark.sql import SparkSession


def local_session(cpus: int | str = "*", partitions: int = 8, memory: str = "4g", **conf: str) -> SparkSession:
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("graphloop")
    settings = {
        "spark.sql.shuffle.partitions": str(partitions), "spark.driver.memory": memory, "spark.sql.adaptive.enabled": "true", "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
    }
    for k, v in (settings | conf).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
