"""Session construction for tests, the benchmark and interactive use.

Library code never builds a session: it takes the caller's, so that cluster settings stay in force.
"""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cpus: int | str = 8, memory: str = "12g", **conf: str) -> SparkSession:
    """A local session with `cpus` threads; keyword names use `__` for dots."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("millrace")
    settings = DEFAULTS | {
        "spark.driver.memory": os.environ.get("MILLRACE_DRIVER_MEMORY", memory),
        "spark.sql.shuffle.partitions": str(cpus if str(cpus).isdigit() else 8),
    } | {k.replace("__", "."): v for k, v in conf.items()}
    spark = builder.config(map=settings).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
