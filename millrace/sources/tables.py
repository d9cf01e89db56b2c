"""Access to the fixed tables of a data directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table `name` below `sf_dir`; any path that Spark can read will do. What goes to Python goes few rows at
    a time, as one text can be very long, so that a worker's memory does not depend on the size of the table."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "512")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "16m")
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
