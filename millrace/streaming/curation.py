"""The stateless part of curation over a stream of shard files.

The reference workload is batch; new shards arrive as files, so a file stream with one batch per arrival runs the same
expressions. Exact-text duplicates inside a watermark are dropped with bounded state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from millrace.functions import rules as R
from millrace.operators import program as P


def shards(spark: SparkSession, path: str, schema: StructType, files_per_batch: int = 64) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def curated(docs: DataFrame, text: str = "text") -> DataFrame:
    """Rows that break no rule of the stack and leak no operations; stateless, so any trigger and mode will do."""
    d = R.measured(docs, text).withColumn("reasons", F.concat(R.reasons(R.REFINEDWEB), P.postfilter(F.col(text), F.lit("<extract>"))))
    return d.where(F.size("reasons") == 0).drop("m", "reasons")


def first_texts(docs: DataFrame, time: str, delay: str = "1 hour", text: str = "text") -> DataFrame:
    """One row a text within the delay; older state is dropped."""
    return docs.withColumn("_h", F.sha2(text, 256)).withWatermark(time, delay).dropDuplicatesWithinWatermark(["_h"]).drop("_h")
