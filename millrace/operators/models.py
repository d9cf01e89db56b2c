"""Model steps as replaceable columns.

A step is a function from a DataFrame and a text column to the DataFrame with one more column. `replayed` looks recorded
outputs up by the text's digest; `mapped` runs a batch function that each worker loads once. No weights come with the
library.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def replayed(df: DataFrame, text: str, records: DataFrame, output: str) -> DataFrame:
    """`records` has h, the text's md5, and the output column; texts without a record get null. Distinct texts are what
    is joined: the digest is shuffled, never the text twice."""
    known = records.groupBy("h").agg(F.first(output).alias(output))
    return df.withColumn("_h", F.md5(text)).join(known, F.col("_h") == known.h, "left").drop("_h", "h")


def mapped(df: DataFrame, text: str, output: str, kind: str, load: Callable[[], Callable[[list[str]], list]]) -> DataFrame:
    """Runs `load()` once a task and its result over batches of texts."""
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields), f"`{output}` {kind}"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for b in batches:
            yield b.assign(**{output: model(b[text].fillna("").tolist())})

    return df.mapInPandas(run, schema)


def unscored(df: DataFrame, text: str, records: DataFrame) -> DataFrame:
    """h and text of the distinct texts that have no record yet."""
    return df.groupBy(F.md5(text).alias("h")).agg(F.first(text).alias(text)).join(records.select("h").distinct(), "h", "left_anti")
