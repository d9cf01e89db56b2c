"""Documents in shards whose companions are files: a map over the documents can look up what belongs to its shard
without shuffling any text.

The copy in the shared folder carries the number of the shard of each row: ROWS consecutive rows of a task make one. A
table with a `shard` column is written into as many files as the session has partitions, each sorted by shard; the
index of files goes to the tasks, which read only the row groups of their own shard. It does not matter how Spark
splits the copy later, as every row names its shard.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import store

ROWS_BITS = 11  #: a shard is 2 ** ROWS_BITS rows


def sharded(docs: DataFrame, id_col: str, text_col: str, extra: list[str] = ()) -> DataFrame:
    """id, text, tag (64-bit hash of the text, to tell rows that repeat an id apart), shard, and x_0, x_1 ... for the
    extra columns."""
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), *[F.col(c).alias(f"x_{k}") for k, c in enumerate(extra)])
    shard = F.shiftright(F.monotonically_increasing_id(), ROWS_BITS)
    return store.written(base.select("id", "text", F.xxhash64("text").alias("tag"), shard.alias("shard"), *[f"x_{k}" for k in range(len(extra))]), "shards")


@dataclass(frozen=True)
class Companion:
    """A table by shard: shard s is in file s mod `parts`, where there is one."""

    path: str
    parts: int
    files: dict[int, str]

    def frame(self, spark) -> DataFrame:
        return spark.read.parquet(self.path)

    def rows(self, shard: int, columns: list[str]):
        """The rows of a shard as an Arrow table; None if it has none. Called in tasks."""
        import pyarrow.compute as pc
        import pyarrow.parquet as pq

        name = self.files.get(shard % self.parts)
        if name is None:
            return None
        fs, base = store.opened(self.path)
        with fs.open_input_file(f"{base}/{name}") as f:
            file = pq.ParquetFile(f)
            at = file.schema_arrow.get_field_index("shard")
            groups = []
            for g in range(file.num_row_groups):
                stats = file.metadata.row_group(g).column(at).statistics
                if stats is None or not stats.has_min_max or stats.min <= shard <= stats.max:
                    groups.append(g)
            if not groups:
                return None
            table = file.read_row_groups(groups, columns=[*columns, "shard"], use_threads=False)
            table = table.filter(pc.equal(table.column("shard"), shard))
        return table.select(columns) if table.num_rows else None


def companions(df: DataFrame, name: str) -> Companion:
    """Writes a table with a `shard` column by shard."""
    spark = df.sparkSession
    path, n = store.fresh(spark, name), store.partitions(spark)
    placed = df.repartitionById(n, F.pmod("shard", F.lit(n)).cast("int")).sortWithinPartitions("shard")
    placed.write.option("compression", "zstd").option("parquet.block.size", 2 << 20).parquet(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    listed = at.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(at)
    names = [s.getPath().getName() for s in listed]
    return Companion(path, n, {int(m[1]): x for x in names if (m := re.match(r"part-(\d+)-.*\.parquet$", x))})
