"""Sources and sinks for sharded corpora."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType


def jsonl(spark: SparkSession, path: str, schema: StructType, tolerant: bool = True) -> DataFrame:
    """JSON lines, plain or gzipped. With `tolerant`, a line that is not JSON becomes a row whose `_corrupt` holds it, so
    bad lines are counted and not fatal; without, the first one fails the read. Blank lines are skipped either way.
    Gzip files are one task each; repartition behind a scan of few large ones."""
    reader = spark.read.option("mode", "PERMISSIVE" if tolerant else "FAILFAST")
    if tolerant:
        schema = StructType([*schema.fields, StructField("_corrupt", StringType())])
        reader = reader.option("columnNameOfCorruptRecord", "_corrupt")
    return reader.schema(schema).json(path)


def bad_lines(df: DataFrame) -> DataFrame:
    return df.agg(F.count_if(F.col("_corrupt").isNotNull()).alias("bad"), F.count("*").alias("rows"))


def damaged(spark: SparkSession):
    """Reads keep what precedes an error in a damaged file. The setting holds for the session."""
    spark.conf.set("spark.sql.files.ignoreCorruptFiles", "true")
    return spark


def with_shard(df: DataFrame) -> DataFrame:
    """Adds `stem`, the file's name without directories and suffixes."""
    return df.withColumn("stem", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+?)(\.jsonl)?(\.gz|\.parquet)?$", 1))


def write_jsonl(df: DataFrame, path: str, by: str | None = None) -> None:
    """Gzipped JSON lines; Spark's committer renames whole files into place. With `by`, one folder a shard, and only the
    shards that are written are replaced."""
    w = df.write.mode("overwrite").option("compression", "gzip")
    if by:
        w = w.partitionBy(by).option("partitionOverwriteMode", "dynamic")
    w.json(path)


def resumable(df: DataFrame, done: DataFrame, stem: str = "stem") -> DataFrame:
    """The rows of shards that are not done yet."""
    return df.join(done.select(stem).distinct(), stem, "left_anti")


def verified_done(output: DataFrame, manifest: DataFrame, stem: str = "stem", order: str = "row", text: str = "text") -> DataFrame:
    """Shards whose output still has the digest that their manifest names. The digest is over per-row digests in order."""
    rows = output.groupBy(stem).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.struct(order, F.sha2(text, 256).alias("h")))).getField("h"), ""), 256).alias("sha256"))
    return rows.join(manifest, [stem, "sha256"], "left_semi").select(stem)


def shard_list(paths: DataFrame, contains: str = "", start: int = 0, count: int | None = None) -> DataFrame:
    """path, k of the paths that hold a substring, places start .. start + count - 1 of the sorted list."""
    from pyspark.sql.window import Window

    k = paths.where(F.contains("path", F.lit(contains))).withColumn("k", F.row_number().over(Window.orderBy("path")) - 1)
    k = k.where(F.col("k") >= start)
    return k if count is None else k.where(F.col("k") < start + count)


def _numbered(stems: DataFrame) -> DataFrame:
    """stem, idx: places in the sorted list of shards, which is a list of file names."""
    from pyspark.sql.window import Window

    return stems.select("stem", (F.row_number().over(Window.orderBy("stem")) - 1).cast("long").alias("idx"))


def todo(stems: DataFrame, outputs: DataFrame) -> DataFrame:
    """stem, idx, damaged of shards without a readable output; `outputs` has stem and readable."""
    j = _numbered(stems).join(outputs.select("stem", "readable"), "stem", "left")
    return j.where("readable is null or not readable").select("stem", "idx", F.col("readable").isNotNull().alias("damaged"))


def strided(stems: DataFrame, workers: int) -> DataFrame:
    """stem, idx, worker: worker w takes the shards w, w + workers, ... of the sorted list."""
    return _numbered(stems).withColumn("worker", F.pmod("idx", F.lit(workers)))


def row_counts(spark: SparkSession, **legs: str) -> DataFrame:
    """stem and the rows of each Parquet leg, to validate that legs agree; a shard that a leg lacks has null there."""
    out = None
    for name, path in legs.items():
        c = with_shard(spark.read.parquet(path)).groupBy("stem").agg(F.count("*").alias(name))
        out = c if out is None else out.join(c, "stem", "full")
    return out


def metadata_fields(c):
    """record id and URI of metadata that is JSON or a Python mapping's repr, by pattern."""
    field = lambda k: F.regexp_extract(c, rf"""['"]{k}['"]\s*:\s*['"]([^'"]*)['"]""", 1)
    return F.struct(field("WARC-Record-ID").alias("record_id"), field("WARC-Target-URI").alias("uri"))


def rank_log(spark: SparkSession, path: str) -> DataFrame:
    """file, rank, stem, pages, kept, counters of lines like `rank 3 stem: pages 10 kept 7 {"a": 1}`."""
    p = r"rank (\d+) (\S+): pages (\d+) kept (\d+) (\{.*\})?"
    t = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), "value").where(F.col("value").rlike(p))
    x = lambda i: F.regexp_extract("value", p, i)
    return t.select("file", x(1).cast("long").alias("rank"), x(2).alias("stem"), x(3).cast("long").alias("pages"), x(4).cast("long").alias("kept"), F.from_json(F.regexp_replace(x(5), "'", '"'), "map<string,bigint>").alias("counters"))


def with_gpu_hours(rows: DataFrame) -> DataFrame:
    """Adds gpus and gpu_hours to accounting rows (AllocTRES, ElapsedRaw)."""
    gpus = F.coalesce(F.regexp_extract("AllocTRES", r"gres/gpu=(\d+)", 1).try_cast("long"), F.lit(0))
    return rows.withColumn("gpus", gpus).withColumn("gpu_hours", F.col("ElapsedRaw").cast("long") * gpus / 3600)


def parsed_accounting(lines: DataFrame, header: str, value: str = "value") -> DataFrame:
    """Bar-separated accounting rows by the names of their header, with gpus and gpu_hours."""
    cells = F.split(value, r"\|")
    return with_gpu_hours(lines.select(*[F.get(cells, F.lit(i)).alias(n) for i, n in enumerate(header.split("|"))]))


def accounting(spark: SparkSession, path: str) -> DataFrame:
    """Bar-separated job accounting rows of a file with a header, and gpu_hours from elapsed seconds and the devices."""
    return with_gpu_hours(spark.read.option("sep", "|").option("header", "true").csv(path))
