"""Shared storage for the operators: intermediate tables, and files that tasks write and read themselves.

The folder is the one the cluster names in spark.checkpoint.dir, which driver and executors share. Only a local
session without that setting gets a folder of its own.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}
_SCOPE: ContextVar[list[str] | None] = ContextVar("scope", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The shared folder, as a URI without a trailing slash."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/") if "://" in at or at.startswith("file:") else f"file://{at.rstrip('/')}"
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = tempfile.mkdtemp(prefix="millrace-")
        atexit.register(shutil.rmtree, _LOCAL[app], ignore_errors=True)
    return f"file://{_LOCAL[app]}"


def fresh(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    path = f"{shared_dir(spark)}/millrace/{name}-{uuid.uuid4().hex}"
    if (paths := _SCOPE.get()) is not None:
        paths.append(path)
    return path


@contextmanager
def scope():
    """The list of the paths that operators called inside make. Their lazy results read what is left there, so a caller
    passes the list to `clear` once those results are written elsewhere; nothing else is ever removed by that."""
    paths: list[str] = []
    token = _SCOPE.set(paths)
    try:
        yield paths
    finally:
        _SCOPE.reset(token)


def clear(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        remove(spark, path)
    paths.clear()


def written(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Writes `df` as Parquet in the shared folder and reads it back: the lineage ends there, and a lost executor
    costs a reread instead of a recomputation."""
    spark = df.sparkSession
    path = path or fresh(spark, name)
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._millrace_path = path
    return out


def dropped(df: DataFrame) -> None:
    """Removes what `written` stored for `df`; call it once nothing reads it any more."""
    remove(df.sparkSession, df._millrace_path)


def remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def arrow_rows(spark: SparkSession, rows: int) -> None:
    """Rows in one Arrow batch sent to Python: few, as one text can be very long; and a limit on its bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "16m")


def opened(uri: str):
    """(filesystem, path) for task-side files; works wherever pyarrow has a file system for the scheme."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))


def partitions(spark: SparkSession, minimum: int = 1) -> int:
    """The number of shuffle partitions the session asks for."""
    return max(minimum, int(spark.conf.get("spark.sql.shuffle.partitions")))
