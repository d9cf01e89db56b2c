"""Corpus pipeline: quality rules, near-duplicate removal, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; its result is written as
Parquet and read again as the next stage's docs. All stages but the last return the columns of documents.

A stage's result is lazy and reads tables that its operator left in the shared folder. They are noted for each call; the
next stage removes those of stages whose results its own docs do not read, and `run` those of its stages. Results of
other operators are never touched. So a stage's result is written before the next stage is called on what was written,
as `run` does, or passed to it directly.

Defined results, for all stages: an empty table gives an empty table; columns other than those of documents are left
out, whatever their names; a null text is like an empty one. Rows with a null doc_id: the rules judge them like others,
the deduplicating stages keep them whole, and packing packs them. Rows that repeat a doc_id: the rules judge each;
near_dedup keeps or removes all rows of an id together; substring_dedup treats them as documents of which neither is
earlier; packing packs each. Very long texts are taken whole.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import minhash, packing, phrases, quality, store

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
_LEFT: dict[str, list[list[str]]] = {}


def _noted(spark: SparkSession, docs: DataFrame, operator: Callable[[], DataFrame]) -> DataFrame:
    """Calls an operator and notes the tables it leaves; first removes those of earlier stages that `docs` does not read."""
    app, read, still = spark.sparkContext.applicationId, docs.inputFiles(), []
    for paths in _LEFT.pop(app, []):
        if any(p.rpartition("/")[2] in f for p in paths for f in read):
            still.append(paths)
        else:
            store.clear(spark, paths)
    with store.scope() as paths:
        out = operator()
    _LEFT[app] = [*still, paths]
    return out


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return _noted(spark, docs, lambda: quality.passing(docs, "v1", keep=COLUMNS[1:]).select(*COLUMNS))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, that with the smallest id."""

    def kept() -> DataFrame:
        gone = minhash.near_duplicates(docs).where("not kept").select("doc_id")
        # the ids grow with the corpus: a plan that holds at every size, not a broadcast while they are few
        return docs.join(gone.distinct().hint("merge"), "doc_id", "left_anti").select(*COLUMNS)

    return _noted(spark, docs, kept)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 20 words or more that occur earlier are cut out of the texts."""

    def cut() -> DataFrame:
        rest = phrases.without_repeats(docs, with_text=True, extra=["lang", "source"])
        return rest.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.length("kept_text").cast("long").alias("n_chars"))

    return _noted(spark, docs, cut)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces and their places in sequences of 1024 tokens."""
    return _noted(spark, docs, lambda: packing.pack(packing.pieces(docs)))


STAGES = [("quality_rules", quality_rules), ("near_dedup", near_dedup), ("substring_dedup", substring_dedup), ("best_fit_packing", best_fit_packing)]

#: SQL has no tokenizer, so the last stage, and with it the whole, has no counterpart; tests hold it against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents. Each stage's output is removed once the next one is written; the last stays."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    out, before = f"{store.shared_dir(spark)}/millrace-pipeline-{uuid.uuid4().hex}", None
    for name, stage in STAGES:
        docs = store.written(stage(spark, docs, sf_dir), name, f"{out}/{name}")
        for paths in _LEFT.pop(spark.sparkContext.applicationId, []):
            store.clear(spark, paths)
        if before is not None:
            store.dropped(before)
        before = docs
    return docs
