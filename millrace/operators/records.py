"""Records of systems under evaluation: fields under several names, statuses, alignment and totals."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.functions import text as T


def first_present(df: DataFrame, names: list[str]) -> tuple[Column, Column]:
    """(value, name) of the first of the columns that the table has and that is not null."""
    have = [n for n in names if n in df.columns]
    if not have:
        return F.lit(None).cast("string"), F.lit(None).cast("string")
    return F.coalesce(*have), F.coalesce(*[F.when(F.col(n).isNotNull(), F.lit(n)) for n in have])


def long_format(df: DataFrame, key: str, systems: dict[str, str]) -> DataFrame:
    """key, system, text of every system's output that says anything: not null, not blank, not the word None."""
    rows = df.select(key, F.explode(F.array(*[F.struct(F.lit(n).alias("system"), F.col(c).alias("text")) for n, c in systems.items()])).alias("x")).select(key, "x.*")
    return rows.where(F.col("text").isNotNull() & (F.col("text") != "None") & (T.strip(F.col("text")) != ""))


def system_status(text: Column, found: Column, cleaned: Column) -> Column:
    """kept, deleted, no_input or not_found: what became of a page in a system that reads extracted texts."""
    blank = lambda c: T.strip(F.coalesce(c, F.lit(""))) == ""
    return F.when(blank(text), F.lit("no_input")).when(~found, F.lit("not_found")).when(blank(cleaned), F.lit("deleted")).otherwise(F.lit("kept"))


def running_totals(df: DataFrame, by: str, order: str, value: str, block: int = 4096) -> DataFrame:
    """Adds `before`, the sum of `value` over the rows of the same `by` that come before in `order`, a whole number.

    Two levels, blocks of the order and sums over blocks, so that a key with a third of all rows is many tasks."""
    d = df.withColumn("_b", F.floor(F.col(order) / block))
    inner = Window.partitionBy(by, "_b").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("_in", F.coalesce(F.sum(value).over(inner), F.lit(0)))
    over = Window.partitionBy(by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sums = d.groupBy(by, "_b").agg(F.sum(value).alias("_s")).select(by, "_b", F.coalesce(F.sum("_s").over(over), F.lit(0)).alias("_out"))
    return d.join(sums, [by, "_b"]).withColumn("before", F.col("_in") + F.col("_out")).drop("_b", "_in", "_out")


def merged_manifests(parts: DataFrame) -> DataFrame:
    """One manifest of parts (part, shard, num_sequences): shards are named by their part, so that names stay apart."""
    return parts.select(F.concat(F.lit("p"), F.col("part").cast("string"), F.lit("_"), F.col("shard")).alias("shard"), "num_sequences")


def healed(validate: Callable[[], DataFrame], fix: Callable[[DataFrame], None], rounds: int = 3) -> bool:
    """Validates, fixes what fails and validates again, at most `rounds` times; true once nothing fails."""
    for _ in range(rounds):
        bad = validate()
        if bad.isEmpty():
            return True
        fix(bad)
    return validate().isEmpty()


def within_tolerance(accepted: Column, pool: Column, tolerance: int = 5) -> Column:
    """Whether a backfill accepted all but a few of its pool."""
    return F.abs(pool - accepted) <= tolerance


def template_scores(df: DataFrame, template: str, text: str, program: str, left: str, calls: tuple[str, ...] = ("remove_lines", "normalize")) -> DataFrame:
    """template, ops, kept, words, ok: what a model does under each prompt template, on a sample of pages. A template it
    was trained on gives calls for most pages, blanks few and keeps a sane share of words (limits are fixed values)."""
    has = F.exists(F.split(F.coalesce(F.col(program), F.lit("")), "\n"), lambda x: T.strip(x).rlike(rf"\A(?:{'|'.join(calls)})"))
    some = T.strip(F.coalesce(F.col(left), F.lit(""))) != ""
    n = lambda c: T.n_words(F.coalesce(F.col(c), F.lit("")))
    g = df.groupBy(template).agg((F.count_if(has) / F.count("*")).alias("ops"), (F.count_if(some) / F.count("*")).alias("kept"), (F.coalesce(F.sum(F.when(some, n(left))), F.lit(0)) / F.greatest(F.lit(1), F.coalesce(F.sum(F.when(some, n(text))), F.lit(0)))).alias("words"))
    return g.withColumn("ok", (F.col("ops") >= 0.5) & (F.col("kept") >= 0.5) & F.col("words").between(0.30, 0.999))


def best_template(scores: DataFrame, template: str) -> DataFrame:
    """The acceptable template with most calls, the first name of equals; no row if none is acceptable."""
    return scores.where("ok").orderBy(F.desc("ops"), template).limit(1).select(template)
