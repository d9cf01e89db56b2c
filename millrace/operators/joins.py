"""Joins that are more than an equality: unique-key fallbacks, first-wins text joins and ordered alignment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import head_in


def unique_on(df: DataFrame, key: str) -> DataFrame:
    """Rows whose key occurs once: a count by key, then a join that leaves out the others."""
    once = df.groupBy(key).agg(F.count("*").alias("_n")).where("_n = 1").drop("_n")
    return df.join(once, key)


def fallback_join(left: DataFrame, right: DataFrame, first: str, second: str, columns: list[str]) -> DataFrame:
    """Each left row with the right row of the same `first` key, else that of the same `second` key if it is unique on
    the right, else nulls; `join_kind` says which."""
    a = right.dropDuplicates([first]).select(F.col(first), F.lit(True).alias("_a"), *[F.col(c).alias(f"_a_{c}") for c in columns])
    b = unique_on(right, second).select(F.col(second), F.lit(True).alias("_b"), *[F.col(c).alias(f"_b_{c}") for c in columns])
    j = left.join(a, first, "left").join(b, second, "left")
    kind = F.when(F.col("_a"), F.lit(first)).when(F.col("_b"), F.lit(second)).otherwise(F.lit("none"))
    picked: list[Column] = [F.when(F.col("_a"), F.col(f"_a_{c}")).otherwise(F.col(f"_b_{c}")).alias(c) for c in columns]
    return j.select(*[c for c in left.columns], kind.alias("join_kind"), *picked)


def text_join(left: DataFrame, right: DataFrame, shard: str, text: str, order: str, columns: list[str]) -> DataFrame:
    """Equality of texts inside a shard, by digest and length; the right row first in `order` wins, `n_matches` counts all."""
    h = F.md5(text)
    r = right.groupBy(shard, h.alias("_h"), F.length(text).alias("_n")).agg(F.count("*").alias("n_matches"), *[F.min_by(c, order).alias(c) for c in columns])
    out = left.withColumn("_h", h).withColumn("_n", F.length(text)).join(r, [shard, "_h", "_n"], "left").drop("_h", "_n")
    return out.withColumn("n_matches", F.coalesce("n_matches", F.lit(0)))


def aligned(step1: DataFrame, step2: DataFrame, shard: str, row: str, look: int = 4) -> DataFrame:
    """Ordered alignment of two row lists of a shard: each step-2 row takes the first of the next `look` step-1 rows
    whose head holds its first words in order; the pointer moves past a match and stays at a miss.

    Which pairs could match is decided by a native expression; only the pointer walk, over integers, is a grouped
    function. Shards are files of bounded size.
    """
    import pandas as pd

    def walk(key, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        heads = a.sort_values("row")["head"].tolist()
        rows = a.sort_values("row")["row"].tolist()
        out, at = [], 0
        for r, words in b.sort_values("row")[["row", "words"]].itertuples(index=False):
            for k in range(at, min(at + look, len(heads))):
                pos = 0
                for w in words:
                    j = heads[k].find(w, pos)
                    if j < 0:
                        break
                    pos = j + len(w)
                else:
                    if len(words):
                        out.append((key[0], int(r), int(rows[k])))
                        at = k + 1
                        break
        return pd.DataFrame(out, columns=["shard", "row", "match"])

    first = F.slice(F.regexp_extract_all(F.lower(F.substring("text", 1, 200)), F.lit(r"([a-z0-9]{3,})"), 1), 1, 6)
    a = step1.select(F.col(shard).alias("shard"), F.col(row).alias("row"), "head")
    b = step2.select(F.col(shard).alias("shard"), F.col(row).alias("row"), first.alias("words"))
    return a.groupBy("shard").cogroup(b.groupBy("shard")).applyInPandas(walk, "shard string, row long, match long")


def head_checked(step1: DataFrame, step2: DataFrame, keys: list[str]) -> DataFrame:
    """Positional join that keeps only rows whose head check holds."""
    return step1.join(step2, keys).where(head_in(F.col("text"), F.col("head")))
