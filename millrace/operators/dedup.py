"""Exact n-gram deduplication, first-seen sets, quotas and interval merging."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType
from pyspark.sql.window import Window

from millrace.functions import text as T


class _Hashes(dict):
    """64-bit hashes of words, as many as are kept."""

    MOST = 500_000

    def __missing__(self, word: str) -> int:
        if len(self) >= self.MOST:
            self.clear()
        self[word] = h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
        return h


_HASHES = _Hashes()


def gram_hashes(words: list[str], n: int):
    """The hash of every run of n words, as 64-bit integers: a polynomial of the words' hashes, modulo 2^64. The factor is
    odd, so runs that differ in one word never meet, and others do as seldom as random numbers."""
    import numpy as np

    w = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
    m = max(len(words) - n + 1, 0)
    h = np.zeros(m, np.uint64)
    for j in range(n if m else 0):
        h = h * np.uint64(0x9E3779B97F4A7C15) + w[j : j + m]
    return h.view(np.int64)


def _grams(text: pd.Series, n: pd.Series, distinct: pd.Series) -> pd.Series:
    import numpy as np

    found = [gram_hashes((t or "").split(), k) for t, k in zip(text, n)]
    return pd.Series([np.unique(g) if one else g for g, one in zip(found, distinct)], dtype=object)


_grams_of = F.pandas_udf(_grams, ArrayType(LongType())).asNondeterministic()


def grams(df: DataFrame, keys: list[str], n: int, text: str = "text", distinct: bool = False) -> DataFrame:
    """keys, g: the 64-bit hash of every run of n lower-case words, or of every distinct one of a row. Hashes, not words,
    are what later steps shuffle; they are worked out a text at a time in Arrow batches."""
    g = _grams_of(F.lower(T.text_of(text)), F.lit(n), F.lit(distinct))
    return df.select(*keys, g.alias("_g")).select(*keys, F.explode("_g").alias("g"))


def gram_counts(df: DataFrame, key: str, n: int, text: str = "text", together: int = 1_000_000) -> DataFrame:
    """key, g, n: how often each n-gram occurs under a key, in rows that a task has added up, some texts at a time; other
    tasks have rows of the same key and n-gram."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        held, total = {}, 0

        def counted():
            for k, found in held.items():
                g, c = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([k] * len(g), kind), pa.array(g), pa.array(c.astype(np.int64))], names=["key", "g", "n"])

        for batch in batches:
            kind = batch.schema.field(0).type
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                g = gram_hashes(t.split(), n)
                if len(g):
                    held.setdefault(k, []).append(g)
                    total += len(g)
            if total >= together:
                yield from counted()
                held, total = {}, 0
        yield from counted()

    rows = df.select(F.col(key).alias("key"), F.lower(T.text_of(text)).alias("t"))
    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(run, f"key {kind}, g bigint, n bigint").withColumnRenamed("key", key)


def ngram_dedup(docs: DataFrame, n: int = 13, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_paragraphs, n_dropped, doc_dropped: old-both deduplication, exact and independent of task order.

    A paragraph goes when at least `threshold` of its distinct n-grams occur in an earlier paragraph (of the order of
    document, then place); a document goes by the same test over its paragraphs' n-grams. Paragraphs under n words
    never go. Hashes are worked out and shuffled once, and their first places found among the rows that meet: a task sorts
    small rows of fixed size, on disk if need be. Repeats in a paragraph go in its row.
    """
    p = docs.select(F.col(id_col).alias("d"), F.posexplode(F.split(T.text_of(text_col), "\n")).alias("k", "para"))
    g = grams(p, ["d", "k"], n, "para", distinct=True)
    first = F.min(F.struct("d", "k")).over(Window.partitionBy("g"))
    seen = g.withColumn("first", first).select("d", "k", (F.struct("d", "k") > F.col("first")).cast("int").alias("seen"))
    per = seen.groupBy("d", "k").agg(F.count("*").alias("n"), F.sum("seen").alias("s"))
    doc = per.groupBy("d").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.count_if(F.col("s") >= threshold * F.col("n")).alias("n_dropped"))
    sizes = docs.select(F.col(id_col).alias("d"), F.size(F.split(T.text_of(text_col), "\n")).cast("long").alias("n_paragraphs"))
    out = sizes.join(doc, "d", "left")
    return out.select(F.col("d").alias(id_col), "n_paragraphs", F.coalesce("n_dropped", F.lit(0)).alias("n_dropped"), F.coalesce(F.col("s") >= threshold * F.col("n"), F.lit(False)).alias("doc_dropped"))


def stratified(df: DataFrame, by: str, rare: str, share: float, seed: str, key: str = "doc_id") -> DataFrame:
    """All rows of the rare stratum, and of the others, in proportion, as many as make it `share` of the whole: those with
    the smallest hashes.

    Rows are counted by the first 16 bits of the hash. Whole classes are taken until the quota falls inside one, and
    only that class is sorted, so no task sorts a stratum."""
    c = df.groupBy(by).agg(F.count("*").alias("n"))
    r, o = (c.agg(F.sum(F.when(F.col(by) == rare, x).otherwise(y))).scalar() for x, y in ((F.col("n"), F.lit(0)), (F.lit(0), F.col("n"))))
    want = F.bround(r * (1 - share) / share, 0)
    quotas = c.select(by, F.when(F.col(by) == rare, F.col("n")).otherwise(F.least(F.col("n"), F.bround(want * F.col("n") / o, 0))).alias("_quota"))
    h = df.withColumn("_h", F.md5(F.concat(F.lit(seed), F.col(key).cast("string")))).withColumn("_c", F.substring("_h", 1, 4))
    classes = h.groupBy(by, "_c").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(by).orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    taken = classes.withColumn("_before", before).join(quotas, by).where("_before < _quota").select(by, "_c", (F.col("_quota") - F.col("_before")).alias("_left"), "_n")
    rows = h.join(taken, [by, "_c"])
    edge = rows.where("_n > _left").withColumn("_k", F.row_number().over(Window.partitionBy(by, "_c").orderBy("_h", key))).where("_k <= _left")
    return rows.where("_n <= _left").select(key, by).unionByName(edge.select(key, by))


def merge_intervals(df: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """Intervals of a key that overlap or touch become one: key, a, b, n."""
    w = Window.partitionBy(key).orderBy(a, b)
    m = df.withColumn("_prev", F.max(b).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    g = m.withColumn("_i", F.sum(F.when(F.col("_prev").isNull() | (F.col(a) > F.col("_prev") + 1), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return g.groupBy(key, "_i").agg(F.min(a).alias(a), F.max(b).alias(b), F.count("*").alias("n")).drop("_i")
