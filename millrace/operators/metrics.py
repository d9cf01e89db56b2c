"""Page-aligned metrics as aggregates."""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from millrace.functions import text as T


def token_counts(df: DataFrame, key: str, text: str, name: str) -> DataFrame:
    """key, tok, name: the multiset of tokens of each text."""
    t = df.select(key, F.explode(T.tokens(T.text_of(text))).alias("tok"))
    return t.groupBy(key, "tok").agg(F.count("*").alias(name))


@F.pandas_udf(StructType([StructField(n, LongType()) for n in ("n_sys", "n_ref", "n_both")]))
def _shared(system: pd.Series, reference: pd.Series, n: pd.Series) -> pd.DataFrame:
    out = []
    for s, r, k in zip(system, reference, n):
        a, b = s.split(), r.split()
        if k > 1:
            a, b = (list(zip(*[x[i:] for i in range(k)])) for x in (a, b))
        x, y = Counter(a), Counter(b)
        if len(y) < len(x):
            x, y = y, x
        out.append((len(a), len(b), sum(min(c, y[t]) for t, c in x.items() if t in y)))
    return pd.DataFrame(out, columns=["n_sys", "n_ref", "n_both"])


def shared_counts(system: Column, reference: Column, n: int = 1) -> Column:
    """n_sys, n_ref, n_both of the multisets of n-grams of two token arrays. Both texts are in the row, so they are counted
    there: the tokens are found by Catalyst, the multisets met in Arrow batches, and nothing is shuffled."""
    return _shared(F.array_join(system, " "), F.array_join(reference, " "), F.lit(n))


def overlap(df: DataFrame, key: str, system: str, reference: str) -> DataFrame:
    """key, n_sys, n_ref, n_both of the token multisets; a map."""
    c = df.select(key, shared_counts(T.tokens(T.text_of(system)), T.tokens(T.text_of(reference))).alias("c"))
    return c.select(key, "c.n_sys", "c.n_ref", "c.n_both")


def worth_showing(faith: str, chars: str, words: str, lines: str) -> Column:
    """Faithful prose of some length, and no list of titles (fixed values)."""
    n = F.col(words)
    return (F.col(faith) >= 0.92) & (F.col(chars) > 150) & (F.col(chars) < 6000) & (n >= 60) & (F.col(lines) >= 2) & (n / F.col(lines) >= 12)


def candidate_score(faith: str, edu: str, chars: str) -> Column:
    return F.round(60 * (F.col(faith) - 0.92) + 2 * F.least(F.lit(2.0), edu) + F.when(F.col(chars) > 3000, 1.5).otherwise(0.0), 6)


def longest_common(a: list, b: list) -> int:
    """Length of the longest common subsequence, by bits of one integer a row."""
    at: dict = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for y in b:
        u = v & at.get(y, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


@F.pandas_udf(DoubleType())
def rouge_l(system: pd.Series, reference: pd.Series) -> pd.Series:
    """F1 of the longest common subsequence of lower-case words."""

    def one(s, r):
        a, b = (s or "").lower().split(), (r or "").lower().split()
        return 2 * longest_common(a, b) / (len(a) + len(b)) if a or b else 0.0

    return pd.Series([one(s, r) for s, r in zip(system, reference)], dtype=float)


def prf(n_sys: Column, n_ref: Column, n_both: Column) -> tuple[Column, Column, Column]:
    """Precision, recall, F1; an empty system has precision 1, an empty reference recall 1."""
    p = F.when(n_sys == 0, F.lit(1.0)).otherwise(n_both / n_sys)
    r = F.when(n_ref == 0, F.lit(1.0)).otherwise(n_both / n_ref)
    return p, r, F.when(p + r == 0, F.lit(0.0)).otherwise(2 * p * r / (p + r))


def index_quantile(values: Column, p: float) -> Column:
    """xs[int(p * n)] of the ascending values, not interpolated."""
    xs = F.array_sort(F.collect_list(values))
    return F.element_at(xs, F.least(F.size(xs), F.floor(F.lit(p) * F.size(xs)).cast("int") + 1))


_POISSON = [0.36787944, 0.73575888, 0.91969860, 0.98101184, 0.99634015, 0.99940582]  # the distribution function of mean 1


def bootstrap(df: DataFrame, key: str, ratios: dict[str, tuple[Column, Column]], replicates: int) -> DataFrame:
    """metric, low, mean, high: 95 % percentile intervals of ratios of sums over resampled rows. The weight of a row in a
    replicate is a Poisson draw made from the hash of its key and the replicate's number, so results do not depend on how
    rows are split."""
    names = list(ratios)

    def sums(batches):
        import numpy as np
        import pyarrow as pa

        total = np.zeros((2 * len(names), replicates))
        number = np.arange(1, replicates + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for batch in batches:
            h = batch.column(0).to_numpy().view(np.uint64)
            values = np.array([c.to_numpy(zero_copy_only=False) for c in batch.columns[1:]], dtype=np.float64).reshape(2 * len(names), -1)
            for k in range(0, len(h), 512):
                x = h[k : k + 512, None] ^ number[None, :]
                for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
                    x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
                u = (x >> np.uint64(11)).astype(np.float64) / (1 << 53)
                total += values[:, k : k + 512] @ np.searchsorted(_POISSON, u, side="right").astype(np.float64)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(names)), replicates).astype("int32")), pa.array(np.tile(np.arange(replicates), len(names)).astype("int32")), pa.array(total[0::2].ravel()), pa.array(total[1::2].ravel())], names=["k", "b", "x", "y"])

    cols = [F.coalesce(c.cast("double"), F.lit(0.0)).alias(f"c{i}{j}") for i, n in enumerate(names) for j, c in enumerate(ratios[n])]
    rows = df.select(F.xxhash64(key).alias("h"), *cols).mapInArrow(sums, "k int, b int, x double, y double")
    each = rows.groupBy("k", "b").agg((F.sum("x") / F.sum("y")).alias("r"))
    name = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("k") + 1)
    return each.groupBy(name.alias("metric")).agg(F.percentile("r", 0.025).alias("low"), F.avg("r").alias("mean"), F.percentile("r", 0.975).alias("high"))


def exact_match(system: Column, reference: Column, case: bool = False, punctuation: bool = False, digits: bool = False, drop: str | None = None) -> Column:
    """Whether two texts are equal once what the options name is left out: case, ASCII punctuation, digits, a pattern."""

    def bare(c):
        for on, pattern in ((drop is not None, drop), (punctuation, r"[!-/:-@\[-`{-~]"), (digits, "[0-9]")):
            c = F.regexp_replace(c, pattern, "") if on else c
        return F.lower(c) if case else c

    return bare(system) == bare(reference)
