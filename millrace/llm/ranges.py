"""Contiguous, deterministic key ranges of about equal weight.

A sampled range partitioner gives other bounds on every run. Here the bounds come from exact weights of equal-width
bins, which are refined where a bin is too heavy; only a fixed number of bins reaches the driver in each round.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BINS = 4096  #: of a round, in all ranges together, if there are fewer ranges
RANGES = 512  #: that one round refines at most, the heaviest ones
ROUNDS = 12


def cuts(df: DataFrame, key: str, weight: Column, shards: int) -> list[int]:
    """Ascending first keys of the ranges after the first one; at most shards - 1 of them. Null keys have no weight.

    One aggregate a round counts all bins of all ranges that are still too heavy; at most BINS or twice RANGES sums
    reach the driver. Ranges beyond RANGES wait for a later round; those left after the last one are cut evenly."""
    lo, hi, total = df.select(F.min(key), F.max(key), F.sum(F.when(F.col(key).isNotNull(), weight))).first()
    if lo is None or shards < 2 or not total:
        return []
    target = total / shards
    todo, bins, waiting = [(lo, hi, total)], [], []
    for _ in range(ROUNDS):
        todo.sort()
        per = max(2, BINS // len(todo))
        widths = [max(1, -(-(b - a + 1) // per)) for a, b, _ in todo]
        edges = sorted({x for a, b, _ in todo for x in (a, b + 1)} - {lo})
        where = {a: i for i, (a, _, _) in enumerate(todo)}
        nth = [where.get(x, -1) for x in [lo, *edges]]
        pick = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), F.col("_r") + 1)
        placed = df.where(F.col(key).between(lo, hi)).withColumn("_r", shard_of(key, [x for x in edges if x <= hi]))
        placed = placed.withColumn("_i", pick(nth)).where("_i >= 0").withColumn("_w", weight).select(F.col(key).cast("decimal(38,0)").alias("_k"), "_i", "_w")
        low = F.element_at(F.array(*[F.lit(str(a)) for a, _, _ in todo]), F.col("_i") + 1).cast("decimal(38,0)")
        width = F.element_at(F.array(*[F.lit(str(w)) for w in widths]), F.col("_i") + 1).cast("decimal(38,0)")
        binned = placed.withColumn("_d", F.col("_k") - low).withColumn("_width", width).select("_i", F.expr("_d div _width").alias("_bin"), "_w")
        rows = binned.groupBy("_i", "_bin").agg(F.sum("_w").alias("_w")).collect()
        found = []
        for r in rows:
            a, b, _ = todo[r._i]
            found.append((a + r._bin * widths[r._i], min(b, a + (r._bin + 1) * widths[r._i] - 1), r._w))
        heavy = sorted((x for x in found + waiting if x[2] > target and x[1] > x[0]), key=lambda x: -x[2])
        bins += [x for x in found if x not in heavy]
        todo, waiting = heavy[:RANGES], heavy[RANGES:]
        if not todo:
            break
    for a, b, w in todo + waiting:
        n = min(b - a + 1, -(-w // int(target) if target >= 1 else w))
        bins += [(a + k * (b - a + 1) // n, 0, w / n) for k in range(int(n))]
    out, run = [], 0.0
    for a, _, w in sorted(bins):
        if run and run + w / 2 > target:
            out.append(a)
            run = 0.0
        run += w
    return out


def shard_of(key: str, bounds: list[int]) -> Column:
    """The number of the range that `key` falls in; nulls come first. A binary search, written as nested CASEs."""

    def search(lo: int, hi: int) -> str:
        if lo == hi:
            return str(lo)
        mid = (lo + hi) // 2
        return f"if(`{key}` is null or `{key}` < {bounds[mid]}, {search(lo, mid)}, {search(mid + 1, hi)})"

    return F.expr(search(0, len(bounds)))
