"""Best-fit decreasing of samples into fixed-length bins, shard by shard, and chunking by budgets."""

from __future__ import annotations

import bisect
import heapq

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def best_fit(lengths: list[int], capacity: int) -> list[int]:
    """The bin of each item: items in descending length, each into the fullest bin that has room."""
    order = sorted(range(len(lengths)), key=lambda i: (-lengths[i], i))
    room: list[tuple[int, int]] = []
    out, bins = [0] * len(lengths), 0
    for i in order:
        k = bisect.bisect_left(room, (lengths[i], -1))
        if k < len(room):
            left, b = room.pop(k)
        else:
            left, b, bins = capacity, bins, bins + 1
        out[i] = b
        if left > lengths[i]:
            bisect.insort(room, (left - lengths[i], b))
    return out


def pack(df: DataFrame, shard: str, key: str, length: str, capacity: int = 32768) -> DataFrame:
    """shard, key, length, bin for items that fit; bins never mix shards, so shards are packed independently."""

    def one(group: pd.DataFrame) -> pd.DataFrame:
        g = group.sort_values("key")
        return g.assign(bin=best_fit(g["length"].tolist(), capacity))

    items = df.select(F.col(shard).alias("shard"), F.col(key).alias("key"), F.col(length).cast("long").alias("length")).where(f"length > 0 and length <= {capacity}")
    return items.groupBy("shard").applyInPandas(one, "shard string, key long, length long, bin long")


def largest_first(sizes: list[tuple[str, int]], workers: int) -> list[tuple[str, int]]:
    """(name, worker): the largest first, each to the worker that has least so far."""
    load, out = [(0, w) for w in range(workers)], []
    for name, size in sorted(sizes, key=lambda x: (-x[1], x[0])):
        least, w = heapq.heappop(load)
        heapq.heappush(load, (least + size, w))
        out.append((name, w))
    return out


def scheduled(shards: DataFrame, name: str, size: str, workers: int) -> DataFrame:
    """name, worker of a list of shards. The list, one row a file, is one group, as each choice depends on those before."""

    def one(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(largest_first(list(zip(group["name"], group["size"].tolist())), workers), columns=["name", "worker"])

    rows = shards.select(F.col(name).alias("name"), F.col(size).cast("long").alias("size"))
    return rows.groupBy().applyInPandas(one, "name string, worker long")


def length_batches(df: DataFrame, key: str, size: str, rows: int = 500, total: int = 5_000_000) -> DataFrame:
    """key, size, batch: rows in order of size, in batches of at most `rows` rows whose sizes begin within `total` of each
    other. The place of a row and the sizes before it come from counts by size, so no task sorts all rows."""
    per = df.groupBy(size).agg(F.count("*").alias("_c"))
    over = Window.orderBy(size).rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(F.sum(c).over(over), F.lit(0))
    before = per.select(size, zero(F.col("_c")).alias("_rows"), zero(F.col("_c") * F.col(size)).alias("_total"))
    k = F.row_number().over(Window.partitionBy(size).orderBy(key)) - 1
    placed = df.select(key, size, k.alias("_k")).join(before, size)
    at = F.struct(F.floor((F.col("_rows") + F.col("_k")) / rows).alias("rows"), F.floor((F.col("_total") + F.col("_k") * F.col(size)) / total).alias("total"))
    return placed.select(key, size, at.alias("batch"))


def line_chunks(lines, size, budget: int):
    """Greedy chunks of consecutive lines within a budget, as an array of arrays; a longer line is a chunk of its own."""
    start = F.struct(F.array().cast("array<array<string>>").alias("out"), F.array().cast("array<string>").alias("cur"), F.lit(0).alias("n"))
    close = lambda s: F.when(F.size(s.cur) > 0, F.concat(s.out, F.array(s.cur))).otherwise(s.out)

    def step(s, x):
        n = size(x)
        fits = s.n + n <= budget
        return F.when(fits, F.struct(s.out.alias("out"), F.concat(s.cur, F.array(x)).alias("cur"), (s.n + n).alias("n"))).otherwise(F.struct(close(s).alias("out"), F.array(x).alias("cur"), n.alias("n")))

    return F.aggregate(lines, start, step, close)
