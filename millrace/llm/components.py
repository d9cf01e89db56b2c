"""Connected components by min-hooking and pointer jumping, as joins over tables in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import store


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(id, component) of every id in `edges` (columns a, b): component is the smallest id that can be reached.

    Each round hooks every tree root to the smallest root next to it, flattens the trees by pointer jumping, and
    replaces edges by edges between roots, which drops those that have served. Roots at least halve in every two
    rounds. Only counts reach the driver; hot nodes meet partial aggregates and skew joins, never a collected group.
    """
    live = store.written(edges.where("a <> b").selectExpr("least(a, b) a", "greatest(a, b) b").distinct(), f"{name}-edges")
    parent = None
    while not live.isEmpty():
        both = live.select("a", "b").union(live.select("b", "a")).toDF("u", "v")
        hook = store.written(both.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("p")), f"{name}-hook")
        while True:  # a parent is never larger than its child, so there are no cycles and this ends in log(depth) rounds
            up = hook.selectExpr("u as _u", "p as _p")
            jumped = store.written(hook.join(up, hook.p == up._u, "left").select("u", F.coalesce("_p", "p").alias("p"), (F.coalesce("_p", "p") != F.col("p")).alias("moved")), f"{name}-jump")
            store.dropped(hook)
            moved = not jumped.where("moved").isEmpty()
            path = jumped._millrace_path
            hook = jumped.select("u", "p")
            hook._millrace_path = path
            if not moved:
                break
        if parent is None:
            parent = hook
        else:
            new = parent.join(hook, parent.p == hook.u, "left").select(parent.u, F.coalesce(hook.p, parent.p).alias("p"))
            merged = store.written(new, f"{name}-parent")
            store.dropped(parent)
            store.dropped(hook)
            parent = merged
            hook = parent
        roots = parent.selectExpr("u as _u", "p as _p")
        a = live.join(roots, live.a == roots._u).select(F.col("_p").alias("a"), "b")
        b = a.join(roots, a.b == roots._u).select("a", F.col("_p").alias("b"))
        nxt = store.written(b.where("a <> b").selectExpr("least(a, b) a", "greatest(a, b) b").distinct(), f"{name}-edges")
        store.dropped(live)
        live = nxt
    store.dropped(live)
    if parent is None:
        return edges.selectExpr("a as id", "a as component").limit(0)
    return parent.selectExpr("u as id", "p as component")
