"""Collapse of cumulative conversation snapshots, then rendering.

Chat logs often hold a conversation many times, once after each turn. Every turn gets the hash of all turns up to it;
a conversation whose full hash is also a prefix hash of another one is a snapshot of it and goes. Only maximal
conversations are rendered. Everything is built-in SQL: aggregates, windows and an anti-join.

Texts are shuffled twice. The first exchange gathers blocks of BLOCK turn numbers, which are written with their rendered
text and two hashes a turn; from there on the hashes alone are moved, until the blocks of maximal conversations meet.
The rolling hash is a sum, over turns, of hashes of (position, role, text), so it is a running sum and is built in
two levels: inside blocks, then over the sums of blocks. A conversation with a third of all turns is thus spread over its
blocks. Four independent 31-bit sums make 124 bits and cannot overflow.

Defined results: turns are in the order of (turn, role, text), nulls first, and repeated rows count as turns; a null
role renders as "unknown" and a null text as empty, but differ from those in the hashes; rows with a null conv_id are
one conversation; of equal conversations the smallest id stays; other columns are ignored; an empty table gives no rows.
Turns that repeat one turn number are one block, however many, and a task holds a block as it holds a result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.llm import store

BLOCK = 256
SUMS = [f"s{i}" for i in range(4)]


def _key(conv) -> F.Column:
    """A conversation's key without nulls, which joins and windows can share."""
    return F.coalesce(F.concat(F.lit("v"), conv.cast("string")), F.lit("n"))


def blocks_of(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """k, conv, blk, n, h (two hashes a turn, in order), part (the rendered turns), in the shared folder.

    Blocks are ranges of turn numbers, so the order inside and between blocks is the order of turns."""
    t = turns.select(_key(F.col(conv)).alias("k"), F.col(conv).alias("conv"), F.struct(F.col(turn).cast("long").alias("turn"), F.col(role).cast("string").alias("role"), F.col(text).cast("string").alias("text")).alias("x"))
    blk = F.coalesce(F.floor(F.col("x.turn") / BLOCK), F.lit(-(1 << 62))).alias("blk")
    grouped = t.groupBy("k", blk).agg(F.min("conv").alias("conv"), F.sort_array(F.collect_list("x")).alias("x"))
    hashes = "transform(x, r -> struct(xxhash64(0, r.role is null, r.role, r.text is null, r.text) as a, xxhash64(1, r.role is null, r.role, r.text is null, r.text) as b))"
    part = r"array_join(transform(x, r -> concat('<|im_start|>', coalesce(r.role, 'unknown'), '\n', coalesce(r.text, ''), '<|im_end|>\n')), '')"
    return store.written(grouped.selectExpr("k", "conv", "blk", "size(x) as n", f"{hashes} as h", f"{part} as part"), "turn-blocks")


def prefix_hashes(blocks: DataFrame) -> DataFrame:
    """conv, n (turns up to this one), total (turns of the conversation), s0 to s3: the rolling hash of the first n turns."""
    in_order = Window.partitionBy("k").orderBy("blk").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.select("k", "blk", F.coalesce(F.sum("n").over(in_order), F.lit(0)).alias("first"), F.sum("n").over(Window.partitionBy("k")).alias("total"))
    turns = blocks.select("k", "blk", "conv", F.posexplode("h").alias("j", "h"))
    term = [F.pmod(F.xxhash64(F.lit(i), F.col("first") + F.col("j"), "h.a", "h.b"), F.lit(1 << 31)).alias(s) for i, s in enumerate(SUMS)]
    terms = turns.join(starts, ["k", "blk"]).select("k", "blk", "conv", "j", "first", "total", *term)
    inner = Window.partitionBy("k", "blk").orderBy("j").rowsBetween(Window.unboundedPreceding, 0)
    rolled = terms.select("k", "blk", "conv", (F.col("first") + F.col("j") + 1).alias("n"), "total", *[F.sum(s).over(inner).alias(s) for s in SUMS])
    sums = terms.groupBy("k", "blk").agg(*[F.sum(s).alias(s) for s in SUMS])
    before = sums.select("k", "blk", *[F.coalesce(F.sum(s).over(in_order), F.lit(0)).alias(f"b_{s}") for s in SUMS])
    return rolled.join(before, ["k", "blk"]).select("conv", "n", "total", *[(F.col(s) + F.col(f"b_{s}")).alias(s) for s in SUMS])


def maximal(hashes: DataFrame) -> DataFrame:
    """conv, n_turns, n_copies of the conversations that no other one continues; equal ones count as copies of the
    smallest. Hot prefixes, such as a common first turn, are made distinct by partial aggregation before the anti-join."""
    whole = hashes.where("n = total").groupBy("n", *SUMS).agg(F.min("conv").alias("conv"), F.count("*").alias("n_copies"))
    longer = hashes.where("n < total").select("n", *SUMS).distinct()
    return whole.join(longer, ["n", *SUMS], "left_anti").select("conv", F.col("n").cast("long").alias("n_turns"), "n_copies")


def rendered(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, n_turns, n_copies, rendered: the maximal conversations in a chat template.

    The final string is as long as the conversation is; until then no task holds more of one than a block.
    """
    blocks = blocks_of(turns, conv, turn, role, text)
    keep = maximal(store.written(prefix_hashes(blocks), "prefixes")).select(_key(F.col("conv")).alias("k"), F.col("conv").alias("kept"), "n_turns", "n_copies")
    kept = store.written(keep, "maximal")
    parts = blocks.select("k", F.struct("blk", "part").alias("y")).join(kept, "k")
    whole = parts.groupBy("k").agg(F.first("kept").alias(conv), F.first("n_turns").alias("n_turns"), F.first("n_copies").alias("n_copies"), F.sort_array(F.collect_list("y")).alias("y"))
    return whole.select(conv, "n_turns", "n_copies", F.array_join(F.col("y.part"), "").alias("rendered"))
