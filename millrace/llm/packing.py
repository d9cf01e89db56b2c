"""Best-fit packing of token pieces into fixed-length sequences, with certified bin counts.

Pieces are dealt by a hash of their row numbers into partitions of bounded size. Each packs its own by best-fit
decreasing and compares the number of bins with lower bounds from dual-feasible functions. A partition that meets its
bound is certified. One with a gap gives up bins in proportion to it: their pieces are dealt anew among the
partitions of the next round, which rerun best-fit decreasing. The bound for all pieces, which needs only the histogram
of lengths, decides whether that goes on: once it is met everything stands; where the gaps of partitions do not explain
what is above it, because their surpluses differ (one has too many long pieces, another too many short ones),
certified partitions give up their share too. Rounds end when one wins nothing, or after ROUNDS; no task grows with the
corpus. `certificate` states the final count and the bound.

Defined results: a null or empty text is the end id alone, one piece; rows with a null id and rows that repeat an id
are packed like all others; ties in length are broken by row number; other columns are
ignored; an empty table gives no pieces.
"""

from __future__ import annotations

import struct

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import store, tokens

PART = 20_000  #: pieces that one partition packs, about
GIVE = 64  #: bins that are given up for each bin above a bound
ROUNDS = 8  #: of packing, at most


def cut(n: int, most: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: all of `most` ids but perhaps the first."""
    first = n % most or min(n, most)
    return [(0, first)] + [(s, most) for s in range(first, n, most)]


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = 1024, end_id: int = 2, tokenizer: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every document's pieces. One map; the ids themselves are not moved."""
    path = tokenizer or tokens.default_path()
    store.arrow_rows(docs.sparkSession, 512)
    end = struct.pack("<I", end_id)

    def run(batches):
        import zlib

        import pyarrow as pa

        for batch in batches:
            out = [[], [], [], [], []]
            for doc_id, data in zip(batch.column(0).to_pylist(), tokens.Encoder.of(path).encode([t or "" for t in batch.column(1).to_pylist()])):
                data += end
                for k, (s, n) in enumerate(cut(len(data) // 4, most)):
                    for c, v in zip(out, (doc_id, k, s, n, zlib.crc32(data[4 * s : 4 * (s + n)]))):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def lower_bound(histogram, capacity: int) -> int:
    """The most bins that any of a family of dual-feasible functions proves necessary; histogram[x] pieces have length x.

    The family: lengths as they are; lengths below e dropped and those above capacity - e counted as whole bins; and
    both followed by the rounding functions u_k for k up to 12. All values are integers over k * capacity.
    """
    import numpy as np

    h = np.asarray(histogram, dtype=np.int64)
    x = np.arange(capacity + 1, dtype=np.int64)
    best = 0
    for e in range(0, capacity // 2 + 1, max(1, capacity // 256)):
        y = np.where(x > capacity - e, capacity, np.where(x < e, 0, x))
        best = max(best, -(-int((h * y).sum()) // capacity))
        for k in range(1, 13):
            z = (k + 1) * y
            u = np.where(z % capacity == 0, k * y, z // capacity * capacity)
            best = max(best, -(-int((h * u).sum()) // (k * capacity)))
    return best


def best_fit(lengths, capacity: int) -> list[list[int]]:
    """Bins as lists of indices; `lengths` must not ascend. Bins are looked up by the room they have left, in an integer
    whose bits mark the rooms that occur, so each piece costs a constant number of operations."""
    bins: list[list[int]] = []
    rooms: list[list[int]] = [[] for _ in range(capacity + 1)]
    marks = 0
    for i, n in enumerate(lengths):
        fit = marks >> n
        if fit:
            room = n + (fit & -fit).bit_length() - 1
            b = rooms[room].pop()
            if not rooms[room]:
                marks &= ~(1 << room)
            bins[b].append(i)
        else:
            room, b = capacity, len(bins)
            bins.append([i])
        room -= n
        if room:
            rooms[room].append(b)
            marks |= 1 << room
    return bins


def packed_part(lengths, capacity: int):
    """Best-fit decreasing of one partition's lengths, which must not ascend: (bin of each, offset of each, rank of each
    bin, bins, bound). Rank is the order in which bins are given up: the emptiest and, between them, those of the
    most pieces, as large pieces alone leave no choice."""
    import numpy as np

    bins = best_fit(lengths.tolist(), capacity)
    bound = lower_bound(np.bincount(lengths, minlength=capacity + 1), capacity)
    where, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    fill, size = np.zeros(len(bins), np.int64), np.zeros(len(bins), np.int64)
    for b, members in enumerate(bins):
        own = lengths[members]
        where[members] = b
        offset[members] = np.cumsum(own) - own
        fill[b], size[b] = own.sum(), len(members)
    rank = np.full(len(bins), 2 * len(bins), np.int64)
    order = np.argsort(fill, kind="stable")
    rank[order] = 2 * np.arange(len(bins))
    order = np.argsort(-size, kind="stable")
    rank[order] = np.minimum(rank[order], 2 * np.arange(len(bins)) + 1)
    return where, offset, rank, len(bins), bound


_ROWS = "doc_id long, piece int, start long, length long, ids_crc32 long, row long, part int, bin long, offset long, rank long, bins long, bound long"


def _pack(capacity: int):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        batches = [b for b in batches if b.num_rows]
        if not batches:
            return
        table = pa.Table.from_batches(batches)
        where, offset, rank, bins, bound = packed_part(table.column("length").to_numpy(), capacity)
        for name, values in (("bin", where), ("offset", offset), ("rank", rank[where]), ("bins", np.full(len(where), bins)), ("bound", np.full(len(where), bound))):
            table = table.append_column(name, pa.array(values))
        yield from table.to_batches()

    return run


def pack(rows: DataFrame, capacity: int = 1024) -> DataFrame:
    """Adds sequence_id and offset to pieces of at most `capacity` ids.

    `rows` needs doc_id, piece, start, length, ids_crc32. Each round is written to the shared folder; only sums over
    partitions and the histogram of lengths reach the driver.
    """
    spark = rows.sparkSession
    cols = ["doc_id", "piece", "start", "length", "ids_crc32"]
    rows = store.written(rows.select(*cols).withColumn("row", F.monotonically_increasing_id()), "pieces")
    places = [*cols, "sequence_id", "offset"]
    done = [rows.where(F.col("length") >= capacity).withColumn("sequence_id", -1 - F.col("row")).withColumn("offset", F.lit(0).cast("long")).select(*places)]
    todo = rows.where(F.col("length") < capacity)
    histogram = [0] * (capacity + 1)
    for r in todo.groupBy("length").count().collect():
        histogram[r.length] = r["count"]
    least, n, kept, given, before = lower_bound(histogram, capacity), sum(histogram), 0, None, None
    for round_no in range(ROUNDS):
        parts = -(-n // PART)
        if not parts:
            break
        dealt = todo.select(*cols, "row", F.pmod(F.xxhash64("row", F.lit(round_no)), F.lit(parts)).cast("int").alias("part"))
        dealt = dealt.repartitionById(parts, F.col("part")).sortWithinPartitions(F.desc("length"), "row")
        packed = store.written(dealt.mapInArrow(_pack(capacity), _ROWS), f"packed-{round_no}")
        placed = packed.withColumn("sequence_id", F.lit(round_no << 58) + F.shiftleft(F.col("part").cast("long"), 32) + F.col("bin"))
        bins, gaps = packed.groupBy("part").agg(F.first("bins").alias("bins"), F.first("bound").alias("bound")).agg(F.coalesce(F.sum("bins"), F.lit(0)), F.coalesce(F.sum(F.col("bins") - F.col("bound")), F.lit(0))).first()
        if given is not None and bins >= given:
            done.append(before.select(*places))  # nothing is won, so the bins stay as they were
            break
        excess = kept + bins - least
        if excess <= 0 or parts == 1 or round_no == ROUNDS - 1:
            done.append(placed.select(*places))
            break
        share = -(-GIVE * (excess - gaps) // parts) if excess > gaps else 0
        quota = F.when(F.col("bins") > F.col("bound"), GIVE * (F.col("bins") - F.col("bound"))).otherwise(F.lit(0)) + F.lit(share)
        done.append(placed.where(F.col("rank") >= quota).select(*places))
        before = placed.where(F.col("rank") < quota)
        n, given = before.agg(F.count("*"), F.count_distinct("sequence_id")).first()
        kept += bins - given
        todo = before.select(*cols, "row")
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def certificate(packed: DataFrame, capacity: int = 1024) -> DataFrame:
    """One row: sequences used, and the number that the lengths prove necessary. The driver gets the histogram of lengths."""
    h = [0] * (capacity + 1)
    for r in packed.groupBy("length").count().collect():
        h[r.length] = r["count"]
    used = packed.agg(F.count_distinct("sequence_id")).first()[0]
    return packed.sparkSession.createDataFrame([(used, lower_bound(h, capacity))], "sequences long, bound long")
