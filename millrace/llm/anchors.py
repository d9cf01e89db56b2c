"""Segments of equal anchors: which parts of a corpus recur, and where they must be looked at.

Units are words or bytes, as 64-bit hashes. A window is `width` units of one document; its anchor is its least-hashed
run of `gram` units, and a segment is a run of consecutive windows with equal anchors. Equal windows have equal
anchors, so all places of a window lie in segments with the same anchor.

One exchange finds what recurs. Tasks send their distinct segments as packed columns, one blob for each bucket of
anchors, about 17 bytes a segment; the first equal ones meet in the task, so that a passage that a third of all
documents share is sent once a task. A bucket is sorted in memory as arrays; buckets are sized by their number. The
least of many hashes is small, so anchors are mixed before ranges of them make buckets: else the first bucket would take
half as many times its share as a window has runs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import shards, store
from millrace.llm import words as W

SENT = 400_000  #: segments that a task gathers and makes distinct before it sends them
BUCKET_BYTES = 16 << 20  #: text bytes of the corpus whose segments one bucket takes, about
ANCHOR_BITS = 40  #: what is kept of an anchor; segments are told apart by 64 more bits
COLUMNS = ["shard", "anchor", "key", "first_id", "again", "edge", "source"]
_FACTOR = 0x9E3779B97F4A7C15


def spread(m):
    """Anchors of hashes: evenly spread over ANCHOR_BITS, also where they are least hashes."""
    import numpy as np

    return W.mix(m) >> np.uint64(64 - ANCHOR_BITS)


def segments(h, width: int, gram: int):
    """(anchor, key, first, count) arrays: the windows first .. first + count - 1 make a segment.

    `key` hashes the segment's units, through prefix sums of unit hashes weighted by position."""
    import numpy as np

    n = len(h) - width + 1
    if n < 1:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    span = width - gram + 1
    m, step = W.grams(h, gram), 1
    while 2 * step <= span:
        m = np.minimum(m[: len(m) - step], m[step:])
        step *= 2
    m = np.minimum(m[:n], m[span - step : span - step + n])
    first = np.flatnonzero(np.concatenate([[True], m[1:] != m[:-1]]))
    count = np.diff(np.concatenate([first, [n]]))
    power, inverse = powers(len(h) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(W.mix(h ^ np.uint64(0x5851F42D4C957F2D)) * power[: len(h)])])
    key = W.mix((sums[first + count + width - 1] - sums[first]) * inverse[first] + count.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return spread(m[first]), key, first, count


_POWERS: list = []


def powers(n: int):
    """At least the first n powers of an odd number and of its inverse modulo 2**64."""
    import numpy as np

    if not _POWERS or len(_POWERS[0]) < n:
        _POWERS[:] = [np.cumprod(np.full(max(n, 1 << 16), f, dtype=np.uint64)) for f in (_FACTOR, pow(_FACTOR, -1, 1 << 64))]
    if n <= 1 << 21 < len(_POWERS[0]):  # a very long text is over
        _POWERS[:] = [p[: 1 << 21].copy() for p in _POWERS]
    return _POWERS


def folded(h, anchor, first, count, width: int, gram: int):
    """Whether each segment holds its anchor more than once: only then can two of its own windows be equal."""
    import numpy as np

    if not len(first):
        return np.zeros(0, bool)
    g = spread(W.grams(h, gram))
    size = count + width - gram
    start = np.cumsum(size) - size
    at = np.arange(int(size.sum())) + np.repeat(first - start, size)
    return np.add.reduceat((g[at] == np.repeat(anchor, size)).astype(np.int32), start) > 1


def _sent(units, width: int, gram: int, buckets: int, fold: bool):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        def blobs(parts, shard):
            anchor, key, ids, bent = (np.concatenate([p[i] for p in parts]) for i in range(4))
            order = np.lexsort((ids, key, anchor))
            anchor, key, ids, bent = anchor[order], key[order], ids[order], bent[order]
            first = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (anchor[1:] != anchor[:-1])]))
            many = np.diff(np.concatenate([first, [len(key)]])) > 1
            last = ids[np.concatenate([first[1:], [len(ids)]]) - 1]
            anchor, key, ids, bent = anchor[first], key[first], ids[first], bent[first]
            base = int(ids.min())
            wide = int(last.max()) - base >= 1 << 32
            kind = "<u8" if wide else "<u4"
            flags = (anchor << np.uint64(8)) | (many.astype(np.uint64)) | (bent.astype(np.uint64) << np.uint64(1)) | ((last > ids).astype(np.uint64) << np.uint64(2))
            bucket = (anchor * np.uint64(buckets) >> np.uint64(ANCHOR_BITS)).astype(np.int64)
            ends = np.searchsorted(bucket, np.arange(buckets + 1))
            rows = []
            for b in np.flatnonzero(np.diff(ends)).tolist():
                s = slice(int(ends[b]), int(ends[b + 1]))
                f = flags[s]
                rows.append((b, f.astype("<u4").tobytes() + (f >> np.uint64(32)).astype("<u2").tobytes() + key[s].astype("<u8").tobytes() + (ids[s] - base).astype(kind).tobytes(), len(f)))
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([shard] * len(rows), pa.int64()), pa.array([base] * len(rows), pa.int64()), pa.array([r[2] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["bucket", "shard", "base", "n", "blob"])

        parts, size, shard = [], 0, None
        for batch in batches:
            ids, shard_of = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            texts = [t.encode("utf-8", "surrogatepass") for t in batch.column(1).to_pylist()]
            for s, e in W.slices(texts):
                h, bounds = units(texts[s:e])
                for k in range(s, e):
                    if ids[k] is None:
                        continue
                    if parts and (size >= SENT or shard_of[k] != shard):
                        yield blobs(parts, shard)
                        parts, size = [], 0
                    shard = shard_of[k]
                    own = h[bounds[k - s] : bounds[k - s + 1]]
                    anchor, key, first, count = segments(own, width, gram)
                    if len(key):
                        bent = folded(own, anchor, first, count, width, gram) if fold else np.zeros(len(key), bool)
                        parts.append((anchor, key, np.full(len(key), ids[k], np.int64), bent))
                        size += len(key)
        if parts:
            yield blobs(parts, shard)

    return run


def _met(within: bool):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        parts = []
        for batch in batches:
            for shard, base, n, blob in zip(*[c.to_pylist() for c in batch.columns[1:4]], [x.as_buffer() for x in batch.column(4)]):
                f = np.frombuffer(blob, "<u4", n).astype(np.uint64) | (np.frombuffer(blob, "<u2", n, 4 * n).astype(np.uint64) << np.uint64(32))
                key = np.frombuffer(blob, "<u8", n, 6 * n).copy()
                ids = np.frombuffer(blob, "<u4" if len(blob) == 18 * n else "<u8", n, 14 * n).astype(np.int64) + base
                parts.append((f, key, ids, np.full(n, shard, np.int64)))
        if not parts:
            return
        f, key, ids, shard = (np.concatenate([p[i] for p in parts]) for i in range(4))
        del parts
        order = np.lexsort((ids, key, f >> np.uint64(8)))
        f = f[order]  # one at a time, as each takes the memory of the one before
        key = key[order]
        ids = ids[order]
        shard = shard[order]
        anchor = f >> np.uint64(8)
        del order
        new_anchor = np.concatenate([[True], anchor[1:] != anchor[:-1]])
        new = new_anchor | np.concatenate([[True], key[1:] != key[:-1]])
        start = np.flatnonzero(new)
        group = np.cumsum(new) - 1
        many = np.bitwise_or.reduceat(f, start)
        size = np.diff(np.concatenate([start, [len(key)]]))
        again = (size > 1) | (many & np.uint64(1) > 0)
        a_start = np.flatnonzero(new_anchor[start])
        distinct = np.diff(np.concatenate([a_start, [len(start)]]))
        edge = np.repeat(distinct > 1, distinct) | (many & np.uint64(2) > 0)
        first_id = ids[start]
        # one row a segment and shard; a shard's rows of a segment are put side by side
        use = (again | edge)[group]
        if not use.any():
            return
        g, sh, i, fl = group[use], shard[use], ids[use], f[use]
        order = np.lexsort((i, sh, g))
        g, sh, i, fl = g[order], sh[order], i[order], fl[order]
        head = np.flatnonzero(np.concatenate([[True], (g[1:] != g[:-1]) | (sh[1:] != sh[:-1])]))
        flags = np.bitwise_or.reduceat(fl, head)
        high = np.maximum.reduceat(i, head)
        g, sh, low = g[head], sh[head], i[head]
        later = again[g] & ((high > first_id[g]) | (flags & np.uint64(4) > 0) | (within & ((flags & np.uint64(1)) > 0)))
        at_first = low == first_id[g]
        edged, source = edge[g] & at_first, again[g] & at_first
        on = later | edged | source
        g, sh = g[on], sh[on]
        for k in range(0, len(g), 100_000):
            s = slice(k, k + 100_000)
            yield pa.RecordBatch.from_arrays([pa.array(sh[s]), pa.array(anchor[start[g[s]]].view(np.int64)), pa.array(key[start[g[s]]].view(np.int64)), pa.array(first_id[g[s]]), pa.array(later[on][s]), pa.array(edged[on][s]), pa.array(source[on][s])], names=COLUMNS)

    return run


def routes(copy: DataFrame, units, width: int, gram: int, within: bool) -> shards.Companion:
    """For each shard of `copy`, the segments that matter there. `again`: later documents of the shard (or, if `within`,
    later places) repeat it; `source`: its first document is here, and it is repeated somewhere; `edge`: its first
    document is here, and other segments share its anchor (or, if `within`, its own windows may be equal), so its
    windows must be compared one by one."""
    spark = copy.sparkSession
    size = copy.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = int(max(2 * store.partitions(spark), size // BUCKET_BYTES))
    sent = copy.select("id", "text", "shard").mapInArrow(_sent(units, width, gram, buckets, within), "bucket int, shard long, base long, n int, blob binary")
    met = sent.repartitionById(buckets, F.col("bucket")).mapInArrow(_met(within), "shard long, anchor long, key long, first_id long, again boolean, edge boolean, source boolean")
    return shards.companions(met, "routes")


def route_of(routes: shards.Companion, shard: int):
    """(anchor, key, first_id, again, edge, source) arrays of a shard, in order of key; None if nothing matters there."""
    import numpy as np

    table = routes.rows(shard, COLUMNS[1:])
    if table is None:
        return None
    cols = [table.column(c).to_numpy() for c in COLUMNS[1:]]
    order = np.argsort(cols[1], kind="stable")
    return [c[order] for c in cols]


def looked_up(route, anchor, key):
    """(places of the segments that are in the route, their places in it)."""
    import numpy as np

    at = np.minimum(np.searchsorted(route[1], key.view(np.int64)), len(route[1]) - 1)
    hit = np.flatnonzero((route[1][at] == key.view(np.int64)) & (route[0][at] == anchor.view(np.int64)))
    return hit, at[hit]
