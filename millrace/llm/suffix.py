"""Repeated byte strings, with suffix arrays built by induced sorting.

A byte goes if a string of `width` bytes over it also starts in a document with a smaller id. As in `phrases`, segments
of equal anchors tell where the corpus recurs: a segment that an earlier document has is repeated as a whole, and only
segments that differ but share an anchor, which are the edges of repeated passages, need their strings compared. Their
bytes, of their first documents alone, meet by anchor in shards. Each shard is sorted into a suffix array: suffixes are
classed as S or L, the leftmost S substrings are sorted and named, the shorter string of names is sorted in the same way
in turn, and everything else is induced from it: bucket by bucket where the alphabet is small, all buckets at once where
it is large. Permuted common prefixes then give the runs of suffixes that share `width` bytes, and the smallest id
in each run. Runs of one character take no more rounds than other text.

Whole segments are told to be equal by 104 bits of hashes; among n distinct ones two would be mistaken with a
probability of n**2 / 2**105, 2e-8 at 1e12. Edges are compared byte by byte.

Defined results: a null or empty text is no bytes; rows with a null id are kept whole; rows that repeat an id do not
remove each other's bytes; matches never cross documents; a very long text is handled alone, as arrays; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import anchors as A
from millrace.llm import shards, store
from millrace.llm import words as W

GRAM = 20  #: bytes of an anchor; shorter ones recur by chance in ordinary text, which makes edges of nothing
SHARD = 1 << 20  #: bytes that one suffix array takes at least; all segments of an anchor go to the same one
HOT = 2 << 20  #: bytes of edge segments with one anchor that are dealt on by longer anchors
LONGER = 36  #: bytes of those
TASK = 64 << 20  #: bytes of edge segments in one task, about
FEW = 512  #: alphabets up to this size are induced bucket by bucket, larger ones, of names, all buckets at once


def _types(s):
    """True where a suffix is smaller than the next one (S); the last, a unique smallest character, is S."""
    import numpy as np

    n = len(s)
    rise = np.sign(s[1:].astype(np.int64) - s[:-1])
    at = np.where(rise != 0, np.arange(n - 1), n)
    nearest = np.minimum.accumulate(at[::-1])[::-1]
    out = np.empty(n, bool)
    out[-1] = True
    out[:-1] = np.where(nearest < n, rise[np.minimum(nearest, n - 2)] > 0, False)
    return out


def _run(cur, reach):
    """What a bucket puts into itself, in order: from each of `cur` the places before it while the character stays the
    same, `reach` of them; the nearest ones of all first."""
    import numpy as np

    if not reach.any():
        return cur
    n = reach + 1
    step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    return (np.repeat(cur, n) - step)[np.argsort(step, kind="stable")]


def _induce(s, is_s, lms, k: int):
    """The suffix array that the leftmost S suffixes, given in order, induce. One step handles a whole bucket: what it
    puts into the same bucket, which are the runs of its character, is handled at once, and all else is dealt stably
    to its buckets."""
    import numpy as np

    n = len(s)
    small = s.astype(np.uint16, copy=False) if k < 1 << 16 else s  # sorted by radix
    change = np.concatenate([[True], s[1:] != s[:-1]])
    reach = np.arange(n) - np.maximum.accumulate(np.where(change, np.arange(n), 0))  # equal characters before each place

    def deal(prev, pending):
        if not len(prev):
            return
        chars = small[prev]
        order = np.argsort(chars, kind="stable")
        prev, chars = prev[order], chars[order]
        cuts = np.flatnonzero(np.concatenate([[True], chars[1:] != chars[:-1]]))
        for a, b in zip(cuts.tolist(), cuts[1:].tolist() + [len(prev)]):
            pending[chars[a]].append(prev[a:b])

    none = np.zeros(0, np.int64)
    seeds = [[] for _ in range(k)]
    deal(lms, seeds)
    pending = [[] for _ in range(k)]
    large = [none] * k
    for c in range(k):
        done = none
        if pending[c]:
            cur = np.concatenate(pending[c])
            done = _run(cur, reach[cur])
        large[c] = done
        own = np.concatenate([done, *seeds[c]])
        prev = own[own > 0] - 1
        deal(prev[~is_s[prev] & (s[prev] != c)], pending)
    pending = [[] for _ in range(k)]
    out = [none] * k
    for c in range(k - 1, -1, -1):
        done = none
        if pending[c]:
            cur = np.concatenate(pending[c])
            done = _run(cur, reach[cur])
        own = np.concatenate([done, large[c][::-1]])
        prev = own[own > 0] - 1
        deal(prev[is_s[prev] & (s[prev] != c)], pending)
        out[c] = np.concatenate([large[c], done[::-1]])
    out[0] = np.array([n - 1])
    return np.concatenate(out)


def _induce_names(s, is_s, lms, k: int):
    """As `_induce`, for large alphabets: all buckets at once. A suffix is placed by its first character, the length of
    that character's run and the place of what follows the run; that of a leftmost S suffix is given. Places of
    followers are refined until none changes, each time only where some are still equal, so there are as many rounds
    as a falling or rising stretch has distinct characters."""
    import numpy as np

    n = len(s)
    place = np.arange(n)
    last = np.concatenate([s[1:] != s[:-1], [True]])
    end = np.minimum.accumulate(np.where(last, place, n)[::-1])[::-1] + 1  # one past the run of each place
    run = end - place

    def induced(members, seeds, least_first: bool):
        """`members` in the order that the ordered `seeds`, each before or after all members of its bucket, induce."""
        both = np.concatenate([members, seeds])
        m, total = len(members), len(members) + len(seeds)
        own = run[both] if least_first else n - run[both]
        own[m:] = np.arange(len(seeds)) + (n + 1 if least_first else -len(seeds))
        key = s[both].astype(np.int64) * (2 * n + 2 * total + 2) + own
        order = np.argsort(key)
        key = key[order]
        new = np.concatenate([[True], key[1:] != key[:-1]])
        place_of = np.flatnonzero(new)[np.cumsum(new) - 1]
        at = np.empty(total, np.int64)
        at[order] = place_of
        where = np.zeros(n + 1, np.int64)
        where[both] = at
        one = new & np.concatenate([new[1:], [True]])
        tied = order[~one]
        group = place_of[~one]
        while len(tied):
            key = group * (total + 1) + where[end[both[tied]]]
            sub = np.argsort(key)
            tied, key, group = tied[sub], key[sub], group[sub]
            head = np.concatenate([[True], group[1:] != group[:-1]])
            fresh = np.concatenate([[True], key[1:] != key[:-1]])
            at = np.arange(len(tied))
            start = np.maximum.accumulate(np.where(head, at, 0))
            order[group + at - start] = tied
            moved = group + np.maximum.accumulate(np.where(fresh, at, 0)) - start
            if (moved == group).all():
                break
            where[both[tied]] = moved
            open_ = ~(fresh & np.concatenate([fresh[1:], [True]]))
            tied, group = tied[open_], moved[open_]
        return both[order]

    by_char = lms[np.argsort(s[lms], kind="stable")]
    place_l = np.flatnonzero(~is_s)
    large = induced(place_l, by_char, True)
    large = large[~is_s[large]]
    inner = np.flatnonzero(is_s[:-1])
    small = induced(inner, np.concatenate([[n - 1], large]), False)
    return small


def suffix_array(s, k: int):
    """The order of the suffixes of s, an integer array below k that ends in its only 0."""
    import numpy as np

    n = len(s)
    if n == 1:
        return np.zeros(1, np.int64)
    is_s = _types(s)
    lms = np.flatnonzero(is_s[1:] & ~is_s[:-1]) + 1
    induce = _induce if k <= FEW else _induce_names
    if len(lms) <= 1:
        return induce(s, is_s, lms, k)
    first = induce(s, is_s, lms, k)
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    ordered = first[is_lms[first]]
    end = np.empty(n, np.int64)  # one past each leftmost S substring, which ends with the next one's first character
    end[lms] = np.concatenate([lms[1:], [n - 1]]) + 1
    a, b = ordered[:-1], ordered[1:]
    la, lb = end[a] - a, end[b] - b
    equal = la == lb
    live = np.flatnonzero(equal)
    same = shared(s, a[live], b[live], la[live])
    equal[live] = same >= la[live]
    name = np.empty(n, np.int64)
    name[ordered] = np.concatenate([[0], np.cumsum(~equal)])
    reduced = name[lms]
    top = int(reduced.max()) + 1
    if top == len(lms):
        order = np.argsort(reduced, kind="stable")
    else:
        order = suffix_array(reduced, top)
    return induce(s, is_s, lms[order], k)


def shared(s, a, b, most):
    """How many characters s has in common from each place of a and of b on, up to `most` of them: all pairs at once,
    one character at a time, and where more than 64 are shared, pair by pair on growing stretches of bytes."""
    import numpy as np

    out = np.zeros(len(a), np.int64)
    live, j = np.flatnonzero(most > 0), 0
    if len(s) and int(s.max()) < 1 << 15:  # four characters in one
        four = np.concatenate([s, np.zeros(3, s.dtype)]).astype(np.int64)
        four = four[:-1] << 15 | four[1:]
        four = four[:-2] << 30 | four[2:]
        x, y, left = a[live], b[live], most[live]
        while len(live) and j < 64:
            on = (left >= j + 4) & (four[x + j] == four[y + j])
            off = live[~on]
            if len(off):
                tail, i = off, j
                while len(tail):
                    tail = tail[most[tail] > i]
                    tail = tail[s[a[tail] + i] == s[b[tail] + i]]
                    i += 1
                    out[tail] = i
            j += 4
            live, x, y, left = live[on], x[on], y[on], left[on]
            out[live] = j
        live = live[most[live] > j]
    while len(live) and j < 64:
        live = live[s[a[live] + j] == s[b[live] + j]]
        j += 1
        out[live] = j
        live = live[most[live] > j]
    if len(live):
        width = s.dtype.itemsize
        data = memoryview(np.ascontiguousarray(s)).cast("B")
        for i, x, y, m in zip(live.tolist(), a[live].tolist(), b[live].tolist(), most[live].tolist()):
            j, step = 64, 256
            while j < m:
                e = min(m, j + step)
                if data[(x + j) * width : (x + e) * width] == data[(y + j) * width : (y + e) * width]:
                    j, step = e, step * 2
                elif e - j == 1:
                    break
                else:
                    step = (e - j) // 2
                    m = e
            out[i] = j
    return out


def permuted_lcp(s, sa):
    """PLCP[i]: how many characters suffix i shares with the one before it in the array.

    Where the two are preceded by the same character the value is its left neighbour's less one; only the others are
    compared."""
    import numpy as np

    n = len(s)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    i = np.arange(n)
    known = (i > 0) & (before > 0)
    known[known] = s[i[known] - 1] == s[before[known] - 1]
    known[1:] &= before[:-1] >= 0
    plcp = np.zeros(n, np.int64)
    live = np.flatnonzero(~known & (before >= 0))
    plcp[live] = shared(s, live, before[live], n - np.maximum(live, before[live]))
    base = np.where(known, -1, plcp + i)  # along a run of known places PLCP[i] + i stays what it was
    return np.maximum(np.maximum.accumulate(base) - i, 0) if n else plcp


def byte_units(texts: list[bytes]):
    import numpy as np

    table = W.mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
    return table[np.frombuffer(b"".join(texts), dtype=np.uint8)], np.cumsum([0] + [len(t) for t in texts])


def repeated_strings(parts: list[tuple[int, bytes]], width: int):
    """For (document id, bytes) parts: per part, whether the string of `width` bytes from each place starts in a part
    with a smaller id."""
    import numpy as np

    joined = b"".join(p + b"\x00" for _, p in parts)
    lens = np.array([len(p) for _, p in parts])
    start = np.concatenate([[0], np.cumsum(lens + 1)])
    s = np.zeros(len(joined) + 1, np.uint16)
    s[:-1] = np.frombuffer(joined, dtype=np.uint8).astype(np.uint16) + np.uint16(2)
    s[start[1:] - 1] = 1  # behind each part
    sa = suffix_array(s, 258)
    plcp = permuted_lcp(s, sa)
    part = np.repeat(np.arange(len(parts)), lens + 1)
    room = np.concatenate([start[part + 1] - 1 - np.arange(len(joined)), [0]])
    new = plcp[sa] < width
    new[0] = True
    ids = np.concatenate([np.array([i for i, _ in parts], dtype=np.int64)[part], [np.iinfo(np.int64).max]])
    fits = room[sa] >= width
    own = np.where(fits, ids[sa], np.iinfo(np.int64).max)
    head = np.flatnonzero(new)
    least = np.repeat(np.minimum.reduceat(own, head), np.diff(np.concatenate([head, [len(sa)]])))
    hit = np.zeros(len(s), bool)
    hit[sa] = fits & (ids[sa] > least)
    return [hit[start[k] : start[k + 1] - 1] for k in range(len(parts))]


_SPAN = "id long, tag long, shard long, start long, n long, anchor long, body binary"


def _covered(routes: shards.Companion, width: int):
    """Byte ranges that earlier documents have as whole segments, and the bytes of edge segments (with their anchors)."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        shard, route = None, None
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
        names = [x.split()[0] for x in _SPAN.split(", ")]
        for batch in batches:
            out: list = [[] for _ in names]
            for i, text, tag, s in zip(*[c.to_pylist() for c in batch.columns]):
                if s != shard:
                    shard, route = s, A.route_of(routes, s)
                if route is None or i is None or not text:
                    continue
                data = text.encode("utf-8", "surrogatepass")
                h, _ = byte_units([data])
                anchor, key, first, count = A.segments(h, width, GRAM)
                if not len(key):
                    continue
                hit, at = A.looked_up(route, anchor, key)
                if not len(hit):
                    continue
                later = hit[route[3][at] & (route[2][at] < i)]
                if len(later):
                    a, b = first[later], first[later] + count[later] + width - 1
                    new = np.flatnonzero(np.concatenate([[True], a[1:] > b[:-1]]))
                    for x, y in zip(a[new].tolist(), b[np.concatenate([new[1:], [len(a)]]) - 1].tolist()):
                        for c, v in zip(out, (i, tag, s, x, y - x, None, None)):
                            c.append(v)
                edge = hit[route[4][at] & (route[2][at] == i)]
                for x, n, k in zip(first[edge].tolist(), (count[edge] + width - 1).tolist(), anchor[edge].view(np.int64).tolist()):
                    for c, v in zip(out, (i, tag, s, x, n, k, data[x : x + n])):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(out, kinds)], names=names)

    return run


def _compared(width: int):
    """Ranges of edge segments, sorted by anchor, that earlier documents' edge segments have too."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        names = ["id", "tag", "shard", "start", "n"]

        def spans(rows):
            out: list = [[] for _ in names]
            for r, hit in zip(rows, repeated_strings([(r[0], r[6]) for r in rows], width)):
                at = np.flatnonzero(hit)
                if not len(at):
                    continue
                new = np.flatnonzero(np.concatenate([[True], at[1:] > at[:-1] + width]))
                for x, y in zip(at[new].tolist(), at[np.concatenate([new[1:], [len(at)]]) - 1].tolist()):
                    for c, v in zip(out, (r[0], r[1], r[2], r[3] + x, y - x + width)):
                        c.append(v)
            return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64()))], names=names)

        rows, size = [], 0
        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                if size >= SHARD and row[5] != rows[-1][5]:
                    yield spans(rows)
                    rows, size = [], 0
                rows.append(row)
                size += len(row[6])
        if rows:
            yield spans(rows)

    return run


def _longer(width: int, gram: int):
    """Edge segments cut further: runs of windows whose least-hashed run of `gram` bytes is the same, too."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            out: list = [[] for _ in batch.columns]
            for i, tag, shard, start, n, anchor, body in zip(*[c.to_pylist() for c in batch.columns]):
                h, _ = byte_units([body])
                m, step, span = W.grams(h, gram), 1, width - gram + 1
                while 2 * step <= span:
                    m = np.minimum(m[: len(m) - step], m[step:])
                    step *= 2
                windows = n - width + 1
                m = np.minimum(m[:windows], m[span - step : span - step + windows])
                first = np.flatnonzero(np.concatenate([[True], m[1:] != m[:-1]]))
                size = np.diff(np.concatenate([first, [windows]])) + width - 1
                both = W.mix(m[first] ^ np.uint64(anchor & 0xFFFFFFFFFFFFFFFF)).view(np.int64)
                for x, k, a in zip(first.tolist(), size.tolist(), both.tolist()):
                    for c, v in zip(out, (i, tag, shard, start + x, k, a, body[x : x + k])):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(out, batch.schema)], names=batch.schema.names)

    return run


def _compared_edges(edges: DataFrame, width: int) -> DataFrame:
    """(id, tag, shard, start, n) of what earlier documents' edge segments have too.

    An anchor with more than HOT bytes of segments would make one task too large: its segments are cut by longer
    anchors, and what is still too much then into single windows, whose bytes are compared by a partial aggregate
    and a join. So the largest suffix array takes HOT + SHARD bytes, whatever the corpus."""
    spark, out = edges.sparkSession, []
    spans = ["id", "tag", "shard", "start", "n"]
    for gram in (LONGER, width):
        hot = store.written(edges.groupBy("anchor").agg(F.sum("n").alias("_b")).where(F.col("_b") > HOT).select("anchor"), "hot")
        if hot.isEmpty():
            break
        out.append(edges.join(hot, "anchor", "left_anti"))
        cut = edges.join(hot, "anchor", "left_semi").select(*spans, "anchor", "body")
        edges = store.written(cut.mapInArrow(_longer(width, gram), _SPAN), "edges")
    else:
        # runs of equal windows, such as a run of one byte, share a row; all their windows are the same
        unit = F.substring("body", 1, width).alias("unit")
        windows = edges.select("id", "tag", "shard", "start", "n", unit)
        earliest = windows.groupBy("unit").agg(F.min("id").alias("first_id"), F.max("id").alias("_last")).where("first_id < _last")
        later = windows.join(earliest, "unit").where("id > first_id").select(*spans)
        edges = None
    arrays = out + ([edges] if edges is not None else [])
    found = []
    for e in arrays:
        e = e.select(*spans, "anchor", "body")
        size = e.agg(F.sum("n")).first()[0] or 0
        dealt = e.repartition(max(store.partitions(spark), int(size // TASK)), "anchor").sortWithinPartitions("anchor", "id", "start")
        found.append(dealt.mapInArrow(_compared(width), "id long, tag long, shard long, start long, n long"))
    if edges is None:
        found.append(later)
    union = found[0]
    for f in found[1:]:
        union = union.unionByName(f)
    return union


def _removed(covers: shards.Companion, with_text: bool):
    def run(batches):
        import pyarrow as pa

        shard, spans = None, {}
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * with_text
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()] + [pa.binary()] * with_text
        for batch in batches:
            out = [[] for _ in names]
            for i, text, tag, s in zip(*[c.to_pylist() for c in batch.columns]):
                if s != shard:
                    shard, spans = s, {}
                    table = covers.rows(s, ["id", "tag", "start", "n"])
                    if table is not None:
                        for a, b, c, d in zip(*[table.column(k).to_pylist() for k in ("id", "tag", "start", "n")]):
                            spans.setdefault((a, b), []).append((c, c + d))
                data = text.encode("utf-8", "surrogatepass")
                runs: list = []
                for a, b in sorted(spans.get((i, tag), ())):
                    if runs and a <= runs[-1][1]:
                        runs[-1][1] = max(runs[-1][1], b)
                    else:
                        runs.append([a, b])
                at, kept = 0, []
                for a, b in runs:
                    kept.append(data[at:a])
                    at = b
                kept = b"".join(kept) + data[at:]
                for c, v in zip(out, (i, len(data), len(data) - len(kept), len(runs), hashlib.sha256(kept).hexdigest(), kept)):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(out, kinds)], names=names)

    return run


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 50, with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, kept (the bytes left)."""
    spark = docs.sparkSession
    store.arrow_rows(spark, 512)
    copy = shards.sharded(docs, id_col, text_col)
    routes = A.routes(copy, byte_units, width, GRAM, False)
    found = store.written(copy.select("id", "text", "tag", "shard").mapInArrow(_covered(routes, width), _SPAN), "spans")
    compared = _compared_edges(found.where("anchor is not null"), width)
    covers = shards.companions(found.where("anchor is null").select("id", "tag", "shard", "start", "n").unionByName(compared), "removals")
    store.remove(spark, routes.path)
    store.dropped(found)
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text
    return copy.select("id", "text", "tag", "shard").mapInArrow(_removed(covers, with_text), schema)
