"""Repeated word passages, located with Aho-Corasick automata.

A window is `width` consecutive words of a document; a word goes if a window over it also starts earlier. Comparing
all windows would move the corpus several times over, so:

1. Every window is represented by its least-hashed run of GRAM words, and consecutive windows with the same such anchor
   form a segment. Equal windows have equal anchors, so they lie in segments with the same anchor. Each task sends one
   row a distinct segment, which also keeps a passage that a third of all documents share from making a hot key.
2. Where an anchor recurs, its segments are confirmed: a segment that occurs again is a recurring passage. Its words are
   read off its first document and go to the shards of documents that were found to hold it.
3. Each shard compiles its passages, which come from documents anywhere in the corpus, into automata of bounded size,
   one character for each distinct word, and streams all its documents through them. Patterns are the HEAD first words
   of passages; every occurrence is confirmed by all its words. One in a later document than the first, or later in the
   same one, is removed.
4. Segments that differ but share an anchor may still share windows. Their first occurrences give their windows,
   hashed to 128 bits; a window that starts earlier elsewhere is removed too. These are only the edges of repeated
   passages. Two different windows with one hash would be taken for equal; among n of them that has a probability of
   n**2 / 2**129, 1e-15 at 1e12.

Defined results: null or empty texts have no words; rows with a null id are kept whole; rows that repeat an id are
separate, and neither is earlier than the other; a very long text is handled alone, as arrays; other columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import anchors as A
from millrace.llm import shards, store
from millrace.llm import words as W

GRAM = 6
BLOCK = 3 << 20  #: bytes of text that are streamed through an automaton at once
HEAD = 8  #: words of a passage that its automaton looks for; the others are compared where they are found
LETTERS = 1_000_000  #: words in the patterns of one automaton; more passages make further automata
SPAN = "id long, tag long, shard long, start int, n int, w1 long, w2 long, anchor long, key long, body binary"


def word_units(texts: list[bytes]):
    h, bounds, *_ = W.scan(texts)
    return h, bounds


def _opened(routes: shards.Companion, width: int):
    """Rows of two kinds: the words of recurring passages, from their first documents (anchor, key, body), and the
    windows of edge segments (id, tag, shard, start, n, w1, w2; without hashes where a window repeats in its segment's own
    document, which is a range to remove)."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        names = [x.split()[0] for x in SPAN.split(", ")]
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())

        def windows(parts):
            """parts: (id, tag, shard, starts, w1, w2), the last two null where the range is to go."""
            n = [len(p[3]) for p in parts]
            fixed = [np.repeat(np.array([p[k] for p in parts], dtype=np.int64), n) for k in range(3)]
            starts = np.concatenate([np.asarray(p[3], dtype=np.int32) for p in parts])
            none = np.repeat([p[4] is None for p in parts], n).astype(bool)
            hashes = [np.concatenate([np.zeros(len(p[3]), np.int64) if p[k] is None else p[k] for p in parts]) for k in (4, 5)]
            total = len(starts)
            cols = [pa.array(x) for x in (*fixed, starts, np.full(total, width, np.int32))] + [pa.array(x, mask=none) for x in hashes] + [pa.nulls(total, k) for k in kinds[7:]]
            return pa.RecordBatch.from_arrays(cols, names=names)

        def passages(rows):
            n = len(rows)
            a, k, b = zip(*rows)
            return pa.RecordBatch.from_arrays([pa.nulls(n, t) for t in kinds[:7]] + [pa.array(a, pa.int64()), pa.array(k, pa.int64()), pa.array(b, pa.binary())], names=names)

        shard, route, told = None, None, set()
        for batch in batches:
            ids, tags, of = (batch.column(k).to_pylist() for k in (0, 2, 3))
            texts = [t.encode("utf-8", "surrogatepass") for t in batch.column(1).to_pylist()]
            for s, e in W.slices(texts):
                h, bounds, starts, ends, joined = W.scan(texts[s:e])
                parts, found = [], []
                for k in range(s, e):
                    i = ids[k]
                    if of[k] != shard:
                        shard, route, told = of[k], A.route_of(routes, of[k]), set()
                    if route is None or i is None:
                        continue
                    at0 = int(bounds[k - s])
                    own = h[at0 : bounds[k - s + 1]]
                    anchor, key, first, count = A.segments(own, width, GRAM)
                    if not len(key):
                        continue
                    hit, at = A.looked_up(route, anchor, key)
                    here = route[2][at] == i
                    hit, at = hit[here], at[here]
                    for x, r in zip(hit[route[5][at]].tolist(), at[route[5][at]].tolist()):
                        if r not in told:
                            told.add(r)
                            a = at0 + int(first[x])
                            z = a + int(count[x]) + width - 1
                            found.append((int(route[0][r]), int(route[1][r]), b" ".join(joined[starts[a] : ends[z - 1]].split())))
                    edges = hit[route[4][at]]
                    if len(edges):
                        n = count[edges]
                        at = np.arange(int(n.sum())) + np.repeat(first[edges] - (np.cumsum(n) - n), n)
                        w1 = W.grams(own, width)[at].view(np.int64)
                        w2 = W.grams(W.mix(own ^ np.uint64(0x2545F4914F6CDD1D)), width)[at].view(np.int64)
                        order = np.lexsort((at, w2, w1))
                        again = np.zeros(len(at), bool)
                        again[order[1:]] = (w1[order[1:]] == w1[order[:-1]]) & (w2[order[1:]] == w2[order[:-1]])
                        if again.any():
                            parts.append((i, tags[k], shard, at[again], None, None))
                        parts.append((i, tags[k], shard, at[~again], w1[~again], w2[~again]))
                if parts:
                    yield windows(parts)
                if found:
                    yield passages(found)

    return run


def spelt(code, base: int) -> str:
    """Words as text, given by their numbers, -1 for words in no passage. A number is three characters, each from a set of
    its own, so that matches begin at words and a node of an automaton, which is searched in line, has few
    branches; every other word is one character."""
    import numpy as np

    n = np.where(code < 0, 1, 3)
    at = np.cumsum(n) - n
    out = np.ones(int(n.sum()), "<u4")
    known = code >= 0
    k, at = code[known], at[known]
    out[at] = 2 + k // (base * base)
    out[at + 1] = 2 + base + k // base % base
    out[at + 2] = 2 + 2 * base + k % base
    return out.tobytes().decode("utf-32-le")


def automata(passages: list[tuple[bytes, int]]):
    """Automata over (words joined by spaces, first document id): (hashes of the words in order, base of their spelling,
    automaton). A pattern is the HEAD first words of passages, or fewer of a shorter one; its value, by number of words,
    has the passages that begin so, with their first document ids."""
    import ahocorasick
    import numpy as np

    at = 0
    while at < len(passages):
        some, n = [], 0
        while at < len(passages) and (not some or n < LETTERS):
            some.append(passages[at])
            n += min(HEAD, passages[at][0].count(b" ") + 1)
            at += 1
        heads = [b" ".join(p.split(b" ", HEAD)[:HEAD]) for p, _ in some]
        h, bounds, *_ = W.scan(heads)
        words, code = np.unique(h, return_inverse=True)
        base = max(2, math.ceil(len(words) ** (1 / 3)))
        text, at3 = spelt(code, base), 3 * bounds
        patterns: dict[str, dict[int, dict[bytes, int]]] = {}
        for (p, first_id), a, b in zip(some, at3[:-1].tolist(), at3[1:].tolist()):
            own = patterns.setdefault(text[a:b], {}).setdefault(p.count(b" ") + 1, {})
            own[p] = min(first_id, own.get(p, first_id))
        automaton = ahocorasick.Automaton()
        for pattern, value in patterns.items():
            automaton.add_word(pattern, (len(pattern) // 3, value))
        automaton.make_automaton()
        yield words, base, automaton


def occurrences(passages: list[tuple[bytes, int]], texts: list[bytes]) -> list[list[tuple[int, int, int, bytes]]]:
    """For each text, every (first word, words, first document id, passage) at which a passage occurs in it. Where an
    automaton meets the head of passages, the words there are looked up among them."""
    import numpy as np

    out: list[list] = [[] for _ in texts]
    groups, first, size = [], 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > BLOCK:
            groups.append((first, i))
            first, size = i, 0
        size += len(t)
    groups.append((first, len(texts)))
    scanned: dict = {}
    for words, base, automaton in automata(passages):
        low = np.zeros(1 << 16, bool)  # most words are in no passage; their hashes' high bits tell most of them
        low[(words >> np.uint64(48)).astype(np.int64)] = True
        for a, b in groups:
            if a not in scanned:
                if len(scanned) == 4:
                    scanned.clear()
                h, bounds, starts, ends, joined = W.scan(texts[a:b])
                scanned[a] = h, bounds.tolist(), starts.tolist(), ends.tolist(), joined
            h, bounds, starts, ends, joined = scanned[a]
            maybe = np.flatnonzero(low[(h >> np.uint64(48)).astype(np.int64)])
            at = np.minimum(np.searchsorted(words, h[maybe]), len(words) - 1)
            code = np.full(len(h), -1)
            code[maybe] = np.where(words[at] == h[maybe], at, -1)
            text = spelt(code, base)
            size = np.where(code < 0, 1, 3)
            word_of = np.repeat(np.arange(len(h)), size)
            chars = np.concatenate([[0], np.cumsum(size)])[bounds].tolist()
            for k, (s, e) in enumerate(zip(bounds[:-1], bounds[1:])):
                if s == e:
                    continue
                mine = out[a + k]
                for end, (head, sizes) in automaton.iter(text, chars[k], chars[k + 1]):
                    at = int(word_of[end]) - head + 1
                    for n, known in sizes.items():
                        if at + n > e:
                            continue
                        body = joined[starts[at] : ends[at + n - 1]]
                        first_id = known.get(body)
                        if first_id is None:  # white space other than single spaces
                            body = b" ".join(body.split())
                            first_id = known.get(body)
                        if first_id is not None:
                            mine.append((at - s, n, first_id, body))
    return out


def removals(doc_id: int, found: list[tuple[int, int, int, bytes]]) -> list[tuple[int, int]]:
    """The (first word, words) ranges that go from a document, given the occurrences of passages in it."""
    seen, out = set(), []
    for start, n, first_id, body in sorted(found, key=lambda x: x[0]):
        if doc_id < first_id:  # here it is part of a longer segment, whose windows are compared
            continue
        if doc_id == first_id and body not in seen:
            seen.add(body)
            continue
        out.append((start, n))
    return out


def _removed(passages: shards.Companion, covers: shards.Companion, with_text: bool):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        names = ["doc_id", "n_words", "n_removed", "kept_sha256"] + ["kept_text"] * with_text
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()] + [pa.string()] * with_text

        def stretch(shard, rows, spans, known):
            """The results of some rows of a shard."""
            texts = [r[1].encode("utf-8", "surrogatepass") for r in rows]
            found = occurrences(known, [t if r[0] is not None else b"" for r, t in zip(rows, texts)]) if known else [()] * len(rows)
            out = []
            for (i, text, tag), data, hits in zip(rows, texts, found):
                own = data.split()
                n, gone = len(own), removals(i, hits) + list(spans.get((i, tag), ()))
                if gone:
                    drop = np.zeros(n + 1, dtype=np.int32)
                    for c, d in gone:
                        drop[c] += 1
                        drop[c + d] -= 1
                    own = [w for w, k in zip(own, (np.cumsum(drop[:-1]) == 0).tolist()) if k]
                kept = b" ".join(own)
                out.append((i, n, n - len(own), hashlib.sha256(kept).hexdigest()) + ((kept.decode("utf-8", "surrogatepass") if gone else text,) if with_text else ()))
            return out

        shard, spans, known = None, {}, []
        for batch in batches:
            ids, texts, tags, of = (c.to_pylist() for c in batch.columns[:4])
            out, at = [], 0
            while at < len(ids):
                end = at
                while end < len(ids) and of[end] == of[at]:
                    end += 1
                if of[at] != shard:
                    shard, spans = of[at], {}
                    table = covers.rows(shard, ["id", "tag", "start", "n"])
                    if table is not None:
                        for a, b, c, d in zip(*[table.column(k).to_pylist() for k in ("id", "tag", "start", "n")]):
                            spans.setdefault((a, b), []).append((c, d))
                    table = passages.rows(shard, ["body", "first_id"])
                    known = [] if table is None else list(dict.fromkeys(zip(*[table.column(k).to_pylist() for k in ("body", "first_id")])))
                out += stretch(shard, list(zip(ids[at:end], texts[at:end], tags[at:end])), spans, known)
                at = end
            cols = list(zip(*out)) if out else [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(cols, kinds)] + batch.columns[4:], names=names + [f"x_{k}" for k in range(len(batch.columns) - 4)])

    return run


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 20, with_text: bool = False, extra: list[str] = ()) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256, of the words left, joined by single spaces. With `with_text` also
    kept_text: that string, or the text as it was where nothing goes. `extra` columns are passed through."""
    spark = docs.sparkSession
    store.arrow_rows(spark, 2048)
    copy = shards.sharded(docs, id_col, text_col, extra)
    routes = A.routes(copy, word_units, width, GRAM, True)
    found = store.written(copy.select("id", "text", "tag", "shard").mapInArrow(_opened(routes, width), SPAN), "spans")
    sources = found.where("body is not null").select("anchor", "key", "body")
    wanted = routes.frame(spark).where("again").select("shard", "anchor", "key", "first_id")
    passages = shards.companions(wanted.join(sources.hint("merge"), ["anchor", "key"]).select("shard", "body", "first_id"), "passages")
    windows = found.where("w1 is not null")
    earliest = windows.groupBy("w1", "w2").agg(F.min("id").alias("first_id"), F.max("id").alias("_last")).where("first_id < _last")
    later = windows.join(earliest, ["w1", "w2"]).where("id > first_id").select("id", "tag", "shard", "start", "n")
    covers = shards.companions(found.where("w1 is null and body is null").select("id", "tag", "shard", "start", "n").unionByName(later), "removals")
    store.remove(spark, routes.path)
    store.dropped(found)
    passed = [f"x_{k}" for k in range(len(extra))]
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text + "".join(f", {p} {copy.schema[p].dataType.simpleString()}" for p in passed)
    out = copy.select("id", "text", "tag", "shard", *passed).mapInArrow(_removed(passages, covers, with_text), schema)
    return out.withColumnsRenamed(dict(zip(passed, extra)))
