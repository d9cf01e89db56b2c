"""Near-duplicate groups by fast similarity sketching, banding and exact verification.

Sketch: round i throws every shingle into a bin by its i-th hash, a bin keeps the least (round, value), and rounds go
on until each of the K bins is full; from round K on, all shingles go to bin i - K, so that no bin can stay empty. The
sketch is then an unbiased estimate of Jaccard similarity with the concentration of K independent permutations, in
time n + K log K instead of n K.

Steps, none of which puts a group into one task or lists all pairs of one:
1. documents with equal sets are one node (a partial aggregate over 128-bit set digests);
2. bands of R coordinates give buckets; each member is compared, on full sets, with its bucket's smallest member;
3. members of buckets that are larger than HOT, such as those of pages with one template, get longer keys, of LONG
   coordinates, whose buckets step 2 handles in turn; few unlike documents share one;
4. confirmed links are joined into components; buckets that still span components compare, in blocks, only members of
   different components, first by sketch estimate and then, if they come near, on full sets. A member of a bucket of
   HOT is copied to HOT / BLOCK blocks at most.
A pair at the threshold meets in no bucket with probability (1 - t**R)**B, 5e-6 for the defaults at 0.75, and under no
longer key with 4e-6. Sets are those of 64-bit hashes of shingles: of two different sets, one in about 2**64 / n
would count a shingle as shared that is not.

Defined results: texts without words are in no group (component_id is the own id); a text of fewer words than a
shingle is one shingle; rows that repeat an id are one node, linked if any of its rows is; rows with a null id keep
null component_id and are kept; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import store
from millrace.llm import words as W
from millrace.llm.components import components

R, B = 4, 32
K = 512  #: coordinates; the first R * B make the bands, all of them, cut to 8 bits, the estimates
BLOCK = 256  #: members of a bucket that are compared with one another, or with another block, in one step
HOT = 4096  #: members of a bucket beyond which it is dealt again by LONG coordinates
LONG = 6


def shingle_sets(texts: list[bytes], width: int = 5):
    """(values, bounds): the sorted distinct 64-bit shingle hashes of each text, one after another."""
    import numpy as np

    h, bounds, *_ = W.scan([t.lower() for t in texts])  # bytes.lower() changes A-Z only
    g = W.grams(h, width)
    parts, sizes = [], []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        n = b - a
        if n >= width:
            own = np.sort(g[a : b - width + 1])
            own = own[np.concatenate([[True], own[1:] != own[:-1]])]
        elif n:
            own = W.grams(h[a:b], n) ^ np.uint64(n)
        else:
            own = h[:0]
        parts.append(own)
        sizes.append(len(own))
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


def sketch(values, bounds, k: int = K):
    """The k coordinates (uint64) of each set; rows of empty sets are all ones."""
    import numpy as np

    n = len(bounds) - 1
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    bins = np.full(n * k, full, dtype=np.uint64)
    doc = np.repeat(np.arange(n), np.diff(bounds))
    x = values
    for i in range(2 * k):
        if not len(x):
            break
        y = W.mix(x + np.uint64((i + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        at = (y % np.uint64(k)).astype(np.int64) if i < k else np.int64(i - k)
        np.minimum.at(bins, doc * k + at, (np.uint64(i) << np.uint64(54)) | (y >> np.uint64(10)))
        open_docs = (bins.reshape(n, k) == full).any(axis=1)
        if not open_docs[doc].all():
            on = open_docs[doc]
            x, doc = x[on], doc[on]
    return bins.reshape(n, k)


def band_keys(coords, rows: int = R):
    """One 64-bit key per band of `rows` coordinates; the band's number is part of the key."""
    import numpy as np

    n, k = coords.shape
    c = coords.reshape(n, k // rows, rows)
    key = np.arange(k // rows, dtype=np.uint64)[None, :] * np.uint64(0xD6E8FEB86659FD93) + np.uint64(1)
    for j in range(rows):
        key = W.mix(key ^ c[:, :, j]) + np.uint64(j)
    return key.view(np.int64)


def _sketched(docs: DataFrame, width: int) -> DataFrame:
    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            texts = [(t or "").encode("utf-8", "surrogatepass") for t in batch.column(1).to_pylist()]
            for a, b in W.slices(texts):
                values, bounds = shingle_sets(texts[a:b], width)
                coords = sketch(values, bounds)
                sizes = np.diff(bounds)
                bands = band_keys(coords[:, : R * B])
                low = (coords & np.uint64(0xFF)).astype(np.uint8)
                digest = [hashlib.blake2b(values[s:e].tobytes(), digest_size=16).digest() if e > s else None for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(sizes, pa.int64()), pa.array(digest, pa.binary()), pa.array([x.tobytes() if d else None for x, d in zip(bands, digest)], pa.binary()), pa.array([x.tobytes() if d else None for x, d in zip(low, digest)], pa.binary())],
                    names=["id", "n_shingles", "digest", "bands", "low"],
                )

    return docs.mapInArrow(run, "id long, n_shingles long, digest binary, bands binary, low binary")


def _exploded(nodes: DataFrame) -> DataFrame:
    """(key, id) of each band of each node. The packed keys are unpacked with SQL functions."""
    unpack = f"transform(sequence(0, {B - 1}), i -> cast(conv(hex(substring(bands, 8 * i + 1, 8)), 16, -10) as bigint))"
    return nodes.select("id", F.explode(F.expr(unpack)).alias("key"))


def _verified(pairs: DataFrame, docs: DataFrame, percent: int, width: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets are similar enough."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        last, last_set = None, None

        def distinct(text):
            return shingle_sets([text.encode("utf-8", "surrogatepass")], width)[0]

        for batch in batches:
            a, b, ta, tb = [c.to_pylist() for c in batch.columns]
            ok = []
            for x, y in zip(ta, tb):
                if y != last:
                    last, last_set = y, distinct(y)
                own = distinct(x)
                both = len(np.intersect1d(own, last_set, assume_unique=True))
                ok.append(100 * both >= percent * (len(own) + len(last_set) - both))
            mask = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], names=["a", "b"])

    with_a = pairs.join(docs.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a")
    both = with_a.join(docs.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b")
    return both.select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def _across(blocks: DataFrame, percent: int) -> DataFrame:
    """Pairs of different components in each (key, i, j) group of rows sorted by it, whose sketches come near. Rows:
    key, i, j, own, id, comp, low, bands (null under longer keys)."""
    t = percent / 100
    least = max(0.0, t - 5 * (t * (1 - t) / K) ** 0.5)  # five standard deviations below the threshold

    def run(batches):
        import numpy as np
        import pyarrow as pa

        def near(rows):
            left = [r for r in rows if r[3] == r[1]]
            right = left if rows[0][1] == rows[0][2] else [r for r in rows if r[3] == r[2]]
            if not left or not right:
                return
            sa, sb = (np.frombuffer(b"".join(r[6] for r in x), dtype=np.uint8).reshape(len(x), K) for x in (left, right))
            longer = rows[0][7] is None
            if not longer:
                ba, bb = (np.frombuffer(b"".join(r[7] for r in x), dtype=">i8").reshape(len(x), B) for x in (left, right))
            comp_b = np.array([r[5] for r in right])
            for k, r in enumerate(left):
                hit = ((sb == sa[k]).sum(axis=1) >= least * K) & (comp_b != r[5])
                if left is right:
                    hit[: k + 1] = False
                hit = np.flatnonzero(hit)
                if longer:
                    for m in hit.tolist():
                        yield (min(r[4], right[m][4]), max(r[4], right[m][4]))
                    continue
                # two members share several buckets; only the first of them tells of the pair
                shared = (bb[hit] == ba[k]).argmax(axis=1)
                for m in hit[ba[k][shared] == r[0]].tolist():
                    yield (min(r[4], right[m][4]), max(r[4], right[m][4]))

        def pairs():
            group, rows = None, []
            for batch in batches:
                for row in zip(*[c.to_pylist() for c in batch.columns]):
                    if row[:3] != group:
                        if rows:
                            yield from near(rows)
                        group, rows = row[:3], []
                    rows.append(row)
            if rows:
                yield from near(rows)

        out = []
        for p in pairs():
            out.append(p)
            if len(out) == 8192:
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], names=["a", "b"])
                out = []
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], names=["a", "b"])

    return blocks.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75, width: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of `docs`.

    Documents are linked where 100 * |intersection| >= percent * |union| of their shingle sets.
    """
    spark = docs.sparkSession
    store.arrow_rows(spark, 512)
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    sketched = store.written(_sketched(base, width), "sketch")
    owners = sketched.where("digest is not null and id is not null").groupBy("digest").agg(F.min("id").alias("node"))
    joined = sketched.join(owners, "digest", "left").withColumn("node", F.when(F.col("id").isNotNull(), F.coalesce("node", "id")))
    own = F.col("id") == F.col("node")
    nodes = store.written(joined.select("id", "n_shingles", "node", F.when(own, F.col("bands")).alias("bands"), F.when(own, F.col("low")).alias("low")), "nodes")
    store.dropped(sketched)

    def led(keys: DataFrame, told: DataFrame | None, name: str):
        """(members, pairs, links): buckets of at least two, members with their leaders, and what is confirmed of it."""
        leaders = store.written(keys.groupBy("key").agg(F.min("id").alias("b"), F.max("id").alias("_last"), F.count("*").alias("m")).where("b < _last").select("key", "b", "m"), f"leaders-{name}")
        members = store.written(keys.join(leaders, "key").select("key", "id", "b", "m"), f"members-{name}")
        store.dropped(leaders)
        pairs = members.where("id <> b").selectExpr("b as a", "id as b").distinct()
        new = pairs if told is None else pairs.join(told, ["a", "b"], "left_anti")
        return members, pairs, store.written(_verified(new, base, percent, width), f"links-{name}")

    members, pairs, links = led(_exploded(nodes.where("bands is not null")), None, "short")
    made = [members, links]
    if members.where(F.col("m") > HOT).isEmpty():
        wide = members.withColumn("longer", F.lit(False))
    else:
        hot = members.where(F.col("m") > HOT).select("id").distinct()
        slots = f"transform(sequence(0, {K // LONG - 1}), i -> xxhash64(i, substring(low, {LONG} * i + 1, {LONG})))"
        keys = nodes.where("low is not null").select("id", "low").join(hot, "id").select("id", F.explode(F.expr(slots)).alias("key"))
        second, more_pairs, more_links = led(keys, pairs, "long")
        made += [second, more_links]
        wide = members.where(F.col("m") <= HOT).withColumn("longer", F.lit(False)).unionByName(second.withColumn("longer", F.lit(True)))
        pairs, links = pairs.unionByName(more_pairs), links.unionByName(more_links)

    comp = components(links, "near")
    labelled = wide.join(comp, "id", "left").select("key", "longer", "id", "m", F.coalesce("component", "id").alias("comp"))
    split = labelled.groupBy("key", "longer").agg(F.min("comp").alias("_lo"), F.max("comp").alias("_hi")).where("_lo < _hi").select("key", "longer")
    open_members = store.written(labelled.join(split, ["key", "longer"]), "open")
    made.append(open_members)
    if not open_members.isEmpty():
        n_blocks = F.ceil(F.col("m") / BLOCK).cast("int")
        mine = F.pmod(F.xxhash64("id"), n_blocks).cast("int")
        with_block = open_members.withColumn("n", n_blocks).withColumn("own", mine)
        to = with_block.select("key", "longer", "id", "comp", "own", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("other"))
        dealt = to.select("key", "longer", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "id", "comp")
        sketches = nodes.where("low is not null").select("id", "low", "bands")
        with_low = dealt.join(sketches, "id").select("key", "i", "j", "own", "id", "comp", "low", F.when(~F.col("longer"), F.col("bands")).alias("bands"))
        blocks = with_low.repartition(store.partitions(spark), "key", "i", "j").sortWithinPartitions("key", "i", "j", F.col("bands").isNull())
        more = _across(blocks, percent).distinct().join(pairs, ["a", "b"], "left_anti")
        found = store.written(_verified(more, base, percent, width), "links")
        made.append(found)
        if not found.isEmpty():
            comp = components(links.unionByName(found), "near")
    component = F.coalesce("component", "node")
    out = nodes.select("id", "n_shingles", "node").join(comp.select(F.col("id").alias("node"), "component"), "node", "left")
    result = store.written(out.select(F.col("id").alias("doc_id"), "n_shingles", component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept")), "near")
    for table in [nodes, *made]:
        store.dropped(table)
    return result
