"""Approximate nearest neighbours: inverted lists scanned by adaptive numbers of dimensions.

Vectors are rotated by one random orthonormal matrix, so that the first d of D coordinates give an unbiased estimate of
a distance whose error shrinks as 1/sqrt(d). A list is kept as blocks of columns. For a query, partial squared
distances grow block by block, and after each block the candidates are dropped for which a test rejects, at EPSILON,
that their distance is within the query's tenth best so far. What is left is measured exactly on the original vectors,
which tightens the threshold for the rest of the list, and for the lists that the same task scans for the query later.

The index covers every row: the k-means centroids and the number of lists to probe are fitted on at most SAMPLE rows (a bound, not a share),
those with the smallest hashes wherever they are stored, then every vector is put into its nearest centroid's list. Equal vectors are one entry that carries its smallest ids, k + 1 of them,
which is all that any query can be given; the window that finds them limits before its shuffle. A list is searched in
blocks of at most BLOCK entries, each a group of its own, so the largest list does not make a large task. Queries are
streamed past a block. Only centroids and list sizes reach the driver; both are bounded by LISTS.

Defined results: vectors that are null, zero, of another length than most, or that hold null, NaN or infinite values
take no part, nor do rows with a null id; rows that repeat an id and a vector are one; an id with several vectors is
several candidates; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.llm import store

SAMPLE = 20_000
LISTS = 1024
COVER = 0.97
BLOCK = 4096
CHUNK = 512
CARRIED = 200_000  #: queries whose best distances a task carries from list to list
COLUMNS = 16
EPSILON = 2.1


def rotation(dim: int, seed: int = 7):
    """A random orthonormal matrix, the same for the same arguments."""
    import numpy as np

    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def kmeans(x, k: int, rounds: int = 10, seed: int = 7):
    """Centroids of the rows of x; an empty cluster takes the row farthest from its centroid."""
    import numpy as np

    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), size=min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        d = (c * c).sum(1)[None, :] - 2 * x @ c.T
        near = d.argmin(1)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=len(c))
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
        far = np.argsort(d[np.arange(len(x)), near])[::-1]
        for i, j in zip(np.flatnonzero(n == 0), far):
            c[i] = x[j]
    return c


def calibrated(x, centroids, k: int, cover: float = COVER) -> int:
    """How many lists to probe so that they hold `cover` of the k nearest neighbours, among the sample, of up to 256 of
    its rows. The whole table is denser than the sample, its neighbours nearer, so this errs on the safe side."""
    import numpy as np

    if len(x) < 2:
        return len(centroids)
    norms, own = (centroids**2).sum(1), (x * x).sum(1)
    near = (norms[None, :] - 2 * x @ centroids.T).argmin(1)
    q = np.arange(0, len(x), max(1, len(x) // 256))[:256]
    d = own[None, :] - 2 * x[q] @ x.T
    d[np.arange(len(q)), q] = np.inf
    best = np.argpartition(d, min(k, len(x) - 1) - 1, axis=1)[:, : min(k, len(x) - 1)]
    order = np.argsort(norms[None, :] - 2 * x[q] @ centroids.T, axis=1)
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.broadcast_to(np.arange(len(centroids)), order.shape), axis=1)
    ranks = np.sort(np.take_along_axis(place, near[best], axis=1).ravel())
    return int(ranks[min(len(ranks) - 1, int(cover * len(ranks)))]) + 1


def scan(query, least_ids, columns, exact, q_exact, k: int, tau: float = float("inf")):
    """(entry indices, scores) of the k entries nearest to a query, nearest first, ties to the smaller id; entries farther
    than `tau`, the k-th best distance that the query has elsewhere, may be left out.

    `columns` holds the rotated block by column blocks, `exact` the original vectors, `least_ids` the entries' least ids.
    Entries are taken CHUNK at a time; what a chunk leaves is measured exactly, and the k-th best so far is the next
    chunk's threshold.
    """
    import numpy as np

    m, dim = exact.shape
    kept, scores = np.zeros(0, np.int64), np.zeros(0)
    at = 0
    while at < m:
        size = CHUNK if tau < np.inf else max(4 * k, 32)  # the first few are measured outright
        active = np.arange(at, min(m, at + size))
        at += size
        if tau < np.inf:
            part, d = np.zeros(len(active)), 0
            for block in columns[:-1]:
                if len(active) <= 2:
                    break
                w = block.shape[1]
                part = part + ((block[active] - query[d : d + w]) ** 2).sum(1)
                d += w
                ok = part * (dim / d) <= (tau * (1 + EPSILON / np.sqrt(d))) ** 2
                active, part = active[ok], part[ok]
            if not len(active):
                continue
        kept = np.concatenate([kept, active])
        scores = np.concatenate([scores, np.sqrt(((exact[active] - q_exact) ** 2).sum(1))])
        if len(kept) > k:
            order = np.lexsort((least_ids[kept], scores))[:k]
            kept, scores = kept[order], scores[order]
        if len(kept) >= k:
            tau = min(tau, float(scores.max()))
    order = np.lexsort((least_ids[kept], scores))[:k]
    return kept[order], scores[order]


def _valid(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    v = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v")).where("id is not null and v is not null")
    return v.where("forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(v, x -> x <> 0)")


def search(vectors: DataFrame, every: int = 100, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", probes: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest other rows found for each row whose id is divisible by `every`."""
    import numpy as np

    spark = vectors.sparkSession
    store.arrow_rows(spark, 2048)
    valid = _valid(vectors, id_col, vec_col)
    dims = valid.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    if not dims:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim, rows = dims[0].d, dims[0]["count"]
    valid = valid.where(F.size("v") == dim)
    # the smallest hashes of all rows, not the first rows stored; the filter only keeps most rows from being sorted
    drawn = valid.select("v", F.pmod(F.xxhash64("id", "v"), F.lit(rows)).alias("h")).where(F.col("h") < SAMPLE + SAMPLE // 10)
    sample = drawn.orderBy("h").limit(SAMPLE).select("v").toArrow().column("v")
    x = np.array(sample.to_pylist(), dtype=np.float64).reshape(-1, dim)
    turn = rotation(dim)
    centroids = kmeans(x @ turn, int(min(LISTS, max(1, round(len(x) and rows**0.5))))) if len(x) else np.zeros((1, dim))
    n_lists = len(centroids)
    probes = probes or calibrated(x @ turn, centroids, k)

    def listed(batches):
        import numpy as np
        import pyarrow as pa

        norms = (centroids**2).sum(1)
        for batch in batches:
            if not batch.num_rows:
                continue
            v = batch.column("v")
            r = np.asarray(v.flatten()).reshape(-1, dim) @ turn
            near = (norms[None, :] - 2 * r @ centroids.T).argmin(1)
            yield pa.RecordBatch.from_arrays([pa.array(near, pa.int32()), batch.column("ids"), v], names=["list", "ids", "v"])

    def probed(batches):
        import numpy as np
        import pyarrow as pa

        norms = (centroids**2).sum(1)
        p = min(probes, n_lists)
        for batch in batches:
            if not batch.num_rows:
                continue
            v = batch.column("v")
            r = np.asarray(v.flatten()).reshape(-1, dim) @ turn
            d = norms[None, :] - 2 * r @ centroids.T
            best = np.argpartition(d, p - 1, axis=1)[:, :p]
            yield pa.RecordBatch.from_arrays([batch.column("id"), v, pa.array(best.tolist(), pa.list_(pa.int32()))], names=["id", "v", "lists"])

    copies = valid.distinct().withColumn("_r", F.row_number().over(Window.partitionBy("v").orderBy("id"))).where(F.col("_r") <= k + 1)
    entries = copies.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    index = store.written(entries.select("ids", "v").mapInArrow(listed, "list int, ids array<long>, v array<double>"), "index")
    sizes = {r.list: r["count"] for r in index.groupBy("list").count().collect()}
    blocks = F.element_at(F.array(*[F.lit(-(-sizes.get(i, 0) // BLOCK) or 1) for i in range(n_lists)]), F.col("list") + 1)
    queries = valid.where(F.pmod("id", F.lit(every)) == 0).distinct().mapInArrow(probed, "id long, v array<double>, lists array<int>")
    asked = queries.select("id", "v", F.explode("lists").alias("list")).select("list", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"), F.lit(1).alias("kind"), F.array("id").alias("ids"), "v")
    stored = index.select("list", F.pmod(F.xxhash64("ids"), blocks).cast("int").alias("block"), F.lit(0).alias("kind"), "ids", "v")
    both = stored.unionByName(asked).repartition(store.partitions(spark), "list", "block").sortWithinPartitions("list", "block", "kind")

    def scanned(batches):
        import numpy as np
        import pyarrow as pa

        group, ids, raw, ready = None, [], [], None
        best: dict = {}  # of a query: the k + 1 least distances that this task has found so far, in any list
        for batch in batches:
            out = [[], [], []]
            flat = np.asarray(batch.column("v").flatten()).reshape(-1, dim)
            for i, (a, b, kind, own) in enumerate(zip(batch.column("list").to_pylist(), batch.column("block").to_pylist(), batch.column("kind").to_pylist(), batch.column("ids").to_pylist())):
                if (a, b) != group:
                    group, ids, raw, ready = (a, b), [], [], None
                if kind == 0:
                    ids.append(own)
                    raw.append(flat[i])
                    continue
                if not ids:
                    continue
                if ready is None:
                    exact = np.array(raw)
                    r = exact @ turn
                    ready = exact, [np.ascontiguousarray(r[:, s : s + COLUMNS]) for s in range(0, dim, COLUMNS)], np.array([x[0] for x in ids])
                exact, columns, least = ready
                q, who = flat[i], (own[0], flat[i].tobytes())
                known = best.get(who, ())
                entries, scores = scan(q @ turn, least, columns, exact, q, k + 1, known[k] if len(known) > k else float("inf"))
                if len(best) >= CARRIED:
                    best.clear()
                best[who] = sorted([*known, *scores.tolist()])[: k + 1]
                for e, s in zip(entries, scores):
                    for other in ids[e]:
                        if other != own[0]:
                            for c, value in zip(out, (own[0], other, float(s))):
                                c.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.float64()))], names=["query_id", "vec_id", "score"])

    found = both.mapInArrow(scanned, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.distinct().withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
