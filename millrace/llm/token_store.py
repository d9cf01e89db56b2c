"""Content-addressed store of token ids.

Texts are encoded once. A rolling hash over the ids cuts every document's stream into chunks, so equal passages give
equal chunks wherever they start; a chunk is named by the digest of its ids. One exchange carries both halves of the
store: chunks go to the pack that owns their digest, where each is written once, and document recipes (lists of
digests) go to their range of ids, where they are written in ascending order. A task sends the ids of a chunk only
the first time it meets it, so a chunk that a third of all documents share costs one row a task, not one a document.

Files, below the store's path: packs/*.pack and recipes/*.rcp, and `manifest`, a Parquet table with one row a file. A
file is written under a temporary name and renamed; the manifest appears last, through Spark's committer, and readers
open only what it lists, so that a lost executor or a repeated task leaves nothing half done.

Every recipe carries the Merkle root of its chunk digests, every file the root over its entries, and `store_root`
gives the root over all files. Reading recomputes the digests from the ids and the roots from the digests.

Defined results: a null or empty text is the end id alone; rows with a null id come first; rows that repeat an id are
separate documents in the order of their roots; other columns are ignored; an empty table gives an empty store.
"""

from __future__ import annotations

import hashlib
import struct

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import ranges, store, tokens

WINDOW, LEAST, MEAN, MOST = 16, 64, 256, 2048
SEEN = 500_000  #: digests a task remembers having sent; beyond it a chunk may be sent again, and is still stored once
BLOCK = 256  #: chunks compressed together
MANIFEST = "kind string, file string, shard int, entries long, ids long, bytes long, sha256 string, root string, first_id long, last_id long"
_DOC = "<?qQI"
_CHUNK = "<16sIB"


def _gear():
    import numpy as np

    x = np.arange(1 << 16, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x632BE59BD9B4E019)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return (x ^ (x >> np.uint64(32))).astype(np.uint32)  # a cut is told by bits below 32, and carries go up only


def cut_points(ids, bounds, gear) -> list[list[int]]:
    """The ends of the chunks of each document; `ids` holds all documents, `bounds` their offsets.

    The hash of the last WINDOW ids comes from four shifted additions over the whole array. A cut is a position where
    its low bits are zero, at least LEAST after the last cut (so the window never reaches another document) and at
    most MOST.
    """
    import numpy as np

    h = gear.take(ids & np.uint32(0xFFFF))
    h += ids >> np.uint32(16)
    step = 1
    while step < WINDOW:
        h[step:] += h[:-step] << np.uint32(step)
        step *= 2
    marks = np.flatnonzero(h & np.uint32(MEAN - 1 << 20) == 0) + 1
    out = []
    spans = np.searchsorted(marks, bounds)
    for k in range(len(bounds) - 1):
        a, b = int(bounds[k]), int(bounds[k + 1])
        ends, at = [], a
        for m in marks[spans[k] : spans[k + 1]].tolist():
            while m - at > MOST:
                at += MOST
                ends.append(at)
            if m - at >= LEAST and m < b:
                ends.append(m)
                at = m
        while b - at > MOST:
            at += MOST
            ends.append(at)
        if b > at:
            ends.append(b)
        out.append(ends)
    return out


def merkle(nodes: list[bytes]) -> bytes:
    """The root of a binary hash tree; an odd node is carried up."""
    if not nodes:
        return hashlib.blake2b(b"", digest_size=16).digest()
    while len(nodes) > 1:
        nodes = [hashlib.blake2b(b"\x01" + b"".join(nodes[i : i + 2]), digest_size=16).digest() if i + 1 < len(nodes) else nodes[i] for i in range(0, len(nodes), 2)]
    return nodes[0]


def _digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def _narrow(data: bytes) -> bytes:
    """Ids as 16-bit integers where all fit, marked by the first byte."""
    import numpy as np

    a = np.frombuffer(data, dtype="<u4")
    return b"\x02" + a.astype("<u2").tobytes() if not len(a) or a.max() < 1 << 16 else b"\x04" + data


def _widen(data: bytes) -> bytes:
    import numpy as np

    return np.frombuffer(data, dtype="<u2", offset=1).astype("<u4").tobytes() if data[:1] == b"\x02" else data[1:]


def _values(column) -> list:
    """What to_pylist() gives for a column without nulls, several times as fast."""
    return column.to_numpy(zero_copy_only=False).tolist()


def _split(encoder_path: str, end_id: int, packs: int):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        gear, seen = _gear(), set()
        end = struct.pack("<I", end_id)
        schema = pa.schema([("part", pa.int32()), ("order", pa.binary()), ("doc_id", pa.int64()), ("digest", pa.binary()), ("n", pa.int64()), ("body", pa.binary())])
        for batch in batches:
            if not batch.num_rows:
                continue
            doc_ids, shards = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            texts = [t or "" for t in batch.column(1).to_pylist()]
            data = [x + end for x in tokens.Encoder.of(encoder_path).encode(texts)]
            joined = b"".join(data)
            bounds = np.concatenate([[0], np.cumsum([len(x) // 4 for x in data])])
            rows = [[] for _ in schema]
            ids = np.frombuffer(joined, dtype="<u4")
            short = ids.astype("<u2").tobytes() if ids.max() < 1 << 16 else None
            for k, ends in enumerate(cut_points(ids, bounds, gear)):
                at, recipe, sizes = int(bounds[k]), [], []
                for e in ends:
                    body = joined[4 * at : 4 * e]
                    name = _digest(body)
                    recipe.append(name)
                    sizes.append(e - at)
                    if name not in seen:
                        if len(seen) >= SEEN:
                            seen.clear()
                        seen.add(name)
                        kept = _narrow(body) if short is None else b"\x02" + short[2 * at : 2 * e]
                        for c, v in zip(rows, (int.from_bytes(name[:4], "big") * packs >> 32, name, None, name, e - at, kept)):
                            c.append(v)
                    at = e
                root = merkle(recipe)
                order = (b"\x00" + b"\x00" * 8 if doc_ids[k] is None else b"\x01" + struct.pack(">Q", doc_ids[k] + (1 << 63))) + root
                recipe_body = b"".join(recipe) + np.array(sizes, dtype="<u4").tobytes()
                for c, v in zip(rows, (packs + shards[k], order, doc_ids[k], root, len(data[k]) // 4, recipe_body)):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(rows, schema)], schema=schema)

    return run


class _File:
    """A file under a temporary name; `commit` renames it, which replaces what another attempt wrote."""

    def __init__(self, root: str, name: str):
        import uuid

        self.fs, base = store.opened(root)
        self.to, self.tmp = f"{base}/{name}", f"{base}/{name.rpartition('/')[0]}/_{uuid.uuid4().hex}.tmp"
        self.fs.create_dir(self.to.rpartition("/")[0], recursive=True)
        self.out, self.sha, self.size = self.fs.open_output_stream(self.tmp), hashlib.sha256(), 0

    def write(self, data: bytes) -> None:
        self.out.write(data)
        self.sha.update(data)
        self.size += len(data)

    def commit(self) -> str:
        self.out.close()
        self.fs.move(self.tmp, self.to)
        return self.sha.hexdigest()


def _write(root: str, packs: int):
    def run(batches):
        import pyarrow as pa

        codec = pa.Codec("zstd", compression_level=3)
        out, part, file, last, block, names, ids, first, final = [], None, None, None, [], [], 0, None, None

        def flush():
            if block:
                raw = b"".join(struct.pack(_CHUNK, d, len(b), 0) + b for d, b in block)
                packed = codec.compress(raw, asbytes=True)
                file.write(struct.pack("<II", len(packed), len(raw)) + packed)
                block.clear()

        def close():
            if file is None:
                return
            flush()
            kind = "pack" if part < packs else "recipe"
            out.append((kind, name, part if part < packs else part - packs, len(names), ids, file.size, file.commit(), merkle(names).hex(), first, final))

        for batch in batches:
            part_of, _, doc_id_of, *others = batch.columns
            doc_ids = doc_id_of.to_pylist() if doc_id_of.null_count < len(doc_id_of) else [None] * len(doc_id_of)
            for p, doc_id, digest, n, body in zip(_values(part_of), doc_ids, *map(_values, others)):
                if p != part:
                    close()
                    part, last, names, ids, first, final = p, None, [], 0, None, None
                    name = f"packs/{p:06d}.pack" if p < packs else f"recipes/{p - packs:06d}.rcp"
                    file = _File(root, name)
                if p < packs:
                    if digest == last:
                        continue
                    last = digest
                    block.append((digest, body))
                    if len(block) == BLOCK:
                        flush()
                else:
                    first, final = (doc_id if first is None else first), doc_id
                    block.append((digest, struct.pack(_DOC, doc_id is None, doc_id or 0, n, len(body) // 20) + body))
                    if len(block) == BLOCK:
                        flush()
                names.append(digest)
                ids += n
        close()
        cols = list(zip(*out)) if out else [[] for _ in range(10)]
        types = [pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(cols, types)], names=["kind", "file", "shard", "entries", "ids", "bytes", "sha256", "root", "first_id", "last_id"])

    return run


def write_store(docs: DataFrame, root: str, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end_id: int = 2, docs_per_recipe_file: int = 1_000_000) -> DataFrame:
    """Encodes `docs` into a store below `root` and returns its manifest."""
    spark = docs.sparkSession
    store.arrow_rows(spark, 1024)
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    packs = store.partitions(spark)
    n = base.count()
    bounds = ranges.cuts(base, "doc_id", F.lit(1), max(-(-n // docs_per_recipe_file), min(packs, n // 5000)))
    recipes = len(bounds) + 1
    rows = base.select("doc_id", "text", ranges.shard_of("doc_id", bounds).alias("shard")).mapInArrow(_split(tokenizer or tokens.default_path(), end_id, packs), "part int, order binary, doc_id long, digest binary, n long, body binary")
    placed = rows.repartitionById(packs + recipes, F.col("part")).sortWithinPartitions("part", "order")
    files = placed.mapInArrow(_write(root, packs), MANIFEST)
    return store.written(files, "manifest", f"{root}/manifest")


def store_root(manifest: DataFrame) -> str:
    """The Merkle root over all files, in order of kind and shard: a few hundred bytes a file reach the driver."""
    return merkle([bytes.fromhex(r.root) for r in manifest.orderBy("kind", "shard").select("root").collect()]).hex()


def _entries(root: str, name: str, sha256: str, want_root: str):
    """(digest, body) of a file, block by block; raises where the file or its root differs from the manifest."""
    import pyarrow as pa

    codec, names = pa.Codec("zstd"), []
    fs, base = store.opened(root)
    sha = hashlib.sha256()
    with fs.open_input_stream(f"{base}/{name}") as f:
        while head := f.read(8):
            packed_len, raw_len = struct.unpack("<II", head)
            packed = f.read(packed_len)
            sha.update(head)
            sha.update(packed)
            raw, at = codec.decompress(packed, raw_len, asbytes=True), 0
            while at < len(raw):
                digest, size, _ = struct.unpack_from(_CHUNK, raw, at)
                at += struct.calcsize(_CHUNK)
                names.append(digest)
                yield digest, raw[at : at + size]
                at += size
    if sha.hexdigest() != sha256 or merkle(names).hex() != want_root:
        raise ValueError(f"{name} differs from its manifest")


def _listed(manifest: DataFrame, kind: str) -> DataFrame:
    """The files of a kind, each with the number of ids in the files before it, one task a file."""
    rows = manifest.where(F.col("kind") == kind).select("file", "shard", "sha256", "root", "ids").orderBy("shard").collect()
    at, out = 0, []
    for r in rows:
        out.append((r.file, r.sha256, r.root, at, r.shard))
        at += r.ids
    spark = manifest.sparkSession
    files = spark.createDataFrame(out, "file string, sha256 string, root string, before long, k int")
    return files.repartitionById(max(1, len(out)), F.expr(f"pmod(k, {max(1, len(out))})").cast("int"))


def read_chunks(manifest: DataFrame, root: str, with_ids: bool = False) -> DataFrame:
    """digest, n, crc32 of each stored chunk's ids, checked against its digest; `ids` (binary) only if asked for."""

    def run(batches):
        import zlib

        import pyarrow as pa

        for batch in batches:
            for name, sha, want in zip(*[batch.column(i).to_pylist() for i in range(3)]):
                out = [[], [], [], []]
                for digest, body in _entries(root, name, sha, want):
                    ids = _widen(body)
                    if _digest(ids) != digest:
                        raise ValueError(f"a chunk in {name} differs from its digest")
                    for c, v in zip(out, (digest, len(ids) // 4, zlib.crc32(ids), ids if with_ids else None)):
                        c.append(v)
                    if len(out[0]) == 4096:
                        yield _batch(out)
                        out = [[], [], [], []]
                yield _batch(out)

    def _batch(out):
        import pyarrow as pa

        return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(out, (pa.binary(), pa.int64(), pa.int64(), pa.binary()))], names=["digest", "n", "crc", "ids"])

    return _listed(manifest, "pack").mapInArrow(run, "digest binary, n long, crc long, ids binary")


def read_recipes(manifest: DataFrame, root: str) -> DataFrame:
    """One row a chunk of each document: doc_id, row (its place among all documents' ids), start, n_tokens, seq,
    digest, n, after (ids of the document behind the chunk)."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        names = ["doc_id", "start", "n_tokens", "seq", "digest", "n", "after"]

        def batch_of(docs, digests, sizes):
            k = [len(x) for x in sizes]
            null, ids, starts, totals = (np.repeat(np.array([d[i] for d in docs]), k) for i in range(4))
            seq = np.concatenate([np.arange(x, dtype=np.int32) for x in k])
            after = np.concatenate([d[3] - np.cumsum(x) for d, x in zip(docs, sizes)])
            raw = pa.Array.from_buffers(pa.binary(16), len(seq), [None, pa.py_buffer(b"".join(digests))]).cast(pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64(), mask=null.astype(bool)), pa.array(starts, pa.int64()), pa.array(totals, pa.int64()), pa.array(seq), raw, pa.array(np.concatenate(sizes), pa.int64()), pa.array(after, pa.int64())], names=names)

        for batch in batches:
            for name, sha, want, start in zip(*[batch.column(i).to_pylist() for i in range(4)]):
                docs, digests, sizes = [], [], []
                for root_digest, body in _entries(root, name, sha, want):
                    null, doc_id, n_tokens, k = struct.unpack_from(_DOC, body)
                    at = struct.calcsize(_DOC)
                    if merkle([body[at + 16 * i : at + 16 * i + 16] for i in range(k)]) != root_digest:
                        raise ValueError(f"a recipe in {name} differs from its root")
                    docs.append((null, doc_id, start, n_tokens))
                    digests.append(body[at : at + 16 * k])
                    sizes.append(np.frombuffer(body, dtype="<u4", offset=at + 16 * k).astype(np.int64))
                    start += n_tokens
                    if len(docs) == 2048:
                        yield batch_of(docs, digests, sizes)
                        docs, digests, sizes = [], [], []
                if docs:
                    yield batch_of(docs, digests, sizes)

    return _listed(manifest, "recipe").mapInArrow(run, "doc_id long, start long, n_tokens long, seq int, digest binary, n long, after long")


_SHIFT: list = []


def crc_shift(crc, zeros):
    """The CRC-32 contribution of data with checksum `crc` that `zeros` bytes follow, for arrays.

    Appending a zero byte is linear over GF(2), so 2**k of them are one 32x32 bit matrix, kept as four byte tables.
    XOR over a document's chunks gives the checksum of all its bytes.
    """
    import numpy as np

    if not _SHIFT:
        table = np.arange(256, dtype=np.uint32)
        for _ in range(8):
            table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1).astype(np.uint32)
        one = np.array([table[(1 << b) & 255] if b < 8 else (1 << b) >> 8 for b in range(32)], dtype=np.uint32)

        def tables(m):
            out = np.zeros((4, 256), dtype=np.uint32)
            for byte in range(4):
                for bit in range(8):
                    out[byte][np.arange(256) >> bit & 1 == 1] ^= m[8 * byte + bit]
            return out

        for _ in range(48):
            t = tables(one)
            _SHIFT.append(t)
            one = t[0][one & 255] ^ t[1][one >> 8 & 255] ^ t[2][one >> 16 & 255] ^ t[3][one >> 24]
    crc, zeros = np.asarray(crc, dtype=np.uint32).copy(), np.asarray(zeros, dtype=np.int64)
    for k, t in enumerate(_SHIFT):
        if not (zeros >> k).any():
            break
        on = zeros >> k & 1 == 1
        x = crc[on]
        crc[on] = t[0][x & 255] ^ t[1][x >> 8 & 255] ^ t[2][x >> 16 & 255] ^ t[3][x >> 24]
    return crc


def verify(manifest: DataFrame, root: str) -> DataFrame:
    """Each document as the files have it: doc_id, start, n_tokens, ids_crc32, n_chunks.

    Checksums come from the stored chunks and are combined along the recipes, so no ids are moved. A digest that very
    many recipes name makes a skewed join of small rows, which adaptive execution splits.
    """
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("long")
    def shifted(crc, zeros):
        import pandas as pd

        return pd.Series(crc_shift(crc.to_numpy(), zeros.to_numpy()).astype("int64"))

    recipes = read_recipes(manifest, root).withColumnRenamed("n", "n_recipe")
    chunks = read_chunks(manifest, root).select("digest", "n", "crc")
    joined = recipes.join(chunks.hint("merge"), "digest", "left").select("doc_id", "start", "n_tokens", "n_recipe", F.coalesce("n", F.lit(-1)).alias("n"), shifted(F.coalesce("crc", F.lit(0)), 4 * F.col("after")).alias("part"))
    out = joined.groupBy("doc_id", "start").agg(F.max("n_tokens").alias("n_tokens"), F.bit_xor("part").alias("ids_crc32"), F.sum("n").alias("_stored"), F.count("*").alias("n_chunks"))
    lost = F.raise_error(F.concat(F.lit("the store lacks chunks of document "), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    return out.select("doc_id", "start", F.when(F.col("_stored") == F.col("n_tokens"), F.col("n_tokens")).otherwise(lost.cast("long")).alias("n_tokens"), "ids_crc32", "n_chunks")


def reconstruct(manifest: DataFrame, root: str) -> DataFrame:
    """doc_id, start and the ids themselves (binary, little-endian 32-bit), for readers that want the streams."""
    joined = read_recipes(manifest, root).drop("n").join(read_chunks(manifest, root, True).select("digest", "ids").hint("merge"), "digest")
    parts = F.array_sort(F.collect_list(F.struct("seq", "ids")))
    return joined.groupBy("doc_id", "start").agg(F.max("n_tokens").alias("n_tokens"), parts.alias("_p")).select("doc_id", "start", "n_tokens", F.expr("unhex(array_join(transform(_p, x -> hex(x.ids)), ''))").alias("ids"))


def encode_and_read(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Writes a store in the shared folder and returns what reading it back gives."""
    root = store.fresh(spark, "token-store")
    return verify(write_store(docs, root), root)
