"""Deterministic sharded WARC archives.

Records are dealt to contiguous ranges of page ids of about equal payload (exact weights, not samples), sorted inside
each range, and written as one gzip member each into files that roll when their compressed size passes a limit. All
headers and digests are generated from the rows, so equal inputs give equal bytes. A file is written under a
temporary name and renamed; the manifest, a Parquet table, appears last and readers open only what it lists, so lost
executors and repeated attempts leave nothing half written.

Equal payloads are found on digests alone: a partial aggregate, then a join of small rows that adaptive execution can
split when one payload is very common. What the join finds travels in the same exchange as the payloads, which are
therefore shuffled once. Payloads are read twice, for their sizes and digests and for the records.

Defined results: a null html is an empty payload; a null url becomes urn:page:<id>; rows with a null id come first and
are always responses; rows that repeat both an id and a payload have the same type and the same reference; other
columns are ignored; an empty table gives an empty manifest.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import ranges, store

ROLL_BYTES = 256 << 20
SHARD_BYTES = 1 << 30
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "file string, shard int, part int, records long, bytes long, sha256 string, first_id long, last_id long"


def b32sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>"


def _uri(url: str | None, page_id: int | None) -> str:
    """One line of printable characters, as a header needs."""
    return "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url) if url else f"urn:page:{page_id}"


def _record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers) + f"Content-Length: {len(block)}\r\n\r\n"
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(head.encode() + block + b"\r\n\r\n") + z.flush()


def page_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """The gzip member of a page: a response, or a revisit of page `refers_to`. Both name the payload's full size."""
    digest = b32sha1(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if refers_to is None else http
    headers = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", record_id(page_id, digest)), ("WARC-Date", date), ("WARC-Target-URI", _uri(url, page_id))]
    if refers_to is not None:
        headers += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to, digest)), ("X-Refers-To-Page-Id", str(refers_to))]
    headers += [("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Block-Digest", f"sha1:{b32sha1(block)}"), ("Content-Type", "application/http; msgtype=response")]
    if page_id is not None:
        headers.append(("X-Page-Id", str(page_id)))
    return _record(headers, block)


def _write(root: str, roll_bytes: int, date: str):
    def run(batches):
        import pyarrow as pa

        fs, base = store.opened(root)
        fs.create_dir(base, recursive=True)
        done, shard, part, f = [], None, 0, None

        class Out:
            def __init__(self, name):
                self.name, self.tmp = name, f"{base}/_{uuid.uuid4().hex}.tmp"
                self.stream, self.sha, self.size, self.records, self.first, self.last = fs.open_output_stream(self.tmp, compression=None), hashlib.sha256(), 0, 0, None, None
                self.put(_record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>"), ("WARC-Date", date), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n"))

            def put(self, data):
                self.stream.write(data)
                self.sha.update(data)
                self.size += len(data)

            def close(self):
                self.stream.close()
                fs.move(self.tmp, f"{base}/{self.name}")
                done.append((self.name, shard, part, self.records, self.size, self.sha.hexdigest(), self.first, self.last))

        refs, refs_of = {}, None
        for batch in batches:
            for s, kind, page_id, url, digest, payload, refers_to in zip(*[c.to_pylist() for c in batch.columns]):
                if s != shard:
                    if f:
                        f.close()
                    f, shard, part, refs, refs_of = None, s, 0, {}, None
                if kind == 0:
                    if refs_of != page_id:
                        refs, refs_of = {}, page_id
                    refs[digest] = refers_to
                    continue
                if f and f.size >= roll_bytes:
                    f.close()
                    f, part = None, part + 1
                if f is None:
                    f = Out(f"pages-{s:06d}-{part:05d}.warc.gz")
                f.put(page_record(page_id, url, payload, refs.get(digest) if refs_of == page_id and page_id is not None else None, date))
                f.records += 1
                f.first, f.last = (page_id if f.first is None else f.first), page_id
        if f:
            f.close()
        cols = list(zip(*done)) if done else [[] for _ in range(8)]
        types = [pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(cols, types)], names=["file", "shard", "part", "records", "bytes", "sha256", "first_id", "last_id"])

    return run


def write_archives(pages: DataFrame, root: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_payload: int = 0, roll_bytes: int = ROLL_BYTES, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Writes the archives below `root` and returns their manifest. Payloads under `min_payload` bytes never become revisits."""
    spark = pages.sparkSession
    store.arrow_rows(spark, 256)
    base = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.encode(F.coalesce(F.col(html_col).cast("string"), F.lit("")), "UTF-8").alias("payload"))
    keys = store.written(base.select("page_id", F.octet_length("payload").cast("long").alias("bytes"), F.sha1("payload").alias("digest")), "payload-keys")
    hashed = keys.where(F.col("page_id").isNotNull() & (F.col("bytes") >= min_payload))
    owners = hashed.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.max("page_id").alias("_last")).where("_last > refers_to")
    refs = hashed.join(owners, "digest").where(F.col("page_id") > F.col("refers_to")).select("page_id", "digest", "refers_to")
    size = F.col("bytes") + 512
    total = keys.agg(F.sum(size)).first()[0] or 0
    bounds = ranges.cuts(keys, "page_id", size, max(-(-total // SHARD_BYTES), min(store.partitions(spark), total >> 22)))
    shard = ranges.shard_of("page_id", bounds).alias("shard")
    rows = base.select(shard, F.lit(1).alias("kind"), "page_id", "url", F.sha1("payload").alias("digest"), "payload", F.lit(None).cast("long").alias("refers_to"))
    rows = rows.unionByName(refs.select(shard, F.lit(0).alias("kind"), "page_id", F.lit(None).cast("string").alias("url"), "digest", F.lit(None).cast("binary").alias("payload"), "refers_to"))
    placed = rows.repartitionById(len(bounds) + 1, F.col("shard")).sortWithinPartitions("shard", "page_id", "kind", "url", "digest")
    manifest = store.written(placed.mapInArrow(_write(root, roll_bytes, date), MANIFEST), "manifest", f"{root}/manifest")
    store.dropped(keys)
    return manifest


def _members(stream):
    """The decompressed members of a gzip stream, one by one."""
    z, data, out = zlib.decompressobj(31), b"", []
    while True:
        if not data:
            data = stream.read(1 << 20)
            if not data:
                break
        out.append(z.decompress(data))
        data = z.unused_data
        if z.eof:
            yield b"".join(out)
            z, out = zlib.decompressobj(31), []
    if out and any(out):
        raise ValueError("a gzip member ends too early")


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not lines[0].startswith("WARC/1."):
        raise ValueError("not a WARC record")
    headers = dict(line.split(": ", 1) for line in lines[1:])
    size = int(headers["Content-Length"])
    if rest[size:] != b"\r\n\r\n":
        raise ValueError(f"{headers['WARC-Record-ID']}: wrong length")
    return headers, rest[:size]


def read_archives(manifest: DataFrame, root: str, payloads: bool = False) -> DataFrame:
    """One row a page, from the files alone; every block, payload and file digest is checked. One task a file."""
    names = manifest.select("file", "sha256", "records")
    n = max(1, manifest.count())

    def run(batches):
        import pyarrow as pa

        fs, base = store.opened(root)
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
        cols = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "payload"]

        class Checked:
            def __init__(self, f):
                self.f, self.sha = f, hashlib.sha256()

            def read(self, k):
                data = self.f.read(k)
                self.sha.update(data)
                return data

        for batch in batches:
            for name, sha, want in zip(*[c.to_pylist() for c in batch.columns]):
                out, seen = [[] for _ in cols], 0
                with fs.open_input_stream(f"{base}/{name}", compression=None) as raw_file:
                    f = Checked(raw_file)
                    for raw in _members(f):
                        h, block = parse_record(raw)
                        if h["WARC-Type"] == "warcinfo":
                            continue
                        http, _, body = block.partition(b"\r\n\r\n")
                        size = int(http.rpartition(b"Content-Length: ")[2])
                        digest = h["WARC-Payload-Digest"][5:]
                        if h["WARC-Block-Digest"] != f"sha1:{b32sha1(block)}" or h["WARC-Type"] == "response" and (len(body) != size or b32sha1(body) != digest):
                            raise ValueError(f"{name}: {h['WARC-Record-ID']} differs from its digests")
                        page, ref = h.get("X-Page-Id"), h.get("X-Refers-To-Page-Id")
                        row = (page and int(page), size, digest, h["WARC-Type"], ref and int(ref), h["WARC-Target-URI"], body if payloads and h["WARC-Type"] == "response" else None)
                        for c, v in zip(out, row):
                            c.append(v)
                        seen += 1
                        if len(out[0]) == 256:
                            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(out, types)], names=cols)
                            out = [[] for _ in cols]
                if seen != want or f.sha.hexdigest() != sha:
                    raise ValueError(f"{name} differs from its manifest")
                yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(out, types)], names=cols)

    files = names.repartitionByRange(n, "file")
    return files.mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary")


def archive_and_read(spark: SparkSession, pages: DataFrame) -> DataFrame:
    root = store.fresh(spark, "warc")
    return read_archives(write_archives(pages, root), root).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
