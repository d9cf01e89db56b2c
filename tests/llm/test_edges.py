"""Every operator over nulls, empty and long texts, ties, repeated rows, empty tables and clashing extra columns, against
brute force."""

import base64
import hashlib
import re
import struct
import zlib

import numpy as np
import pytest

from millrace.llm import anchors, ann, chat, minhash, packing, phrases, quality, suffix, token_store, trie_bpe, warc
from millrace.llm import store

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
CLASH = ["id", "tag", "shard", "start", "n", "node", "digest", "kept", "n_words", "bands", "x_0", "_text", "component_id", "length"]
COPY = " ".join(f"shared{i}" for i in range(70))
TEXTS = {
    0: "Alpha beta gamma. " * 3 + COPY,
    1: COPY.upper(),
    2: COPY + " tail words here",
    3: None,
    4: "",
    5: "   \n\t ",
    6: "one two",
    7: "one two",
    8: "é ü " * 40 + COPY,
    9: ("repeat me " * 4000) + "\n" + ("line of text\n" * 50),
    10: COPY,
    11: " ".join(f"x{i % 7}y" for i in range(300)),
    12: "word, word.\nNext  line \t tab <|endoftext|> end\r\n",
    13: "".join(chr(0x4E00 + i % 500) for i in range(700)),
    -5: COPY + " negative id",
}


def words(t):
    return WORD.findall((t or "").encode())


def table(spark, rows, schema="doc_id long, text string"):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, schema)
    return df.select("*", *[F.lit("clash").alias(c) for c in CLASH if c not in df.columns]).repartition(3)


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, list(TEXTS.items()))


@pytest.fixture(scope="module")
def empty(spark):
    return table(spark, [])


@pytest.fixture(scope="module")
def odd(spark):
    """A repeated row, an id with two texts, a null id."""
    return table(spark, [(1, COPY), (1, COPY), (1, "other text"), (None, COPY), (2, COPY), (None, None)])


@pytest.fixture(scope="module")
def tok():
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def ids_of(tok, t):
    return np.array(tok.encode(t or "", add_special_tokens=False).ids, dtype="<u4")


def test_token_store(spark, docs, empty, odd, tok):
    root = store.fresh(spark, "t")
    manifest = token_store.write_store(docs, root)
    got = {r.doc_id: r for r in token_store.verify(manifest, root).collect()}
    whole = {r.doc_id: bytes(r.ids) for r in token_store.reconstruct(manifest, root).collect()}
    at = 0
    for i in sorted(TEXTS):
        data = ids_of(tok, TEXTS[i]).tobytes() + struct.pack("<I", 2)
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (at, len(data) // 4, zlib.crc32(data))
        assert whole[i] == data
        at += len(data) // 4
    chunks = token_store.read_chunks(manifest, root)
    assert chunks.count() == chunks.select("digest").distinct().count()
    assert len(token_store.store_root(manifest)) == 32
    assert token_store.encode_and_read(spark, empty).count() == 0
    assert sorted((r.doc_id or -1, r.n_tokens) for r in token_store.encode_and_read(spark, odd).collect())[-1][0] == 2
    assert token_store.encode_and_read(spark, odd).count() == 6


def test_token_store_detects_damage(spark, docs):
    root = store.fresh(spark, "t")
    manifest = token_store.write_store(docs, root)
    name = manifest.where("kind = 'pack'").first().file
    path = root.removeprefix("file://") + "/" + name
    data = bytearray(open(path, "rb").read())
    data[len(data) // 2] ^= 1
    open(path, "wb").write(bytes(data))
    with pytest.raises(Exception):
        token_store.verify(manifest, root).collect()


def test_crc_shift():
    rng = np.random.default_rng(0)
    for a, b in ((b"", b"abc"), (b"abc", b""), (rng.bytes(1000), rng.bytes(3333))):
        part = token_store.crc_shift([zlib.crc32(a), zlib.crc32(b)], [len(b), 0])
        assert int(part[0] ^ part[1]) == zlib.crc32(a + b)


def test_trie_bpe(spark, docs, empty, odd, tok):
    got = {r.doc_id: r for r in trie_bpe.encode_decode(docs).collect()}
    for i, t in TEXTS.items():
        ids = ids_of(tok, t)
        assert bytes(got[i].ids) == ids.tobytes()
        assert got[i].decoded == tok.decode(ids.tolist(), skip_special_tokens=False)
        assert got[i].decoded_sha256 == hashlib.sha256(got[i].decoded.encode()).hexdigest()
    assert trie_bpe.encode_decode(empty).count() == 0
    assert trie_bpe.encode_decode(odd).count() == 6


def test_trie_bpe_random(tok):
    import random

    import public_tokenizers

    from millrace.llm.tokens import Encoder

    rng = random.Random(11)
    alphabet = list("ab Ae'sdtrvm  \n\t\r\x1c\x85　éßñ中文😀12३.,!?-_#$<|>=") + ["<|endoftext|>", "'ll", " the", " \n", "\x00", "​"]
    texts = ["".join(rng.choices(alphabet, k=rng.randint(0, 50))) for _ in range(1500)]
    want = [ids_of(tok, t).tobytes() for t in texts]
    assert trie_bpe.Codec(public_tokenizers.path("byte_bpe_50k.json")).encode(texts) == want
    assert Encoder(public_tokenizers.path("byte_bpe_50k.json")).encode(texts) == want


def test_distinct_pieces_are_looked_up_once(tok, monkeypatch):
    """Op 1, round 2: repeated pieces of a group of texts cost one look-up and one encoding; words go to the model unsplit
    between marks, with the library's ids, whatever letters and closing punctuation stand together."""
    import public_tokenizers

    from millrace.llm.tokens import Encoder

    texts = ["über dem Fluß, the river (el río!) the river", "the river. über dem Fluß, no?! no", "", "à l'été; naïve###\nthe river"] * 30
    texts += [f"w{'abcdefghij'[k % 10]}ä{'xyzuvß'[k % 6]}{'' if k % 3 else '...'} the river" for k in range(300)]
    want = [ids_of(tok, t).tobytes() for t in texts]
    asked, taught, looked_up, words = [], [], Encoder._looked_up, Encoder._words
    monkeypatch.setattr(Encoder, "_looked_up", lambda self, pieces: asked.append(list(pieces)) or looked_up(self, pieces))
    monkeypatch.setattr(Encoder, "_words", lambda self, new, before: taught.extend((before, p) for p in new) or words(self, new, before))
    encoder = Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    assert encoder.encode(texts) == want
    assert asked and all(len(x) == len(set(x)) for x in asked) and taught and len(taught) == len(set(taught))
    assert len(encoder.marks) == 2
    other = Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    other.marks = []  # as for a vocabulary without control characters that stand alone
    assert other.encode(texts) == want


def test_white_space_before_special_tokens(tok):
    import public_tokenizers

    from millrace.llm.tokens import Encoder

    texts = ["a \n\n<|endoftext|>b", "  <|endoftext|>", "x  <|endoftext|>  y\n", "\n\n\n<|endoftext|>\n\n"]
    want = [ids_of(tok, t).tobytes() for t in texts]
    path = public_tokenizers.path("byte_bpe_50k.json")
    assert Encoder(path).encode(texts) == want and trie_bpe.Codec(path).encode(texts) == want


def test_warc(spark):
    pages = {1: ("http://a/x y\n", "<p>a</p>"), 2: (None, "<p>a</p>"), 3: ("u", None), 4: ("v", ""), 5: ("w", "ü" * 3000)}
    df = table(spark, [(i, u, h) for i, (u, h) in pages.items()] + [(None, "n", "<p>a</p>"), (2, None, "<p>a</p>")], "page_id long, url string, html string")
    got = [r for r in warc.archive_and_read(spark, df).collect()]
    assert len(got) == 7
    by = {r.page_id: r for r in got}
    for i, (_, h) in pages.items():
        b = (h or "").encode()
        assert (by[i].payload_bytes, by[i].payload_digest) == (len(b), base64.b32encode(hashlib.sha1(b).digest()).decode())
    assert [(by[i].record_type, by[i].refers_to) for i in (1, 2, 3, 4, 5)] == [("response", None), ("revisit", 1), ("response", None), ("revisit", 3), ("response", None)]
    assert by[None].record_type == "response"
    assert warc.archive_and_read(spark, df.limit(0)).count() == 0


def test_warc_is_deterministic_and_rolls(spark):
    df = table(spark, [(i, f"u{i}", f"<p>{i} {hashlib.sha256(str(i).encode()).hexdigest() * 20}</p>") for i in range(200)], "page_id long, url string, html string")
    a = warc.write_archives(df, store.fresh(spark, "w"), roll_bytes=20_000)
    b = warc.write_archives(df.repartition(7), store.fresh(spark, "w"), roll_bytes=20_000)
    key = lambda m: sorted((r.file, r.sha256) for r in m.collect())
    assert key(a) == key(b) and a.count() > 3


def test_ranges_of_clustered_keys(spark):
    """Keys in many tight clusters far apart: every range comes near its share."""
    from pyspark.sql import functions as F

    from millrace.llm import ranges

    df = spark.range(6000).selectExpr("pmod(id, 60) * 1000000000000 + shiftright(id, 2) as k")
    bounds = ranges.cuts(df, "k", F.lit(1), 200)
    sizes = [r["count"] for r in df.groupBy(ranges.shard_of("k", bounds)).count().collect()]
    assert 150 <= len(sizes) <= 201 and max(sizes) <= 60
    assert bounds == sorted(set(bounds)) and ranges.cuts(df.limit(0), "k", F.lit(1), 5) == []


def near_brute(texts):
    sets = {}
    for i, t in texts.items():
        w = words((t or "").translate({c: c + 32 for c in range(65, 91)}))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    comp = {i: i for i in texts}
    find = lambda x: x if comp[x] == x else find(comp[x])
    for a in texts:
        for b in texts:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                comp[y] = x
    return {i: (len(sets[i]), find(i)) for i in texts}


def test_near_duplicates(spark, docs, empty, odd):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(docs).collect()}
    assert got == near_brute(TEXTS)
    assert minhash.near_duplicates(empty).count() == 0
    rows = minhash.near_duplicates(odd).collect()
    assert len(rows) == 6 and {r.component_id for r in rows if r.doc_id is not None} == {1}


@pytest.mark.parametrize("hot", [4096, 2])
def test_near_duplicates_random_groups(spark, monkeypatch, hot):
    """With a low limit, members of large buckets meet by longer keys."""
    import random

    monkeypatch.setattr(minhash, "HOT", hot)

    rng = random.Random(4)
    texts, k = {}, 0
    for g in range(12):
        base = [f"g{g}w{rng.randint(0, 400)}" for _ in range(120)]
        for _ in range(rng.randint(1, 14)):
            w = list(base)
            for _ in range(rng.randint(0, 5)):
                w[rng.randrange(len(w))] = f"edit{rng.random()}"
            texts[k] = " ".join(w)
            k += 1
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(table(spark, list(texts.items()))).collect()}
    assert got == near_brute(texts)


def test_sketch_estimates_and_fills():
    a = np.sort(np.random.default_rng(1).integers(0, 1 << 63, 900, dtype=np.uint64))
    sets = [a[:600], a[300:], a[:1], a[:0]]
    s = minhash.sketch(np.concatenate(sets), np.cumsum([0] + [len(x) for x in sets]))
    assert (s[:3] != np.uint64(0xFFFFFFFFFFFFFFFF)).all()
    assert abs((s[0] == s[1]).mean() - 1 / 3) < 0.12


def test_components_chain(spark):
    from millrace.llm.components import components

    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r.id: r.component for r in components(edges).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}


def test_ann(spark):
    rng = np.random.default_rng(2)
    v = [(i, [float(x) for x in rng.normal(size=16)]) for i in range(400)]
    v += [(1000 + i, v[0][1]) for i in range(40)] + [(2000, None), (2001, [0.0] * 16), (2002, [float("nan")] * 16), (2003, [1.0]), (2004, [None] * 16), (None, [1.0] * 16), (1000, v[0][1])]
    df = table(spark, v, "vec_id long, embedding array<float>")
    good = {i: np.array(x, dtype=np.float32).astype(float) for i, x in v if i is not None and i not in (2000, 2001, 2002, 2003, 2004)}
    got = {}
    for r in ann.search(df).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(got) == {i for i in good if i % 100 == 0}
    hit = 0
    for q, rows in got.items():
        want = sorted((float(np.sqrt(((good[i] - good[q]) ** 2).sum())), i) for i in good if i != q)[:10]
        rows.sort()
        assert [r[0] for r in rows] == list(range(1, 11))
        hit += len({r[1] for r in rows} & {i for _, i in want})
    assert hit >= 0.9 * 10 * len(got)
    assert [r[1] for r in sorted(got[0])] == [1000 + i for i in range(10)]
    assert ann.search(df.limit(0)).count() == 0


def test_ann_scan_narrows():
    """The threshold narrows while a list is scanned: far entries behind near ones are not measured to the end."""
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=(40, 64)), 0.1 * rng.normal(size=(600, 64)), rng.normal(size=(3000, 64))])
    seen = []

    class Counted(np.ndarray):
        def __getitem__(self, k):
            if isinstance(k, np.ndarray):
                seen.append(len(k))
            return super().__getitem__(k)

    columns = [x[:, s : s + 16] for s in range(0, 64, 16)]
    q = np.zeros(64)
    got, scores = ann.scan(q, np.arange(len(x)), columns, x.view(Counted), q, 11)
    want = np.argsort((x**2).sum(1))[:11]
    assert got.tolist() == want.tolist() and np.allclose(scores, np.sqrt((x[want] ** 2).sum(1)))
    assert sum(seen) < 800
    none, _ = ann.scan(q, np.arange(len(x)), columns, x, q, 11, tau=float(scores[10]) / 4)
    assert len(none) <= 11


def test_ann_sample_is_spread(spark, monkeypatch):
    """A table stored cluster by cluster, a little under twice the sample: every cluster is fitted and found."""
    rng = np.random.default_rng(4)
    v = rng.normal(size=(39, 16)).repeat(20, axis=0) + 0.05 * rng.normal(size=(780, 16))
    fitted = []
    real = ann.kmeans
    monkeypatch.setattr(ann, "SAMPLE", 400)
    monkeypatch.setattr(ann, "kmeans", lambda x, k: fitted.append(x) or real(x, k))
    df = spark.createDataFrame(list(enumerate(v.tolist())), "vec_id long, embedding array<double>").coalesce(1)
    got = {}
    for r in ann.search(df, every=1).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    d = (((v @ ann.rotation(16))[:, None] - fitted[0][None]) ** 2).sum(2)
    rows = d.argmin(0)
    assert len(fitted[0]) == 400 and float(d.min(0).max()) < 1e-12
    assert set(rows // 20) == set(range(39))
    best = np.argsort(((v[:, None] - v[None]) ** 2).sum(2), axis=1)[:, 1:11]
    assert np.mean([len(got[i] & set(best[i].tolist())) / 10 for i in range(780)]) >= 0.9


def test_chat(spark):
    say = lambda c, *turns: [(c, k, r, t) for k, (r, t) in enumerate(turns)]
    a, b, c = ("user", "hi"), ("assistant", "hello"), ("user", None)
    rows = say(1, a) + say(2, a, b) + say(3, a, b, c) + say(4, a, b, c) + say(5, b) + say(6, ("user", "")) + say(7, (None, "x")) + [(8, 0, "user", "r"), (8, 0, "user", "r"), (9, 0, "user", "r"), (None, 0, "user", "n")]
    df = table(spark, rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: (r.n_turns, r.n_copies, r.rendered) for r in chat.rendered(df).collect()}
    assert set(got) == {3, 5, 6, 7, 8, None}
    assert got[3] == (3, 2, "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nhello<|im_end|>\n<|im_start|>user\n<|im_end|>\n")
    assert got[8][0] == 2
    long = table(spark, [(1, k, "user", f"t{k}") for k in range(700)] + [(2, k, "user", f"t{k}") for k in range(600)], "conv_id long, turn long, role string, text string")
    (r,) = chat.rendered(long).collect()
    assert (r.conv_id, r.n_turns) == (1, 700) and r.rendered == "".join(f"<|im_start|>user\nt{k}<|im_end|>\n" for k in range(700))
    assert chat.rendered(df.limit(0)).count() == 0


def phrases_brute(texts, width=20):
    seen, out = set(), {}
    for i in sorted(texts):
        w = words(texts[i])
        drop = set()
        for p in range(len(w) - width + 1):
            k = tuple(w[p : p + width])
            if k in seen:
                drop.update(range(p, p + width))
            seen.add(k)
        kept = b" ".join(x for p, x in enumerate(w) if p not in drop)
        out[i] = (len(w), len(drop), hashlib.sha256(kept).hexdigest())
    return out


def test_phrases(spark, docs, empty, odd):
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in phrases.without_repeats(docs).collect()}
    assert got == phrases_brute(TEXTS)
    assert phrases.without_repeats(empty).count() == 0
    rows = phrases.without_repeats(odd, with_text=True).collect()
    assert len(rows) == 6
    assert {(r.doc_id, r.n_removed) for r in rows if r.doc_id == 2} == {(2, 70)}


def test_phrases_random(spark):
    import random

    rng = random.Random(8)
    texts = {}
    for i in range(60):
        w = []
        while len(w) < rng.randint(0, 200):
            if w and rng.random() < 0.2:
                s = rng.randrange(60)
                w += [f"p{s}_{k}" for k in range(rng.randint(10, 45))]
            else:
                w.append(rng.choice("abc"))
        texts[i] = " ".join(w)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in phrases.without_repeats(table(spark, list(texts.items()))).collect()}
    assert got == phrases_brute(texts)


def suffix_brute(texts, width=50):
    first, out = {}, {}
    for i in sorted(texts):
        t = (texts[i] or "").encode()
        for p in range(len(t) - width + 1):
            first.setdefault(t[p : p + width], i)
    for i in texts:
        t = (texts[i] or "").encode()
        drop = np.zeros(len(t) + 1, int)
        for p in range(len(t) - width + 1):
            if first[t[p : p + width]] < i:
                drop[p] += 1
                drop[p + width] -= 1
        gone = np.cumsum(drop[:-1]) > 0
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out[i] = (len(t), int(gone.sum()), spans, hashlib.sha256(bytes(np.frombuffer(t, np.uint8)[~gone])).hexdigest())
    return out


def test_suffix(spark, docs, empty, odd):
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix.without_repeats(docs).collect()}
    assert got == suffix_brute(TEXTS)
    assert suffix.without_repeats(empty).count() == 0
    rows = suffix.without_repeats(odd).collect()
    assert len(rows) == 6 and {r.n_removed for r in rows if r.doc_id == 2} == {len(COPY)} and {r.n_removed for r in rows if r.doc_id != 2} == {0}


@pytest.mark.parametrize("hot", [2 << 20, 300])
def test_suffix_random(spark, monkeypatch, hot):
    """With a low limit, hot anchors are cut by longer ones and then into windows."""
    import random

    monkeypatch.setattr(suffix, "HOT", hot)

    rng = random.Random(9)
    pool = ["".join(rng.choices("abc ", k=300)) for _ in range(5)]
    texts = {}
    for i in range(40):
        t = ""
        for _ in range(rng.randint(0, 6)):
            s = rng.choice(pool)
            a = rng.randrange(250)
            t += s[a : a + rng.randint(1, 160)] + "".join(rng.choices("xyz", k=rng.randint(0, 30)))
        texts[i] = t
    texts[40], texts[41], texts[42] = "y" * 900, "x" + "y" * 700 + "x", "q" + "yz" * 300
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix.without_repeats(table(spark, list(texts.items()))).collect()}
    assert got == suffix_brute(texts)


@pytest.mark.parametrize("units, width, gram, fold", [(suffix.byte_units, 50, suffix.GRAM, False), (phrases.word_units, 20, phrases.GRAM, True)])
def test_buckets_of_anchors_are_even(units, width, gram, fold):
    """Anchors are least hashes, but no bucket takes many times the segments of another."""
    import random

    import pyarrow as pa

    rng = random.Random(4)
    texts = [" ".join("".join(rng.choices("abcdefgh", k=rng.randint(1, 9))) for _ in range(40_000)) for _ in range(2)]
    batch = pa.RecordBatch.from_arrays([pa.array([0, 1]), pa.array(texts), pa.array([0, 0])], names=["id", "text", "shard"])
    n = np.zeros(16, int)
    for sent in anchors._sent(units, width, gram, len(n), fold)([batch]):
        n[sent.column("bucket").to_numpy()] += sent.column("n").to_numpy()
    assert n.sum() > 1000 and n.max() < 1.5 * n.mean()


@pytest.mark.parametrize("few", [0, 512])
def test_suffix_array_and_plcp(monkeypatch, few):
    import random

    monkeypatch.setattr(suffix, "FEW", few)
    rng = random.Random(3)
    for _ in range(200):
        k, n = rng.choice([2, 3, 5, 250]), rng.randint(0, 200)
        x = [rng.randint(1, k) for _ in range(n)]
        x = ((x[: max(1, n // 7)] * 9)[:n] if rng.random() < 0.3 else x) + [0]
        sa = suffix.suffix_array(np.array(x), k + 1).tolist()
        assert sa == sorted(range(len(x)), key=lambda i: x[i:])
        plcp = suffix.permuted_lcp(np.array(x), np.array(sa))
        for a, b in zip(sa, sa[1:]):
            n = next(i for i in range(len(x)) if x[a + i] != x[b + i])
            assert plcp[b] == n


def test_suffix_array_recurses(monkeypatch):
    """Ordinary text of many distinct names is sorted by induction at every level, and long runs of a byte take no more
    rounds than other text."""
    import random

    rng = random.Random(6)
    x = np.array([rng.randint(1, 26) for _ in range(60_000)] + [0], dtype=np.uint16)
    alphabets, real = [], suffix.suffix_array
    monkeypatch.setattr(suffix, "suffix_array", lambda s, k: alphabets.append(k) or real(s, k))
    raw = x.astype(np.uint8).tobytes()
    sa = suffix.suffix_array(x, 27)
    assert len(alphabets) > 1 and alphabets[1] > 2048
    assert sa.tolist() == np.array(sorted(range(len(x)), key=lambda i: raw[i:])).tolist()
    runs = suffix.repeated_strings([(0, b"a" * 300_000), (1, b"a" * 300_000), (2, b"b" * 60)], 50)
    assert [int(r.sum()) for r in runs] == [0, 299_951, 0]
    monkeypatch.setattr(suffix, "_induce_names", None)
    with pytest.raises(TypeError):
        suffix.suffix_array(x, 27)


def test_packing(spark, docs, empty, odd, tok, monkeypatch):
    for part in (20_000, 3):
        monkeypatch.setattr(packing, "PART", part)
        rows = packing.pack(packing.pieces(docs)).collect()
        by, bins = {}, {}
        for r in rows:
            by.setdefault(r.doc_id, []).append(r)
            bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
        for i, t in TEXTS.items():
            data, at = ids_of(tok, t).tobytes() + struct.pack("<I", 2), 0
            for k, p in enumerate(sorted(by[i], key=lambda r: r.piece)):
                assert (p.piece, p.start, p.ids_crc32) == (k, at, zlib.crc32(data[4 * at : 4 * (at + p.length)]))
                assert k == 0 or p.length == 1024
                at += p.length
            assert at == len(data) // 4
        for b in bins.values():
            at = 0
            for o, n in sorted(b):
                assert o == at
                at += n
            assert at <= 1024
    assert packing.pack(packing.pieces(empty)).count() == 0
    assert packing.pack(packing.pieces(odd)).count() == 6


def test_packing_bounds(spark):
    assert packing.lower_bound(np.bincount([600] * 10, minlength=1025), 1024) == 10
    assert packing.lower_bound(np.bincount([512] * 10, minlength=1025), 1024) == 5
    assert packing.lower_bound(np.bincount([400, 400, 400, 700, 700], minlength=1025), 1024) == 4
    rng = np.random.default_rng(5)
    x = np.sort(rng.integers(1, 1024, 3000))[::-1]
    bins = packing.best_fit(x.tolist(), 1024)
    assert sorted(i for b in bins for i in b) == list(range(3000))
    assert len(bins) <= 1.01 * packing.lower_bound(np.bincount(x, minlength=1025), 1024)


def test_packing_certificate(spark, monkeypatch):
    """Several partitions and rounds: the certificate counts every sequence and bounds them from below."""
    monkeypatch.setattr(packing, "PART", 500)
    rows = spark.range(3000).selectExpr("id doc_id", "0 piece", "0L start", "200 + pmod(xxhash64(id), 701) length", "id ids_crc32")
    packed = packing.pack(rows)
    got = packing.certificate(packed).first()
    sizes = [r.length for r in packed.collect()]
    assert len(sizes) == 3000 and got.bound == packing.lower_bound(np.bincount(sizes, minlength=1025), 1024)
    assert got.bound <= got.sequences <= 1.02 * got.bound


def quality_brute(t):
    t = t or ""
    w = [x.decode() for x in words(t)]
    lines = [x for x in t.split("\n") if words(x)]
    g, cover = {}, set()
    for p in range(len(w) - 2):
        g.setdefault(tuple(w[p : p + 3]), []).append(p)
    for ps in g.values():
        if len(ps) > 1:
            cover.update(p + d for p in ps for d in range(3))
    return len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(cover)


@pytest.mark.parametrize("weak", ["shiftleft(3L, 60)", "shiftleft(length({}) % 3L, 60)"])
def test_quality_counts_words_not_hashes(spark, docs, monkeypatch, weak):
    """Different windows with one hash are not repeats, and equal ones between them still are."""
    monkeypatch.setattr(quality, "HASH", weak)
    few = "a b c d a b c e b c a b c f"
    more = table(spark, [(1, few), (2, "a b c d e f g"), (3, "a b c x y z a b c")])
    assert {r.doc_id: r.n_repeat_words for r in quality.ledger(more).collect()} == {1: quality_brute(few)[-1], 2: 0, 3: 6}


def test_quality(spark, docs, empty, odd):
    judged = quality.apply_policy(quality.ledger(docs)).collect()
    assert {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in judged} == {i: quality_brute(t) for i, t in TEXTS.items()}
    for r in judged:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)
    assert quality.ledger(empty).count() == 0
    assert quality.apply_policy(quality.ledger(odd)).count() == 6
    kept = quality.passing(docs, keep=["text", "tag"])
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in judged if r.kept}
    costs = {r.rule: r for r in quality.ablations(quality.ledger(docs)).collect()}
    few = costs["too_few_words"]
    assert few.n_docs == len(TEXTS) and few.n_kept == sum(r.kept for r in judged) and few.n_failed == sum(r.n_words < 50 for r in judged)


def test_quality_very_long_texts(spark):
    """Millions of distinct words: no window is taken for another; one repeat is found."""
    n = 1_500_000
    once = " ".join(map(str, range(n)))
    df = spark.createDataFrame([(1, once), (2, once + " 77 78 79")], "doc_id long, text string").repartition(2)
    got = {r.doc_id: (r.n_words, r.n_repeat_words, r.word_chars) for r in quality.ledger(df).collect()}
    chars = len(once) - n + 1
    assert got == {1: (n, 0, chars), 2: (n + 3, 6, chars + 6)}


def test_long_texts_of_one_word_and_of_no_spaces(tok):
    """A word of a million letters, tabs, and text without spaces: exact, and in bounded time and memory."""
    import time

    import public_tokenizers

    from millrace.llm.tokens import Encoder

    path = public_tokenizers.path("byte_bpe_50k.json")
    encoder, codec = Encoder(path), trie_bpe.Codec(path)
    for text in ("abcdefghij" * 100_000, "col\tumn\t\tx\n" * 40_000, "".join(chr(0x4E00 + i % 800) for i in range(200_000))):
        began = time.process_time()
        assert codec.encode([text]) == encoder.encode([text]) == [encoder._whole(text)]
        assert time.process_time() - began < 60
    held = sum(len(k) + len(v) for c in (encoder.cache, codec.cache, codec.words) for k, v in c.items())
    assert held < 1 << 20 and max(map(len, [*encoder.cache, *codec.words])) <= 128


def test_phrases_come_from_the_automata(monkeypatch):
    """Occurrences are found by the automata alone, by words, at any white space, several automata or one."""
    passage = " ".join(f"w{i}" for i in range(25)).encode()
    short = b"one two three four five six seven"
    texts = [b"x y " + passage.replace(b" ", b"\n ") + b" z", b"", b"w0 w1 w2", short + b" " + short, passage + b" " + passage]
    known = [(passage, 3), (short, 1), (passage + b" tail", 9)]
    want = [[(2, 25, 3)], [], [], [(0, 7, 1), (7, 7, 1)], [(0, 25, 3), (25, 25, 3)]]
    for letters in (1_000_000, 1):
        monkeypatch.setattr(phrases, "LETTERS", letters)
        found = phrases.occurrences(known, texts)
        assert [sorted(x[:3] for x in f) for f in found] == want
    assert phrases.removals(3, found[4]) == [(25, 25)] and phrases.removals(4, found[4]) == [(0, 25), (25, 25)] and phrases.removals(2, found[4]) == []
    monkeypatch.setattr(phrases, "automata", lambda passages: iter(()))
    assert phrases.occurrences(known, texts) == [[]] * 5


def test_phrases_across_shards(spark, monkeypatch):
    """Passages from the documents of one shard are removed in others, and only through the automata."""
    monkeypatch.setattr(phrases.shards, "ROWS_BITS", 0)
    texts = {i: " ".join(f"s{i % 4}w{k}" for k in range(60)) + f" own{i}" for i in range(12)}
    df = table(spark, list(texts.items()))
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in phrases.without_repeats(df).collect()}
    assert got == phrases_brute(texts) and sum(v[1] for v in got.values()) >= 8 * 60
    monkeypatch.setattr(phrases.shards.Companion, "frame", lambda self, spark, real=phrases.shards.Companion.frame: real(self, spark).limit(0))
    without = {r.doc_id: r.n_removed for r in phrases.without_repeats(df).collect()}
    assert sum(without.values()) < sum(v[1] for v in got.values())


def test_packing_exchanges_by_the_bound(spark, monkeypatch):
    """Partitions with differing surpluses exchange until the bound is met; if the bound were met at once, they would not."""
    monkeypatch.setattr(packing, "PART", 500)
    rows = spark.range(4000).selectExpr("id doc_id", "0 piece", "0L start", "if(id % 2 = 0, 600L, 424L) length", "id ids_crc32")
    count = lambda: packing.pack(rows).select("sequence_id").distinct().count()
    assert count() == 2000
    monkeypatch.setattr(packing, "lower_bound", lambda histogram, capacity: 10**9)
    assert count() > 2000


def test_packing_deals_equal_rows_apart(spark, monkeypatch):
    """Rows that are equal in all columns are dealt by their row numbers."""
    monkeypatch.setattr(packing, "PART", 100)
    rows = spark.range(1000).selectExpr("cast(null as bigint) doc_id", "0 piece", "0L start", "1L length", "5L ids_crc32")
    packed = packing.pack(rows)
    assert packed.count() == 1000 and packed.select("sequence_id").distinct().count() <= 10
    assert packed.select("sequence_id", "offset").distinct().count() == 1000
