import pytest

from millrace.llm import queries
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_matches_sql(spark, con, name):
    compare(queries.QUERIES[name](spark, SF), con, queries.ORACLE[name])


def test_one_query_per_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))


def test_pipeline_against_brute_force(spark):
    import corpus_pipeline as P
    from millrace.llm import store
    from tests.llm.test_edges import near_brute, phrases_brute, quality_brute

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    text = {r.doc_id: r.text for r in docs.collect()}
    (_, a), (_, b), (_, c), (_, d) = P.STAGES
    one = store.written(a(spark, docs, SF), "p1", f"{store.shared_dir(spark)}/test/p1")
    want = {}
    for i, t in text.items():
        n, chars, symbols, dup, rep = quality_brute(t)
        lines = sum(bool(x.strip()) for x in t.split("\n"))
        if not (n < 50 or 100 * rep > 50 * n or chars < 2 * n or chars > 20 * n or 2 * symbols > n or (2 * dup > lines and lines >= 4)):
            want[i] = t
    assert {r.doc_id: r.text for r in one.collect()} == want and one.columns == docs.columns
    two = store.written(b(spark, one, SF), "p2", f"{store.shared_dir(spark)}/test/p2")
    kept = {i: want[i] for i, (_, comp) in near_brute(want).items() if comp == i}
    assert {r.doc_id: r.text for r in two.collect()} == kept and two.columns == docs.columns
    three = store.written(c(spark, two, SF), "p3", f"{store.shared_dir(spark)}/test/p3")
    cut = phrases_brute(kept)
    assert {r.doc_id: len(r.text.encode().split()) for r in three.collect()} == {i: n - gone for i, (n, gone, _) in cut.items()} and three.columns == docs.columns
    cut_text = {r.doc_id: r.text for r in three.collect()}
    four = d(spark, three, SF).collect()
    assert_packed(four, cut_text)
    assert P.run(spark, SF).count() == len(four)


def assert_packed(rows, texts):
    """Every document's ids are there, piece by piece, and the sequences are gapless, at most full and about as few as can be."""
    import zlib

    import numpy as np

    from millrace.llm import packing, tokens

    encoder = tokens.Encoder(tokens.default_path())
    by, bins = {}, {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert set(by) == set(texts)
    for i, t in texts.items():
        data, at = encoder._whole(t or "") + b"\x02\0\0\0", 0
        for k, p in enumerate(sorted(by[i], key=lambda r: r.piece)):
            assert (p.piece, p.start, p.ids_crc32) == (k, at, zlib.crc32(data[4 * at : 4 * (at + p.length)]))
            at += p.length
        assert 4 * at == len(data)
    for b in bins.values():
        at = 0
        for o, n in sorted(b):
            assert o == at
            at += n
        assert at <= 1024
    bound = packing.lower_bound(np.bincount([r.length for r in rows], minlength=1025), 1024)
    assert bound <= len(bins) <= 1.01 * bound + 1


def test_pipeline_leaves_other_results_alone(spark):
    """A lazy result of an operator, taken before the pipeline ran, can still be read; stages may be chained lazily."""
    import corpus_pipeline as P

    before = queries.QUERIES["op7_phrases"](spark, SF)
    n = P.run(spark, SF).count()
    assert before.count() == spark.read.parquet(f"{SF}/documents.parquet").count()
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in P.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == n


def test_pipeline_stages_on_odd_tables(spark):
    """Nulls in any column, empty and long texts, repeated rows and ids, an empty table, more columns."""
    import corpus_pipeline as P

    prose = " ".join(f"word{i} and" for i in range(60))
    long = " ".join(f"w{i}" for i in range(60_000))
    rows = [(1, prose, "en", "a", 5, "x"), (1, prose, "en", "a", 5, "x"), (2, prose, None, None, None, "y"), (None, prose, "en", "b", 1, "z"), (3, None, "en", "b", 0, "z"), (4, "", "en", "b", 0, "z"), (5, long, "en", "b", 9, "z")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, kept string"
    table = spark.createDataFrame(rows, schema)
    got = [[tuple(r) for r in stage(spark, table, SF).collect()] for _, stage in P.STAGES]
    ids = [sorted((r[0] is None, r[0] or 0) for r in g) for g in got]
    some = lambda *x: sorted((i is None, i or 0) for i in x)
    assert ids[0] == some(1, 1, 2, None, 5)
    assert ids[1] == some(1, 1, None, 3, 4, 5)
    assert ids[2] == some(1, 1, 2, None, 3, 4, 5)
    assert {r[0]: r[1] for r in got[2]}[2] == "" and {r[0]: r[1] for r in got[2]}[5] == long
    assert set(ids[3]) == set(some(1, 2, None, 3, 4, 5)) and len({r[2] for r in got[3] if r[0] == 5}) > 100
    for _, stage in P.STAGES:
        assert stage(spark, table.limit(0), SF).count() == 0
