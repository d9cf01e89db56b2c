from pyspark.sql import functions as F

from millrace.functions import markup, text as T
from millrace.operators import dedup, fitting, joins, metrics, prox
from millrace.sources import corpus


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "t string").select(column(F.col("t")).alias("x")).first().x


def test_numbering(spark):
    assert one(spark, "a\r\n\n  b \n c", T.number_lines) == "<lid:1> a\n<lid:2> b\n<lid:3> c"


def test_render():
    html = "<html><head><title>t</title></head><body><nav><a>Home</a></nav><p>One&nbsp;<b>two</b></p><script>var a='</p>'</script><div class='x y'>three<br>four</div></body>"
    lines = markup.read_lines(html)
    assert [t for *_, t in lines] == ["Home", "One two", "three", "four"]
    assert lines[0][1] and not lines[1][1] and lines[2][0] == "div.x.y"


def test_prox():
    assert prox.run_program("a\nb\nc", "remove_lines(start=0, end=1)") == ("c", 0)
    assert prox.run_program("a b, c", 'normalize(source="b, ", target="")') == ("a c", 0)
    assert prox.run_program("a", "remove_lines(start=0") == ("a", 1)
    assert prox.accept("w " * 30, "w " * 10, 0) == ""
    assert prox.accept("w " * 30, "w " * 20, 2) == "w " * 30
    assert prox.accept("", "", 0) is None
    assert prox.merged([(3, 4), (0, 1), (2, 2)]) == [(0, 4)]


def test_best_fit():
    bins = fitting.best_fit([6, 5, 4, 5], 10)
    assert bins[0] == bins[2] and bins[1] == bins[3] and len(set(bins)) == 2
    assert fitting.best_fit([], 10) == []


def test_prf_conventions(spark):
    df = spark.createDataFrame([(1, "", "a b"), (2, "a b", ""), (3, "", ""), (4, "a b", "a b"), (5, "a", "b")], "k long, s string, r string")
    o = metrics.overlap(df, "k", "s", "r")
    p, r, f = metrics.prf(F.col("n_sys"), F.col("n_ref"), F.col("n_both"))
    assert [tuple(x) for x in o.select("k", p, r, f).orderBy("k").collect()] == [(1, 1.0, 0.0, 0.0), (2, 0.0, 1.0, 0.0), (3, 1.0, 1.0, 1.0), (4, 1.0, 1.0, 1.0), (5, 0.0, 0.0, 0.0)]


def test_alignment_gap(spark):
    a = spark.createDataFrame([("s", i, f"alpha{i} beta{i} gamma") for i in range(12)], "shard string, row long, head string")
    b = spark.createDataFrame([("s", 0, "alpha3 beta3"), ("s", 1, "alpha8 beta8"), ("s", 2, "alpha5 gamma"), ("s", 3, "of a")], "shard string, row long, text string")
    assert sorted(tuple(r) for r in joins.aligned(a, b, "shard", "row").collect()) == [("s", 0, 3), ("s", 2, 5)]


def test_ngram_dedup_short_and_order(spark):
    p = " ".join(f"w{i}" for i in range(20))
    df = spark.createDataFrame([(1, p), (2, p), (3, "too short"), (4, None), (5, p + "\n" + p)], "doc_id long, text string")
    got = {r.doc_id: (r.n_paragraphs, r.n_dropped, r.doc_dropped) for r in dedup.ngram_dedup(df).collect()}
    assert got == {1: (1, 0, False), 2: (1, 1, True), 3: (1, 0, False), 4: (1, 0, False), 5: (2, 2, True)}


def test_jsonl_round_trip(spark, tmp_path):
    from pyspark.sql.types import StringType, StructField, StructType

    p = tmp_path / "s1.jsonl"
    p.write_text('{"text": "a"}\n\nnot json\n{"text": "b"}\n')
    schema = StructType([StructField("text", StringType())])
    df = corpus.jsonl(spark, str(p), schema).cache()
    assert tuple(corpus.bad_lines(df).first()) == (1, 3)
    out = str(tmp_path / "out")
    corpus.write_jsonl(df.where("text is not null").select("text", F.lit("s1").alias("stem")), out, "stem")
    back = spark.read.json(out)
    assert sorted(r.text for r in back.collect()) == ["a", "b"]
    assert corpus.resumable(back, back).count() == 0
    stems = corpus.with_shard(corpus.jsonl(spark, str(p), schema)).select("stem").distinct().collect()
    assert stems[0].stem == "s1"


def test_logs(spark, tmp_path):
    (tmp_path / "log").write_text("x\nrank 3 s1: pages 10 kept 7 {'a': 1}\n")
    r = corpus.rank_log(spark, str(tmp_path / "log")).first()
    assert (r["rank"], r.stem, r.pages, r.kept, r.counters) == (3, "s1", 10, 7, {"a": 1})
    (tmp_path / "acct").write_text("JobID|ElapsedRaw|AllocTRES\n1|7200|cpu=4,gres/gpu=8\n2|60|cpu=1\n")
    assert [x.gpu_hours for x in corpus.accounting(spark, str(tmp_path / "acct")).orderBy("JobID").collect()] == [16.0, 0.0]


def test_stream(spark, tmp_path):
    from millrace.streaming import curation

    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    d.write.parquet(str(tmp_path / "in"))
    s = curation.curated(curation.shards(spark, str(tmp_path / "in"), d.schema))
    q = s.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == curation.curated(d).count() > 0
