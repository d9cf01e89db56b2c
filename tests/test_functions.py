"""Functions that no query calls."""

import gzip

import pytest
from pyspark.sql import functions as F

from millrace.functions import markup, rules
from millrace.functions import text as T
from millrace.operators import budgets, corpora, joins, metrics, models, program, records, training
from millrace.sources import corpus


def values(spark, column, *rows):
    """What a function of columns a, b, ... gives for each row."""
    names = "abcdef"[: len(rows[0])]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], ", ".join(["i int", *(f"{n} {kind(rows, k)}" for k, n in enumerate(names))]))
    return [r.x for r in df.select("i", column(*[F.col(n) for n in names]).alias("x")).orderBy("i").collect()]


def kind(rows, k):
    return {str: "string", float: "double", int: "bigint", bool: "boolean"}[type(next((r[k] for r in rows if r[k] is not None), ""))]


def test_rewrite_texts(spark):
    assert values(spark, T.after_marker, ("x Here is a paraphrased version:  y\nz ",), ("none",)) == ["y\nz", ""]
    assert values(spark, T.strip_rules, ("--- a ---",), ("a",)) == ["a", "a"]
    assert values(spark, markup.unescape, ("a &amp; b",), (None,)) == ["a & b", None]
    assert values(spark, markup.norm_head, ("<p>One&nbsp;<b>TWO</b></p> three",)) == ["one two three"]
    assert values(spark, lambda c: markup.norm_head(c, 5), ("<p>abcdefgh</p>",)) == ["abcde"]


def test_labels(spark):
    assert values(spark, training.tag_rule, ("a b", False, "a  b"), ("a c", False, "a b"), ("a", True, "a")) == ["<extract>", "<refine>\na c", "<delete>"]
    gate = values(spark, training.rescue_gate, (1.6, 1.0, 1.0, "fine"), (1.4, 1.0, 1.0, "fine"), (1.6, 1.7, 1.0, "fine"), (1.6, 1.0, 1.4, "fine"), (1.6, 1.0, 1.0, "The user wants it"))
    assert gate == [True, False, False, False, False]
    counts = values(spark, program.call_counts, ("remove_lines(1)\nremove_lines (2)\nkeep_all()",))[0].asDict()
    assert counts == {"keep_all": 1, "remove_all": 0, "remove_lines": 2, "replace_str": 0, "add_line": 0}


def test_budgets(spark):
    assert values(spark, budgets.stage_budget, (100,), (40900,), (40959,), (30000,)) == [356, 64, 64, 10960]
    assert values(spark, budgets.teacher_budget, (100, 50), (32704, 9), (32705, 9)) == [306, 64, None]


def test_models(spark):
    df = spark.createDataFrame([(1, "ab"), (2, None)], "i long, t string")
    assert {r.i: r.n for r in models.mapped(df, "t", "n", "long", lambda: lambda texts: [len(x) for x in texts]).collect()} == {1: 2, 2: 0}
    known = df.where("i = 1").select(F.md5("t").alias("h"))
    assert models.unscored(df.where("t is not null"), "t", known).count() == 0


def test_head_checked(spark):
    a = spark.createDataFrame([(1, "alpha beta gamma"), (2, "alpha beta gamma")], "k long, head string")
    b = spark.createDataFrame([(1, "alpha gamma"), (2, "gamma alpha")], "k long, text string")
    assert [r.k for r in joins.head_checked(a, b, ["k"]).collect()] == [1]


def test_damaged_gzip(spark, tmp_path):
    data = gzip.compress(("\n".join(f'{{"text": "{i} {"x" * 50}"}}' for i in range(50_000))).encode(), 1)
    (tmp_path / "s.jsonl.gz").write_bytes(data[: len(data) // 2])
    was = spark.conf.get("spark.sql.files.ignoreCorruptFiles")
    try:
        corpus.damaged(spark)
        assert 0 < spark.read.text(str(tmp_path / "s.jsonl.gz")).count() < 50_000
    finally:
        spark.conf.set("spark.sql.files.ignoreCorruptFiles", was)


def test_shards(spark, tmp_path):
    paths = spark.createDataFrame([(f"s3://b/x/{n}.jsonl",) for n in ("c", "a", "b", "d")], "path string")
    assert [(r.path[-7:-6], r.k) for r in corpus.shard_list(paths, "/x/", 1, 2).orderBy("k").collect()] == [("b", 1), ("c", 2)]
    for leg, counts in (("p", {"s1": 3, "s2": 2}), ("q", {"s1": 3})):
        (tmp_path / leg).mkdir()
        for stem, n in counts.items():
            spark.range(n).toPandas().to_parquet(tmp_path / leg / f"{stem}.parquet")
    got = {r.stem: (r.p, r.q) for r in corpus.row_counts(spark, p=str(tmp_path / "p"), q=str(tmp_path / "q")).collect()}
    assert got == {"s1": (3, 3), "s2": (2, None)}


def test_verified_done(spark):
    import hashlib

    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    out = spark.createDataFrame([("a", 1, "y"), ("a", 0, "x"), ("b", 0, "z")], "stem string, row long, text string")
    manifest = spark.createDataFrame([("a", sha(sha("x") + sha("y"))), ("b", sha("other"))], "stem string, sha256 string")
    assert [r.stem for r in corpus.verified_done(out, manifest).collect()] == ["a"]


def test_metadata(spark):
    got = values(spark, corpus.metadata_fields, ("{'WARC-Record-ID': '<urn:1>', 'WARC-Target-URI': 'http://a/'}",), ('{"WARC-Target-URI": "http://b/"}',))
    assert [tuple(x) for x in got] == [("<urn:1>", "http://a/"), ("", "http://b/")]


def test_stacks():
    assert rules.stack([{"func": "page_length_filter", "kwargs": {"min": 5}}, {"func": "stop_word_filter"}]) == [("page_length_filter", "m.n_words < 5 or m.n_words > 100000"), ("stop_word_filter", "m.stop_words < 2")]
    with pytest.raises(ValueError):
        rules.stack([{"func": "stop_word_filter", "kwargs": {"most": 1}}])


def test_undecided_rules_are_errors(spark):
    df = spark.createDataFrame([(1, None), (2, 5), (3, 1)], "i long, n long")
    got = {r.i: r.x for r in df.select("i", rules.reasons([("many", "n > 3"), ("odd", "n % 2 = 1")]).alias("x")).collect()}
    assert got == {1: ["many ERROR", "odd ERROR"], 2: ["many", "odd"], 3: ["odd"]}


def test_rounds(spark):
    bad = [3]
    left = lambda: spark.range(bad[0])
    assert records.healed(left, lambda b: bad.__setitem__(0, bad[0] - 1)) and bad == [0]
    bad = [9]
    assert not records.healed(left, lambda b: bad.__setitem__(0, bad[0] - 1)) and bad == [6]


def test_running_totals(spark):
    rows = [("a", i * 3, i % 5) for i in range(300)] + [("b", 7, 2)]
    df = spark.createDataFrame(rows, "k string, o long, v long").repartition(5)
    got = {(r.k, r.o): r.before for r in records.running_totals(df, "k", "o", "v", block=50).collect()}
    want, at = {}, {}
    for k, o, v in sorted(rows):
        want[k, o] = at.get(k, 0)
        at[k] = at.get(k, 0) + v
    assert got == want


def test_rouge(spark):
    import random

    rng = random.Random(1)
    for _ in range(60):
        a, b = ([rng.choice("abc") for _ in range(rng.randint(0, 12))] for _ in range(2))
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for k, y in enumerate(b):
                t[i + 1][k + 1] = t[i][k] + 1 if x == y else max(t[i][k + 1], t[i + 1][k])
        assert metrics.longest_common(a, b) == t[-1][-1]
    assert values(spark, metrics.rouge_l, ("the cat sat", "The cat ran"), ("", ""), (None, "x")) == [2 * 2 / 6, 0.0, 0.0]


def test_directory():
    d = corpora.directory("/r")
    assert len({c.read for c in d.values()}) == len(d) and d["ablation_norw"].dedup_in == "/r/operation_ablation/norw/text_clean"


def test_first_texts_in_a_stream(spark, tmp_path):
    from millrace.streaming import curation

    d = spark.createDataFrame([("a", 0), ("b", 1), ("a", 2)], "text string, s long").select("text", F.timestamp_seconds("s").alias("at"))
    d.write.parquet(str(tmp_path / "in"))
    s = curation.first_texts(spark.readStream.schema(d.schema).parquet(str(tmp_path / "in")), "at")
    q = s.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(r.text for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a", "b"]


def test_best_template(spark):
    s = spark.createDataFrame([("a", 0.6, True), ("b", 0.9, True), ("c", 1.0, False), ("aa", 0.9, True)], "t string, ops double, ok boolean")
    assert [r.t for r in records.best_template(s, "t").collect()] == ["aa"]
    assert records.best_template(s.where("not ok"), "t").count() == 0
