import json
import random

from pyspark.sql import functions as F

from millrace.operators import diffs, program as P


def run(spark, rows):
    df = spark.createDataFrame(rows, "page string, program string")
    return [(r.tag, r.final, r.op_class, r.parse_fail) for r in P.execute(df.withColumn("k", F.monotonically_increasing_id())).orderBy("k").collect()]


PAGE = "<lid:1> Home Login\n<lid:2> The red red fox.\n<lid:3> It costs 5 dollars."


def test_executor_cases(spark):
    keep = "<keep>\n<extract>\n{}\n<keep>"
    cases = [
        (keep.format("rm 1"), "The red red fox.\nIt costs 5 dollars."),
        (keep.format("rm 2-9"), "Home Login"),
        (keep.format("rm 3-1"), "Home Login\nThe red red fox.\nIt costs 5 dollars."),
        (keep.format("rm 0"), "Home Login\nThe red red fox.\nIt costs 5 dollars."),
        (keep.format('sub 2: " red"\nsub 2: " red"'), "Home Login\nThe fox.\nIt costs 5 dollars."),
        (keep.format('rm 2\nsub 2: "fox"'), "Home Login\nIt costs 5 dollars."),
        (keep.format('sub 2: "\\u0054he "'), "Home Login\nred red fox.\nIt costs 5 dollars."),
        (keep.format("sub 3: costs"), "Home Login\nThe red red fox.\nIt 5 dollars."),
        (keep.format('sub 1: "Home Login"'), "The red red fox.\nIt costs 5 dollars."),
    ]
    assert [r[1] for r in run(spark, [(PAGE, p) for p, _ in cases])] == [w for _, w in cases]


def test_number_literal_fails_to_parse(spark):
    assert run(spark, [(PAGE, "<keep>\n<extract>\nsub 2: 12\n<keep>")])[0][3]


def test_reader_cases(spark):
    got = run(
        spark,
        [
            (PAGE, "<edit>\n<extract>\nrm 1\nnew text only"),
            (PAGE, "noise"),
            (PAGE, "<keep>"),
            (PAGE, ""),
            (PAGE, "<edit>\n<extract>\n<edit>\nrm 1\nprose"),
            (PAGE, "<rewrite>\n<extract>\n<rewrite>"),
            (PAGE, "<keep>\n<extract>\nrm 1\n<keep>\ntrailing junk"),
            (PAGE, "<extract>\nrm 1\n<keep>"),
            (PAGE, "<delete>"),
        ],
    )
    assert got[0][:3] == ("<refine>", "new text only", "edit: full-text fallback")
    assert got[1][:3] == ("noise", "", "omitted")
    assert got[2][1] == "Home Login\nThe red red fox.\nIt costs 5 dollars."
    assert got[4][1] == "rm 1\nprose"
    assert got[5][:2] == ("<rewrite>", "")
    assert got[6][1] == got[7][1] == "The red red fox.\nIt costs 5 dollars."
    assert got[7][2] == "omitted"
    assert got[8][:2] == ("<delete>", "")


def test_postfilter_edges(spark):
    rows = [("rm 1\nx", "<extract>"), ("rm 1\nrm 2", "<extract>"), ("<keep>" + "x" * 193, "<extract>"), ("<keep>" + "x" * 194, "<extract>"), ("a\n <edit> \nb", "<rewrite>"), ("fine", None)]
    df = spark.createDataFrame(rows, "t string, tag string").withColumn("k", F.monotonically_increasing_id())
    assert [r.b for r in df.select("k", P.postfilter(F.col("t"), F.col("tag")).alias("b")).orderBy("k").collect()] == [[], ["A2"], ["A2"], [], ["A5"], ["A3"]]


def test_programs_round_trip(spark):
    rng = random.Random(5)
    rows = []
    for _ in range(60):
        src = [f"line {i} {rng.choice('abc')} [share] end {i}" for i in range(rng.randint(1, 12))]
        dst = [x.replace("[share] ", "") if rng.random() < 0.3 else x for x in src if rng.random() < 0.7]
        rows.append(("\n".join(src), "\n".join(dst)))
    exact = [(a, diffs.make_program(a, b), b) for a, b in rows]
    exact = [x for x in exact if x[1] is not None]
    assert len(exact) > 30
    got = run(spark, [(a, f"<keep>\n<extract>\n{p}\n<keep>") for a, p, _ in exact])
    assert [" ".join(g[1].split()) for g in got] == [" ".join(b.split()) for *_, b in exact]


def test_make_program_cases():
    assert diffs.make_program("a\nb", "a\nb") == ""
    assert diffs.make_program("a\nb", "a") == "rm 2"
    assert diffs.make_program("x y z", "x z") == "sub 1: " + json.dumps("y ")
    assert diffs.make_program("xy", "x y") is None
    assert diffs.make_program("x  y", "x y") is None
    assert diffs.make_program("a", "a\nb") is None


def test_other_formats(spark):
    rows = [
        ("<clean>\n<extract>\nrm 1\n<keep>", P.without_clean_head, "<extract>\nrm 1\n<keep>"),
        ("<extract>\nrm 1\n<text>\nThe page.\nMore\n<edit>\nrm 2", P.without_echo, "<extract>\nrm 1\n<edit>\nrm 2"),
        ("<extract>\n<text>\nonly echo", P.without_echo, "<extract>"),
        ("<extract>\nrm 1\n<keep>", P.without_echo, "<extract>\nrm 1\n<keep>"),
        (" <Refine>\nbody ", P.untagged, "body"),
        ("<delete>\nbody", P.untagged, ""),
        ("plain", P.untagged, "plain"),
        ("remove_lines(1)\nreplace_str('a')", P.call_class, "edit: lines + strings"),
        ("keep_all()", P.call_class, "keep"),
        ("remove_all ()", P.call_class, "delete"),
        ("x", P.call_class, "other"),
    ]
    for value, f, want in rows:
        assert spark.createDataFrame([(value,)], "t string").select(f(F.col("t")).alias("x")).first().x == want
    staged = spark.createDataFrame([(PAGE, "<extract>\nrm 1\n<keep>")], "page string, program string")
    assert P.execute(staged, decision_first=False).first().final == "The red red fox.\nIt costs 5 dollars."


def test_repetition_checks():
    from millrace.functions.repetition import fired

    assert "gopher_rep_top_2_gram" in fired("buy now " * 30 + "and some other words here")
    assert "gopher_rep_duplicated_5_n_grams" in fired(" ".join(f"w{i}" for i in range(30)) + " " + " ".join(f"w{i}" for i in range(30)))
    assert fired("") == [] and fired("all words here are quite different from one another") == []


def test_without_extract_block(spark):
    page = "<lid:1> a\n<lid:2> b\n<lid:3> the c\n<lid:4> d"
    edit = '<edit>\n<extract>\nrm 2\nsub 4: "d"\n<edit>\nrm 1\nsub 3: "the "'
    rows = [(0, "<keep>\n<extract>\nrm 1\n<keep>"), (1, edit), (2, "<delete>\n<extract>\n<delete>"), (3, "<rewrite>\n<extract>\nrm 1\n<rewrite>\nnew"), (4, "<edit>\n<extract>\nrm 1\n<edit>\nnew\nrm 9"), (5, "<keep>\n<extract>\nsub 2: 12\n<keep>")]
    df = spark.createDataFrame([(i, page, p) for i, p in rows], "k int, page string, program string")
    got = [(r.tag, r.final, r.parse_fail) for r in P.execute(df, drop_extract=True).orderBy("k").collect()]
    whole = "a\nb\nthe c\nd"
    assert got == [("<extract>", whole, False), ("<refine>", "b\nc\nd", False), ("<delete>", "", False), ("<rewrite>", "new", False), ("<refine>", "new\nrm 9", False), ("<extract>", whole, True)]
    assert P.execute(df.where("k = 1"), drop_extract=False).first().final == "c"
