"""What the optimizer makes of queries: no step is copied into filters or into all that reads it."""

import random

import pytest
from pyspark.sql import functions as F

from millrace import catalog
from millrace.functions import repetition, rules
from millrace.functions import text as T
from millrace.operators import dedup

SF = "/root/testdata/sf0.001"
SPACES = [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


def optimized(spark, name):
    return catalog.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["drop_reasons_judged", "fw_all_rules_hist", "rule_flags", "rw_rule_reasons", "rw_first_reason_hist", "fw_rule_flags", "rw_length_only"])
def test_pages_are_measured_once(spark, name):
    plan = optimized(spark, name)
    assert plan.count("_measures(") == 1 and "regexp" not in plan


@pytest.mark.parametrize("name", ["arm_noext_all", "arm_noext", "op_class_mix", "decision_flow", "coalesced_fields", "arms_nodel_noedit_norw"])
def test_programs_are_read_once(spark, name):
    """Filters on what a program gives stay above it; each copy of its steps would split the page's lines again."""
    plan = optimized(spark, name)
    assert len(plan) < 50_000 and "Filter (" not in plan[plan.index("_plain") :]


def test_second_chain_looks_for_grams_once(spark):
    plan = optimized(spark, "fw_chain")
    assert plan.count("_repetition_pairs(") == 1 and plan.count("_measures(") == 3 and "_repetition_shares(" not in plan


def test_records_are_audited_by_digest(spark):
    plan = optimized(spark, "reexecution_audit")
    assert "md5" in plan[plan.index("Join") :]


def test_few_rows_go_to_python_at_a_time(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    for name in ("annotated_lines", "fidelity_by_length_quartile", "token_prf_pooled"):
        catalog.QUERIES[name](spark, SF)
        assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 512, name
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")


@pytest.mark.parametrize("name, step", [("ngram13_dedup", "_grams("), ("ngram_diversity_cumulative", "MapInArrow")])
def test_grams_are_made_once(spark, name, step):
    assert optimized(spark, name).count(step) == 1


def test_gram_counts_in_parts(spark):
    d = spark.createDataFrame([("a", "x y X y"), ("b", None), (None, "x y"), ("a", "x y"), ("b", "z")], "source string, text string").coalesce(1)
    got = sorted((str(r.source), r.n) for r in dedup.gram_counts(d, "source", 2, together=2).collect())
    assert got == [("None", 1), ("a", 1), ("a", 3)]


def test_diversity_of_shared_grams(spark, tmp_path):
    rows = [(1, "b", "x y z"), (2, "a", "x y"), (3, "b", "X Y"), (4, "c", None), (5, None, "x y"), (6, None, "q r")]
    spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.source: (r.occurrences, r.distinct_in_source, r.cumulative_distinct) for r in catalog.QUERIES["ngram_diversity_cumulative"](spark, str(tmp_path)).collect()}
    assert {k: got[k] for k in ("a", "b")} == {"a": (1, 1, 1), "b": (3, 2, 2)} and got[None][:2] == (2, 2) and set(got) == {"a", "b", None}


def test_gram_hashes():
    words = "a b a b a c".split() + ["é" * 3]
    for n in (1, 2, 13):
        runs = [tuple(words[i : i + n]) for i in range(len(words) - n + 1)]
        found = dedup.gram_hashes(words, n).tolist()
        assert len(found) == len(runs) and len(set(found)) == len(set(runs)) == len(set(zip(found, runs)))


def test_white_space(spark):
    """Each character that is white space, and its neighbours that are none, at the ends of texts and inside."""
    near = sorted({c + k for c in SPACES for k in (-1, 0, 1)} | {0x7E, 0x7F, 0xFFFF, 0x1F600})
    rows = [(i, f"{chr(c)}a{chr(c)}{chr(c)}b{chr(c)}") for i, c in enumerate(near)]
    d = spark.createDataFrame(rows, "i int, t string").select("i", T.strip(F.col("t")).alias("s"), T.collapse(F.col("t")).alias("c"), T.words(F.col("t")).alias("w"), T.n_words(F.col("t")).alias("n"), T.has_words(F.col("t"), 2).alias("two"))
    got = {r.i: r for r in d.collect()}
    for i, t in rows:
        assert (got[i].s, got[i].c, got[i].w) == (t.strip(), " ".join(t.split()), t.split()), hex(near[i])
        assert (got[i].n, got[i].two) == (len(t.split()), len(t.split()) >= 2)


def test_line_rules_of_odd_lines(spark):
    lines = ["", "7 8", "7 8 a", "A B c", "AB CD", "12 likes", "x " * 8 + "items in cart", "x " * 7 + "items in cart", "a b " + "w" * 1001, "a b " + "w" * 1000, "a b Privacy POLICY", "a b", "1 " * 60_000 + "x", "w" * 300_000]
    d = spark.createDataFrame([(lines,)], "l array<string>")
    digits, letters = (lambda x: sum(c in "0123456789" for c in x)), (lambda x: sum(c not in " \t\n\x0b\f\r" for c in x))
    kept = [x for x in lines if sum("A" <= c <= "Z" for c in x) <= 0.5 * len(x) and digits(x) <= 0.999999 * letters(x) and x != "12 likes" and len(x.split()) >= 2]
    r = d.select(rules.modified_lines(F.col("l")).alias("m"), rules.c4_lines(F.col("l")).alias("c"), F.transform("l", rules.without_substrings).alias("s")).first()
    assert r.m == kept
    assert r.c == [x for x in lines if len(x.split()) >= 3 and max(map(len, x.split())) <= 1000 and "privacy policy" not in x.lower()]
    assert r.s[6] == lines[6] and r.s[7] == "x " * 7


def test_repetition_of_two_lengths():
    rng = random.Random(5)
    for _ in range(200):
        t = "".join(rng.choice(["a", "b", "c", " ", "\n\n"]) for _ in range(rng.randint(0, 80)))
        dense = "\n".join(x for x in t.split("\n") if x.strip())
        sizes = repetition._sizes(t.split())
        assert repetition._shares(sizes, len(t)) == repetition.shares(t) and repetition._shares(sizes, len(dense)) == repetition.shares(dense)
