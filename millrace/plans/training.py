"""Queries over supervised sets and judged systems."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.catalog import query
from millrace.functions import rules as R
from millrace.functions import text as T
from millrace.operators import metrics as M
from millrace.operators import program as P
from millrace.operators import training as S
from millrace.plans.metrics import SQL_PAIR, _pairs
from millrace.plans.programs import programs
from millrace.plans.rules import SQL_FW, SQL_M, SQL_RW
from millrace.sources.tables import table


@query("staged_rows")
def staged_rows(spark, sf_dir):
    """Pages, their lines without every fourth one, and a target that drops one more: kinds, and whether executing the
    program gives the target."""
    lines = T.lines_of(T.text_of("text"))
    d = table(spark, sf_dir, "documents").select("doc_id", F.array_join(lines, "\n").alias("full"), F.filter(lines, lambda x, i: i % 4 != 0).alias("k"))
    d = d.select("doc_id", "full", F.array_join("k", "\n").alias("extracted"), F.array_join(F.slice(F.col("k"), F.lit(2), F.size("k")), "\n").alias("target"))
    r = d.withColumn("r", S.staged_row("full", "extracted", F.concat(F.lit("<refine>\n"), "target"))).where("r.program is not null")
    e = P.execute(r.select("target", F.col("r.kind").alias("kind"), F.col("full").alias("page"), S.decision_first(F.col("r.program")).alias("program")))
    same = T.collapse(F.col("final")) == T.collapse(F.col("target"))
    return e.groupBy("kind").agg(F.count("*").alias("n"), F.count_if(same).alias("n_same"))


@query("norw_gate", """with k as (select doc_id, doc_id % 5 as k, case when doc_id % 11 = 0 then 'tag' when doc_id % 13 = 0 then 'extract' when doc_id % 17 = 0 then 'rewrite' end as fault from documents)
select count(*) as n, count_if((fault = 'tag' and k not in (2, 3)) or fault = 'extract')::bigint as decision_mismatch, count_if(fault = 'extract')::bigint as no_extract, count_if(fault = 'rewrite')::bigint as rewrites from k""")
def norw_gate(spark, sf_dir):
    """The structural gate over programs without rewrites, into which faults were put: another second decision, no extract
    block, a rewrite."""
    k = F.col("doc_id")
    fault = F.when(k % 11 == 0, "tag").when(k % 13 == 0, "extract").when(k % 17 == 0, "rewrite")
    p = programs(spark, sf_dir).withColumn("program", S.fold_rewrite(F.col("program")))
    other = F.regexp_replace("program", r"(?s)\A(<[a-z]+>\n<extract>.*?\n)<(?:keep|edit|delete)>", "$1<delete>")
    bad = F.when(fault == "tag", other).when(fault == "extract", F.replace("program", F.lit("<extract>\n"))).when(fault == "rewrite", F.lit("<rewrite>\n<extract>\n<rewrite>\nx")).otherwise(F.col("program"))
    return S.gate(p.withColumn("program", bad))


@query("stage2_relabel", "with s as (select doc_id, doc_id % 5 as k, case when doc_id % 2 = 0 then (doc_id % 40) / 10.0 end as edu, case when doc_id % 3 = 0 then 'better' end as rw from documents) select case when k <> 2 then 'other' when edu is null then 'no_decision' when edu >= 1.5 then 'flip_keep' when rw is not null and edu >= 1.0 then 'flip_rewrite' else 'unchanged' end as outcome, count(*) as n from s group by 1")
def stage2_relabel(spark, sf_dir):
    d = programs(spark, sf_dir).select("doc_id", "program", F.when(F.col("doc_id") % 2 == 0, F.col("doc_id") % 40 / F.lit(10.0)).alias("edu"), F.when(F.col("doc_id") % 3 == 0, F.lit("better")).alias("rewrite"))
    return S.relabelled(d, "rescue").groupBy("outcome").agg(F.count("*").alias("n"))


@query("edu_bands", "with s as (select (doc_id % 70) / 10.0 - 1 as edu, n_chars // 6 as w from documents) select round_even(least(greatest(edu, 0), 5), 0)::int as int_edu, case when edu >= 1.5 then 'keep' when edu >= 1.0 and w >= 150 then 'candidate' else 'drop' end as action, count(*) as n from s group by 1, 2")
def edu_bands(spark, sf_dir):
    edu = F.col("doc_id") % 70 / F.lit(10.0) - 1
    d = table(spark, sf_dir, "documents").select(S.int_edu(edu).alias("int_edu"), S.rescue_action(edu, F.floor(F.col("n_chars") / 6)).alias("action"))
    return d.groupBy("int_edu", "action").agg(F.count("*").alias("n"))


@query("need_list", """with e as (select doc_id, md5(text) as h from documents where doc_id % 5 = 2), done as (select distinct md5(text) as h from documents where doc_id % 7 = 0) select doc_id from e where h not in (select h from done)""")
def need_list(spark, sf_dir):
    """Deleted documents whose texts have no rewrite yet."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("h"))
    deleted = P.read(programs(spark, sf_dir)).where("_decision = '<delete>'").select("doc_id")
    return d.join(deleted, "doc_id", "left_semi").join(d.where("doc_id % 7 = 0").select("h").distinct(), "h", "left_anti").select("doc_id")


@query("drop_reasons_judged", f"""with {SQL_M}, r as (select doc_id, {SQL_RW}[1] as reason from m) select reason, count(*) as n, count_if(l.quality = 1)::bigint as worth_keeping, count_if(l.quality = 1 and l.toxic = 0)::bigint as clean from r join labels l using (doc_id) where reason is not null group by 1""")
def drop_reasons_judged(spark, sf_dir):
    """How often a judge would have kept what each rule drops."""
    r = R.measured(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", F.get(R.reasons(R.REFINEDWEB), F.lit(0)).alias("reason"))
    j = r.join(table(spark, sf_dir, "labels"), "doc_id").groupBy("reason").agg(F.count("*").alias("n"), F.count_if(F.col("quality") == 1).alias("worth_keeping"), F.count_if((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("clean"))
    return j.where("reason is not null")


@query("rule_flags", f"""with {SQL_M}, r as (select doc_id, {SQL_RW} as rw, {SQL_FW} as fw from m)
select r.doc_id, l.quality, len(rw) = 0 as rw_kept, len(fw) = 0 as fw_kept, list_contains(rw, 'repetition') or list_contains(fw, 'gopher_rep_dup_line_frac') as repetition, list_contains(rw, 'symbol_ratio') as symbols, list_contains(fw, 'gopher_qual_gopher_short_doc') as short from r left join labels l using (doc_id)""")
def rule_flags(spark, sf_dir):
    """Both stacks and the judge, one row a page: one pass for the flags, one join for the verdict."""
    r = R.measured(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", R.reasons(R.REFINEDWEB).alias("rw"), R.reasons(R.FINEWEB).alias("fw"))
    has = F.array_contains
    f = r.select("doc_id", (F.size("rw") == 0).alias("rw_kept"), (F.size("fw") == 0).alias("fw_kept"), (has("rw", "repetition") | has("fw", "gopher_rep_dup_line_frac")).alias("repetition"), has("rw", "symbol_ratio").alias("symbols"), has("fw", "gopher_qual_gopher_short_doc").alias("short"))
    return f.join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")


@query("bootstrap_accuracy")
def bootstrap_accuracy(spark, sf_dir):
    """Percentile intervals over 1,000 resamplings of pages: share of good labels, recall of kept pages, and token recall
    of the compared system. Hashed Poisson weights stand in for drawing pages, so replicates are partial sums: a task
    adds all of its pages to an array of 1,000 sums a metric, and no row is made a thousand times."""
    pairs = table(spark, sf_dir, "documents").select("doc_id", "n_chars", F.col("text").alias("ref"), F.substring_index("text", "\n", 3).alias("sys"))
    c = M.overlap(pairs, "doc_id", "sys", "ref")
    j = table(spark, sf_dir, "labels").join(c, "doc_id").join(pairs.select("doc_id", "n_chars"), "doc_id")
    kept = (F.col("n_chars") > 1200).cast("long")
    ratios = {"good": (F.col("quality"), F.lit(1)), "recall": (F.col("quality") * kept, F.col("quality")), "tokens": (F.col("n_both"), F.col("n_ref"))}
    return M.bootstrap(j, "doc_id", ratios, 1000)


@query("operation_statistics", r"""with l as (select doc_id, doc_id % 5 as k, len(list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x, E' \t\r')), lambda x: x <> '')) as n from documents),
r as (select k, n, case k when 0 then [1] when 1 then [1, 2, 3] when 4 then [1] else [] end as rm, case when k = 1 then 1 else 0 end as subs from l)
select case k when 0 then '<keep>' when 1 then '<edit>' when 2 then '<delete>' when 3 then '<rewrite>' else '<edit>' end as decision, count(*) as n_programs, sum(len(list_filter(rm, lambda i: i <= n)))::bigint as lines_removed, sum(n)::bigint as n_lines, sum(subs)::bigint as n_subs from r group by 1""")
def operation_statistics(spark, sf_dir):
    """Lines removed and strings cut, by decision."""
    d = P.read(programs(spark, sf_dir).withColumn("n", F.size(T.lines_of(F.col("page")))))
    body = F.filter(F.transform("_rest", T.strip), lambda x: x != "")
    d = d.withColumn("_b", F.when(F.forall(body, lambda x: x.rlike(P.OP)), body).otherwise(F.array().cast("array<string>")))
    d = d.withColumn("_r", P._ranges(F.concat("_ops1", "_b")))
    gone = F.size(F.filter(F.when(F.col("n") > 0, F.sequence(F.lit(1), "n")).otherwise(F.array().cast("array<int>")), lambda i: F.exists("_r", lambda r: i.between(r.getField("a"), r.getField("b")))))
    subs = F.size(F.filter("_b", lambda x: x.startswith("sub ")))
    return d.select(F.col("_decision").alias("decision"), "n", gone.alias("g"), subs.alias("s")).groupBy("decision").agg(F.count("*").alias("n_programs"), F.sum("g").alias("lines_removed"), F.sum("n").alias("n_lines"), F.sum("s").alias("n_subs"))


@query("quality_score_parse", "select doc_id, 'science' as domain, ((doc_id % 7)::double) as overall, doc_id % 7 between 1 and 5 as valid from documents")
def quality_score_parse(spark, sf_dir):
    lines = F.concat(F.lit("science\n"), F.array_join(F.transform(F.sequence(F.lit(1), F.lit(14)), lambda i: F.concat(F.lit("score "), F.when(i == 14, (F.col("doc_id") % 7).cast("string")).otherwise(F.lit("3")))), "\n"))
    d = table(spark, sf_dir, "documents").select("doc_id", S.quality_scores(lines).alias("s"))
    return d.select("doc_id", "s.domain", F.get("s.scores", F.lit(13)).alias("overall"), "s.valid")


@query("paired_differences", f"with {SQL_PAIR}, a as (select doc_id, case when n_ref = 0 then 1.0 else n_both / n_ref end as x from o), b as (select doc_id, case when length(text) = 0 then 1.0 else least(1.0, 900 / length(text)) end as y from documents), j as (select doc_id, x - y as d from a join b using (doc_id)) select count(*) as n, avg(d)::double as mean_difference, count_if(d > 0)::bigint as wins, count_if(d = 0)::bigint as ties, (stddev_samp(d) / sqrt(count(*)))::double as standard_error from j")
def paired_differences(spark, sf_dir):
    """Token recall of two systems, page by page: without the first line, and the first 900 characters' share."""
    o = M.overlap(_pairs(spark, sf_dir), "doc_id", "sys", "ref")
    x = o.select("doc_id", F.when(F.col("n_ref") == 0, F.lit(1.0)).otherwise(F.col("n_both") / F.col("n_ref")).alias("x"))
    n = F.length("text")
    y = table(spark, sf_dir, "documents").select("doc_id", F.when(n == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), 900 / n)).alias("y"))
    d = x.join(y, "doc_id").select((F.col("x") - F.col("y")).alias("d"))
    return d.agg(F.count("*").alias("n"), F.avg("d").alias("mean_difference"), F.count_if(F.col("d") > 0).alias("wins"), F.count_if(F.col("d") == 0).alias("ties"), (F.stddev_samp("d") / F.sqrt(F.count("*"))).alias("standard_error"))
