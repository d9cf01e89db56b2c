"""Queries that audit outputs: executions, rescues, statuses, samples and shards."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.catalog import query
from millrace.functions import text as T
from millrace.operators import metrics as M
from millrace.operators import program as P
from millrace.operators import records
from millrace.plans.metrics import SQL_PAIR, _pairs
from millrace.plans.programs import SQL_LINES, programs
from millrace.sources import corpus
from millrace.sources.tables import table


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


@query("reexecution_audit", f"""with {SQL_LINES}, a as (select doc_id, case when doc_id % 13 = 0 then '<delete>' else tag end as tag, case when doc_id % 7 = 0 then 'stale' else '  ' || replace(final, ' ', '  ') end as final, case when doc_id % 17 <> 0 then extracted end as extracted from e)
select count(*) as n, count_if(a.tag = e.tag)::bigint as tag_same, count_if(a.doc_id % 7 <> 0 or e.final = 'stale')::bigint as final_same, count_if(a.extracted is null or a.extracted = e.extracted)::bigint as extracted_same from a join e using (doc_id)""")
def reexecution_audit(spark, sf_dir):
    """Programs are run again and held against the recorded outputs, but for white space; records have planted faults."""
    e = P.execute(programs(spark, sf_dir)).select("doc_id", "tag", "final", "extracted")
    k = F.col("doc_id")
    a = e.select("doc_id", F.when(k % 13 == 0, F.lit("<delete>")).otherwise(F.col("tag")).alias("r_tag"), F.when(k % 7 == 0, F.lit("stale")).otherwise(F.concat(F.lit("  "), F.replace("final", F.lit(" "), F.lit("  ")))).alias("r_final"), F.when(k % 17 != 0, F.col("extracted")).alias("r_extracted"))
    # texts meet as digests
    digest = lambda c: F.md5(T.collapse(F.col(c))).alias(c)
    j = e.select("doc_id", "tag", digest("final"), digest("extracted")).join(a.select("doc_id", "r_tag", digest("r_final"), digest("r_extracted")), "doc_id")
    same = lambda x, y: F.col(x) == F.col(y)
    return j.agg(F.count("*").alias("n"), F.count_if(F.col("tag") == F.col("r_tag")).alias("tag_same"), F.count_if(same("final", "r_final")).alias("final_same"), F.count_if(F.col("r_extracted").isNull() | same("extracted", "r_extracted")).alias("extracted_same"))


@query("rescue_breakdown", f"""with {SQL_LINES}, j as (select e.doc_id, tag, l.quality, case when d.n_chars % 5 > 0 then (d.n_chars % 300) / 100.0 end as edu from e join labels l using (doc_id) join documents d using (doc_id))
select case when edu is null then 'missing' when edu < 0.5 then 'below 0.5' when edu < 1.0 then '0.5 to 1.0' else '1.0 and up' end as band, count(*) as rewritten, (select count(*) from j where tag = '<rewrite>')::bigint as rewrites_total from j where quality = 0 and tag = '<rewrite>' group by 1""")
def rescue_breakdown(spark, sf_dir):
    """Pages that the teacher deleted (bad labels) and the program rewrote, by score."""
    edu = F.when(F.col("n_chars") % 5 > 0, F.col("n_chars") % 300 / F.lit(100.0)).alias("edu")
    e = P.execute(programs(spark, sf_dir)).select("doc_id", "tag")
    j = e.join(table(spark, sf_dir, "labels"), "doc_id").join(_docs(spark, sf_dir).select("doc_id", edu), "doc_id").where("tag = '<rewrite>'")
    band = F.when(F.col("edu").isNull(), "missing").when(F.col("edu") < 0.5, "below 0.5").when(F.col("edu") < 1.0, "0.5 to 1.0").otherwise("1.0 and up")
    per = j.groupBy(band.alias("band")).agg(F.count_if(F.col("quality") == 0).alias("rewritten"), F.count("*").alias("_n"))
    total = per.agg(F.sum("_n")).scalar()
    return per.where("rewritten > 0").withColumn("rewrites_total", total).drop("_n")


@query("system_statuses", "with d as (select doc_id, case when doc_id % 9 = 0 then '  ' else text end as t, doc_id % 5 <> 1 as found, case when doc_id % 4 = 0 then chr(10) when doc_id % 4 = 1 then null else text end as cleaned, doc_id % 6 = 0 as failed from documents), s as (select case when trim(coalesce(t, ''), E' \\t\\r\\n') = '' then 'no_input' when not found then 'not_found' when trim(coalesce(cleaned, ''), E' \\t\\r\\n') = '' then 'deleted' else 'kept' end as status, failed from d) select status, count(*) as n, count_if(failed and status in ('kept', 'deleted'))::bigint as failed_programs from s group by 1")
def system_statuses(spark, sf_dir):
    k = F.col("doc_id")
    text, cleaned = F.when(k % 9 == 0, F.lit("  ")).otherwise(F.col("text")), F.when(k % 4 == 0, F.lit("\n")).when(k % 4 != 1, F.col("text"))
    calls = F.concat(F.lit("keep_all()"), F.when(k % 6 == 0, F.lit("\n# FAILED")).otherwise(F.lit("")))
    d = _docs(spark, sf_dir).select(records.system_status(text, k % 5 != 1, cleaned).alias("status"), F.contains(calls, F.lit("# FAILED")).alias("failed"))
    return d.groupBy("status").agg(F.count("*").alias("n"), F.count_if(F.col("failed") & F.col("status").isin("kept", "deleted")).alias("failed_programs"))


@query("verification_sample", f"""with {SQL_LINES}, s as (select doc_id, tag, md5(final) as body, case when doc_id % 3 = 0 then '<delete>' else tag end as tag2, md5(case when doc_id % 2 = 0 then final || '!' else final end) as body2 from e where doc_id % 5 = 0)
select case when tag2 = '<rewrite>' then 'rescued_to_rewrite' when tag = tag2 and body = body2 then 'match' when tag = tag2 then 'tag_ok_body_differs' else 'tagdiff_' || trim(tag2, '<>') || '_to_' || trim(tag, '<>') end as outcome, count(*) as n from s group by 1""")
def verification_sample(spark, sf_dir):
    """Every fifth target held against an earlier build of it; the stride is the sample's definition."""
    e = P.execute(programs(spark, sf_dir)).where("doc_id % 5 = 0").select("doc_id", "tag", "final")
    k = F.col("doc_id")
    e = e.withColumn("tag2", F.when(k % 3 == 0, F.lit("<delete>")).otherwise(F.col("tag"))).withColumn("final2", F.when(k % 2 == 0, F.concat("final", F.lit("!"))).otherwise(F.col("final")))
    bare = lambda c: F.regexp_replace(c, "[<>]", "")
    out = F.when(F.col("tag2") == "<rewrite>", "rescued_to_rewrite").when((F.col("tag") == F.col("tag2")) & (F.col("final") == F.col("final2")), "match").when(F.col("tag") == F.col("tag2"), "tag_ok_body_differs").otherwise(F.concat(F.lit("tagdiff_"), bare("tag2"), F.lit("_to_"), bare("tag")))
    return e.groupBy(out.alias("outcome")).agg(F.count("*").alias("n"))


@query("damaged_todo", "with s as (select source, row_number() over (order by source) - 1 as idx, count(*) as n from documents group by 1), o as (select source, n > 400 as readable from s where n > 100) select s.source as stem, s.idx, o.source is not null as damaged from s left join o using (source) where coalesce(not readable, true) and s.idx % 3 <> 1")
def damaged_todo(spark, sf_dir):
    """Shards whose output is missing or cannot be read, of one worker's share."""
    s = _docs(spark, sf_dir).groupBy("source").agg(F.count("*").alias("n"))
    outputs = s.where("n > 100").select(F.col("source").alias("stem"), (F.col("n") > 400).alias("readable"))
    return corpus.todo(s.select(F.col("source").alias("stem")), outputs).where("idx % 3 <> 1")


@query("strided_slices", "with s as (select source, row_number() over (order by source) - 1 as idx from (select distinct source from documents)) select idx % 4 as worker, count(*) as n, min(source) as first_stem from s group by 1")
def strided_slices(spark, sf_dir):
    """Each of four workers takes every fourth shard of the sorted list."""
    s = _docs(spark, sf_dir).select(F.col("source").alias("stem")).distinct()
    return corpus.strided(s, 4).groupBy("worker").agg(F.count("*").alias("n"), F.min("stem").alias("first_stem"))


@query("operation_profile", f"with {SQL_LINES} select e.tag, count(*) as n, sum(length(d.text))::bigint as chars_in, sum(length(final))::bigint as chars_out, round(sum(length(final)) / greatest(1, sum(length(d.text))), 4) as char_retention from e join documents d using (doc_id) group by 1")
def operation_profile(spark, sf_dir):
    e = P.execute(programs(spark, sf_dir)).select("doc_id", "tag", F.length("final").alias("o")).join(_docs(spark, sf_dir).select("doc_id", F.length("text").alias("i")), "doc_id")
    g = e.groupBy("tag").agg(F.count("*").alias("n"), F.sum("i").alias("chars_in"), F.sum("o").alias("chars_out"))
    return g.withColumn("char_retention", F.round(F.col("chars_out") / F.greatest(F.lit(1), "chars_in"), 4))


SQL_HELD = "h as (select d.lang as subset, case when quality = 1 then 'keep' else 'delete' end as old_tag, case when quality = 1 and toxic = 0 then 'keep' when toxic = 1 then 'delete' else 'rewrite' end as tag, (n_chars % 350) / 100.0 - 0.5 as edu from documents d join labels using (doc_id))"


def _held(spark, sf_dir):
    d = _docs(spark, sf_dir).select("doc_id", F.col("lang").alias("subset"), (F.col("n_chars") % 350 / F.lit(100.0) - 0.5).alias("edu")).join(table(spark, sf_dir, "labels"), "doc_id")
    good = F.col("quality") == 1
    return d.select("subset", F.when(good, "keep").otherwise("delete").alias("old_tag"), F.when(good & (F.col("toxic") == 0), "keep").when(F.col("toxic") == 1, "delete").otherwise("rewrite").alias("tag"), "edu")


@query("held_out_mix", f"with {SQL_HELD} select coalesce(subset, 'all') as subset, count(*) as n, count_if(tag = 'keep')::bigint as keep, count_if(tag = 'delete')::bigint as deleted, count_if(tag = 'rewrite')::bigint as rewritten, count_if(old_tag <> tag)::bigint as changed, count_if(edu < 0)::bigint as e0, count_if(edu >= 0 and edu < 0.5)::bigint as e1, count_if(edu >= 0.5 and edu < 1)::bigint as e2, count_if(edu >= 1 and edu < 1.5)::bigint as e3, count_if(edu >= 1.5 and edu < 2)::bigint as e4, count_if(edu >= 2)::bigint as e5, median(edu)::double as median_edu, avg(edu)::double as mean_edu from h group by rollup(subset)")
def held_out_mix(spark, sf_dir):
    """Labels, changes of label and scores of the held-out pages, by subset and in all."""
    h, edges = _held(spark, sf_dir), [-9.0, 0.0, 0.5, 1.0, 1.5, 2.0, 9.0]
    tag = lambda t: F.count_if(F.col("tag") == t)
    bins = [F.count_if((F.col("edu") >= a) & (F.col("edu") < b)).alias(f"e{i}") for i, (a, b) in enumerate(zip(edges, edges[1:]))]
    r = h.rollup("subset").agg(F.count("*").alias("n"), tag("keep").alias("keep"), tag("delete").alias("deleted"), tag("rewrite").alias("rewritten"), F.count_if(F.col("old_tag") != F.col("tag")).alias("changed"), *bins, F.median("edu").alias("median_edu"), F.avg("edu").alias("mean_edu"))
    return r.withColumn("subset", F.coalesce("subset", F.lit("all")))


@query("held_out_transitions", f"with {SQL_HELD} select old_tag, tag, count(*) as n from h group by 1, 2")
def held_out_transitions(spark, sf_dir):
    return _held(spark, sf_dir).groupBy("old_tag", "tag").agg(F.count("*").alias("n"))


@query("backfill_gate", "with s as (select source, count(*) as pool, count_if(text is not null and n_chars > 60) as accepted from documents group by 1) select source, pool, accepted::bigint as accepted, pool - accepted <= 5 as passed from s")
def backfill_gate(spark, sf_dir):
    s = _docs(spark, sf_dir).groupBy("source").agg(F.count("*").alias("pool"), F.count_if(F.col("text").isNotNull() & (F.col("n_chars") > 60)).alias("accepted"))
    return s.withColumn("passed", records.within_tolerance(F.col("accepted"), F.col("pool")))


@query("packed_samples", r"with w as (select doc_id, list_filter(string_split_regex(coalesce(text, ''), '\s+'), lambda x: x <> '') as w from documents), s as (select doc_id, len(w) as n, len(list_filter(w, lambda x: length(x) >= 4)) as sup, case when doc_id % 10 = 3 then 1 else 0 end as short from w) select count(*) as n, count_if(short = 1 and n > 0)::bigint as unequal, count_if(n = 0 or n > 600)::bigint as wrong_length, count_if(sup = 0)::bigint as unsupervised, sum(n)::bigint as tokens from s")
def packed_samples(spark, sf_dir):
    """Samples whose arrays differ in length, that are empty or too long, or that have no supervised token; some of the
    labels are cut short on purpose."""
    w = T.words(T.text_of("text"))
    ids = F.transform(w, lambda x: F.crc32(x))
    labels = F.transform(w, lambda x: F.when(F.length(x) >= 4, F.crc32(x)).otherwise(F.lit(-100)))
    d = _docs(spark, sf_dir).select("doc_id", ids.alias("ids"), labels.alias("full"))
    d = d.withColumn("labels", F.when((F.col("doc_id") % 10 == 3) & (F.size("full") > 0), F.slice("full", F.lit(1), F.size("full") - 1)).otherwise(F.col("full")))
    n = F.size("ids")
    return d.agg(F.count("*").alias("n"), F.count_if(n != F.size("labels")).alias("unequal"), F.count_if((n == 0) | (n > 600)).alias("wrong_length"), F.count_if(~F.exists("full", lambda x: x != -100)).alias("unsupervised"), F.sum(n).alias("tokens"))


@query("generation_rouge", f"with {SQL_PAIR}, b as (select doc_id, list_zip(t[:-2], t[2:]) as g from (select doc_id, regexp_extract_all(lower(sys), '[\\p{{L}}\\p{{N}}_]+') as t from p)), br as (select doc_id, list_zip(t[:-2], t[2:]) as g from (select doc_id, regexp_extract_all(lower(ref), '[\\p{{L}}\\p{{N}}_]+') as t from p)), bs1 as (select doc_id, unnest(g) as g from b), bs as (select doc_id, g, count(*) as n from bs1 group by 1, 2), rs1 as (select doc_id, unnest(g) as g from br), rs as (select doc_id, g, count(*) as n from rs1 group by 1, 2), bo as (select bs.doc_id, sum(least(bs.n, rs.n)) as both from bs join rs on bs.doc_id = rs.doc_id and bs.g = rs.g group by 1), k as (select o.doc_id, n_sys, n_ref, n_both, greatest(n_sys - 1, 0) as s2, greatest(n_ref - 1, 0) as r2, coalesce(bo.both, 0) as b2 from o left join bo on o.doc_id = bo.doc_id) select doc_id, case when n_sys + n_ref = 0 then 0 else 2 * n_both / (n_sys + n_ref) end::double as rouge1, case when s2 + r2 = 0 then 0 else 2 * b2 / (s2 + r2) end::double as rouge2 from k")
def generation_rouge(spark, sf_dir):
    """F1 of shared words and of shared pairs of words between a generation and its reference."""
    p = _pairs(spark, sf_dir)
    f1 = lambda o: F.when(o["n_sys"] + o["n_ref"] == 0, F.lit(0.0)).otherwise(2 * o["n_both"] / (o["n_sys"] + o["n_ref"]))
    one, two = M.shared_counts(T.tokens(T.text_of("sys")), T.tokens(T.text_of("ref")), 1), M.shared_counts(T.tokens(T.text_of("sys")), T.tokens(T.text_of("ref")), 2)
    return p.select("doc_id", one.alias("a"), two.alias("b")).select("doc_id", f1(F.col("a")).alias("rouge1"), f1(F.col("b")).alias("rouge2"))


@query("candidate_scores", r"with c as (select d.doc_id, quality, toxic, n_chars, len(list_filter(string_split_regex(text, '\s+'), lambda x: x <> '')) as words, len(list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x, E' \t\r\n')), lambda x: x <> '')) as lines, 0.9 + (n_chars % 100) / 1000.0 as faith, (n_chars % 300) / 100.0 as edu from documents d join labels using (doc_id)) select doc_id, round(60 * (faith - 0.92) + 2 * least(2.0, edu) + case when n_chars > 3000 then 1.5 else 0 end, 6)::double as score from c where faith >= 0.92 and n_chars > 150 and n_chars < 6000 and words >= 60 and lines >= 2 and words / lines >= 12 and quality = 1 and toxic = 0")
def candidate_scores(spark, sf_dir):
    """Examples of rewrites worth showing: cutoffs on faithfulness, length and shape, then a score (fixed values)."""
    d = _docs(spark, sf_dir).select("doc_id", "n_chars", F.size(T.words(T.text_of("text"))).alias("words"), F.size(T.lines_of(T.text_of("text"))).alias("lines"), (0.9 + F.col("n_chars") % 100 / F.lit(1000.0)).alias("faith"), (F.col("n_chars") % 300 / F.lit(100.0)).alias("edu"))
    j = d.join(table(spark, sf_dir, "labels"), "doc_id")
    return j.select("doc_id", M.candidate_score("faith", "edu", "n_chars").alias("score"), M.worth_showing("faith", "n_chars", "words", "lines").alias("ok"), "quality", "toxic").where("ok and quality = 1 and toxic = 0").select("doc_id", "score")


@query("template_scores", r"""with t(template, every, part) as (values ('plain', 2, 2), ('system', 1, 3), ('chat', 4, 1)), d as (select template, every, part, doc_id, coalesce(text, '') as text from documents, t),
r as (select template, doc_id % every = 0 as has, text, case part when 1 then '' when 2 then substr(text, 1, length(text) // 2) else text end as l from d),
w as (select template, has, trim(l, E' \t\r\n') <> '' as has_left, len(list_filter(string_split_regex(text, '\s+'), lambda x: x <> '')) as n, len(list_filter(string_split_regex(l, '\s+'), lambda x: x <> '')) as k from r),
g as (select template, count_if(has) / count(*) as ops, count_if(has_left) / count(*) as kept, coalesce(sum(k) filter (where has_left), 0) / greatest(1, coalesce(sum(n) filter (where has_left), 0)) as words from w group by 1)
select *, ops >= 0.5 and kept >= 0.5 and words between 0.30 and 0.999 as ok from g""")
def template_scores(spark, sf_dir):
    """Three prompt templates and what came of them: every second page gets calls and half of it stays; every page gets
    calls that change nothing; every fourth page gets calls and nothing stays."""
    rows = F.array(*[F.struct(F.lit(n).alias("template"), F.lit(e).alias("every"), F.lit(p).alias("part")) for n, e, p in (("plain", 2, 2), ("system", 1, 3), ("chat", 4, 1))])
    d = _docs(spark, sf_dir).select("doc_id", T.text_of("text").alias("text"), F.explode(rows).alias("t")).select("doc_id", "text", "t.*")
    program = F.when(F.col("doc_id") % F.col("every") == 0, F.lit("x\n remove_lines(start=0, end=1)")).otherwise(F.lit("nothing"))
    left = F.when(F.col("part") == 1, F.lit("")).when(F.col("part") == 2, F.expr("substring(text, 1, length(text) div 2)")).otherwise(F.col("text"))
    return records.template_scores(d.select("template", "text", program.alias("program"), left.alias("left")), "template", "text", "program", "left")
