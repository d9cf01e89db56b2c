"""Queries that put evaluation inputs and figures together."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.catalog import query
from millrace.functions import text as T
from millrace.operators import corpora
from millrace.operators import program as P
from millrace.operators import records
from millrace.operators.budgets import stage_budget, teacher_budget
from millrace.plans.programs import SQL_LINES, programs
from millrace.sources.tables import table


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


@query("judge_input", f"""with {SQL_LINES}, s as (select d.doc_id, unnest([{{'system': 'page', 't': d.text}}, {{'system': 'program', 't': e.final}}, {{'system': 'lead', 't': case when d.doc_id % 4 = 0 then 'None' else split_part(d.text, chr(10), 1) end}}]) as x from documents d join e using (doc_id))
select doc_id, x.system as system, md5(x.t) as text_md5 from s where x.t is not null and x.t <> 'None' and trim(x.t, E' \\t\\r\\n') <> ''""")
def judge_input(spark, sf_dir):
    """Every system's outputs in long form, without empty ones."""
    d = _docs(spark, sf_dir).select("doc_id", "text", F.when(F.col("doc_id") % 4 == 0, F.lit("None")).otherwise(F.substring_index("text", "\n", 1)).alias("lead"))
    j = d.join(P.execute(programs(spark, sf_dir)).select("doc_id", "final"), "doc_id")
    return records.long_format(j, "doc_id", {"page": "text", "program": "final", "lead": "lead"}).select("doc_id", "system", F.md5("text").alias("text_md5"))


@query("coalesced_fields", f"""with {SQL_LINES}, r as (select doc_id, source, case when doc_id % 3 = 0 then 'given ' || doc_id end as final, case when doc_id % 3 = 1 then upper(source) end as final_text, case when doc_id % 4 = 0 then 'keep' end as decision, case when doc_id % 11 = 0 then 'failed' end as status from documents)
select doc_id, case when status is not null then '' else md5(coalesce(r.final, final_text, e.final)) end as final_md5, case when status is not null then 'status' when r.final is not null then 'final' when final_text is not null then 'final_text' else 'program' end as final_from,
  case when status is not null then 'omitted' else coalesce(decision, case tag when '<extract>' then 'keep' when '<refine>' then 'edit' when '<delete>' then 'delete' else 'rewrite' end) end as decision, case when status is null then md5(extracted) end as extracted_md5 from r join e using (doc_id)""")
def coalesced_fields(spark, sf_dir):
    """Records whose fields have several names: the first present one counts, what is missing comes from the program, and
    a page without a program is omitted."""
    k = F.col("doc_id")
    r = programs(spark, sf_dir).select("*", F.when(k % 3 == 0, F.concat(F.lit("given "), k.cast("string"))).alias("final_given"), F.when(k % 3 == 1, F.upper("source")).alias("final_text"), F.when(k % 4 == 0, F.lit("keep")).alias("decision_given"), F.when(k % 11 == 0, F.lit("failed")).alias("status"))
    e = P.execute(r)
    named = e.withColumnsRenamed({"final": "by_program"}).withColumnRenamed("final_given", "final")
    value, name = records.first_present(named, ["final", "final_text", "pfinal"])
    word = F.element_at(F.create_map(*[F.lit(x) for pair in (("<extract>", "keep"), ("<refine>", "edit"), ("<delete>", "delete"), ("<rewrite>", "rewrite")) for x in pair]), F.col("tag"))
    lost = F.col("status").isNotNull()
    return named.select(
        "doc_id",
        F.when(lost, F.lit("")).otherwise(F.md5(F.coalesce(value, "by_program"))).alias("final_md5"),
        F.when(lost, F.lit("status")).otherwise(F.coalesce(name, F.lit("program"))).alias("final_from"),
        F.when(lost, F.lit("omitted")).otherwise(F.coalesce("decision_given", word)).alias("decision"),
        F.when(~lost, F.md5("extracted")).alias("extracted_md5"),
    )


@query("figure_series", "with c as (select source, lang, count(*) as n, sum(n_chars)::bigint as chars from documents group by 1, 2), a as (select distinct lang from c), s as (select x.source, a.lang, coalesce(c.n, 0) as n, coalesce(c.chars, 0) as chars from (select distinct source from c) x cross join a left join c on c.source = x.source and c.lang = a.lang) select source, string_agg(lang || ':' || n || ':' || chars, ' ' order by lang) as series, string_agg(lang, ',' order by lang) = (select string_agg(lang, ',' order by lang) from a) as same_order, count(*) as n_points from s group by source")
def figure_series(spark, sf_dir):
    """One series a corpus, with all points in one order; a point that a corpus lacks is zero, and the order is checked."""
    d = _docs(spark, sf_dir)
    langs = [r.lang for r in d.select("lang").distinct().where("lang is not null").orderBy("lang").collect()]
    c = d.groupBy("source").pivot("lang", langs).agg(F.count("doc_id").alias("n"), F.sum("n_chars").alias("chars"))
    zero = lambda x: F.coalesce(F.col(f"`{x}`"), F.lit(0))
    points = F.array(*[F.struct(F.lit(x).alias("lang"), zero(f"{x}_n").alias("n"), zero(f"{x}_chars").alias("chars")) for x in langs])
    s = c.select("source", points.alias("p"))
    text = F.array_join(F.transform("p", lambda p: F.concat_ws(":", p.lang, p.n.cast("string"), p.chars.cast("string"))), " ")
    return s.select("source", text.alias("series"), (F.col("p.lang") == F.array(*[F.lit(x) for x in langs])).alias("same_order"), F.size("p").cast("long").alias("n_points"))


@query("extraction_quality", "with a as (select lang, count(*) as n, avg(n_chars)::double as mean_chars from documents group by 1), b as (select d.lang, count(*) as judged, avg(quality)::double as mean_quality from documents d join labels using (doc_id) group by 1) select lang, n, mean_chars, judged, mean_quality from a full join b using (lang)")
def extraction_quality(spark, sf_dir):
    """Two blocks of figures as one table."""
    d = _docs(spark, sf_dir).select("doc_id", "lang", "n_chars")
    a = d.groupBy("lang").agg(F.count("*").alias("n"), F.avg("n_chars").alias("mean_chars"))
    b = d.join(table(spark, sf_dir, "labels"), "doc_id").groupBy("lang").agg(F.count("*").alias("judged"), F.avg("quality").alias("mean_quality"))
    return a.join(b, "lang", "full")


@query("token_budgets", "with p as (select doc_id, n_chars // 4 + 300 as prompt, n_chars // 4 as t from documents) select doc_id, greatest(64, least(40960 - prompt, prompt + 256)) as stage, case when prompt + 64 <= 4000 then least(4000 - prompt, t + 256) end as teacher from p")
def token_budgets(spark, sf_dir):
    p, t = F.floor(F.col("n_chars") / 4) + 300, F.floor(F.col("n_chars") / 4)
    return _docs(spark, sf_dir).select("doc_id", stage_budget(p).alias("stage"), teacher_budget(p, t, 4000).alias("teacher"))


@query("corpus_directory", "select * from (values ('curated', 'curated_norule', '/c/curated', '/c/curated/text_clean'), ('two_stage', 'two_stage_norule', '/c/two_stage', '/c/two_stage/best'), " + ", ".join(f"('ablation_{a}', 'ablation_{a}_norule', '/c/operation_ablation/{a}', '/c/operation_ablation/{a}/text_clean')" for a in ("full", "nodel", "noedit", "noext", "norwdel", "norw")) + ", ('chunk_programs', 'chunk_programs_norule', '/c/chunk_programs', '/c/chunk_programs/text'), ('line_programs', 'line_programs_norule', '/c/line_programs', '/c/line_programs/text'), ('first_rules', 'first_rules', '/c/rules/first', '/c/rules/first/kept'), ('second_rules', 'second_rules', '/c/rules/second', '/c/rules/second/kept')) v(name, read, folder, dedup_in)")
def corpus_directory(spark, sf_dir):
    return corpora.frame(spark, "/c")


SQL_SEQ = "t as (select source, doc_id, len(list_filter(string_split_regex(coalesce(text, ''), '\\s+'), lambda x: x <> '')) + 1 as n from documents), b as (select *, sum(n) over (partition by source order by doc_id) - n as before from t)"


@query("sequence_cutting", f"with {SQL_SEQ} select doc_id, before::bigint as start, (before // 2049)::bigint as first_sequence, ((before + n - 1) // 2049)::bigint as last_sequence from b")
def sequence_cutting(spark, sf_dir):
    """Documents of a shard end to end, cut into sequences of 2,049 tokens; the tokenizer is a plug-in, here words and an
    end mark."""
    d = _docs(spark, sf_dir).select("source", "doc_id", (F.size(T.words(T.text_of("text"))) + 1).alias("n"))
    r = records.running_totals(d, "source", "doc_id", "n")
    cut = lambda c: F.floor(c / 2049).cast("long")
    return r.select("doc_id", F.col("before").alias("start"), cut(F.col("before")).alias("first_sequence"), cut(F.col("before") + F.col("n") - 1).alias("last_sequence"))


@query("manifest_merge", f"with {SQL_SEQ}, s as (select source, sum(n) // 2049 as q from b group by 1) select 'p' || (length(source) % 3) || '_' || source as shard, q::bigint as num_sequences, (q * 2049)::bigint as num_tokens, (select sum(q) from s)::bigint as total_sequences from s")
def manifest_merge(spark, sf_dir):
    """The manifests of parts that were tokenized in parallel as one, with whole sequences only, and its total."""
    d = _docs(spark, sf_dir).select("source", (F.size(T.words(T.text_of("text"))) + 1).alias("n"))
    s = d.groupBy("source").agg(F.floor(F.sum("n") / 2049).cast("long").alias("num_sequences"))
    m = records.merged_manifests(s.select((F.length("source") % 3).alias("part"), F.col("source").alias("shard"), "num_sequences"))
    total = m.agg(F.sum("num_sequences")).scalar()
    return m.withColumn("num_tokens", F.col("num_sequences") * 2049).withColumn("total_sequences", total)
