"""Queries over evaluation metrics and statistics."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.catalog import query
from millrace.operators import metrics as M
from millrace.sources.tables import table

#: The compared system: documents without their first line.
SQL_PAIR = r"""p as (select doc_id, source, text as ref, case when strpos(text, chr(10)) > 0 then text[strpos(text, chr(10)) + 1:] else '' end as sys from documents),
s as (select doc_id, unnest(regexp_extract_all(lower(sys), '[\p{L}\p{N}_]+')) as tok from p), r as (select doc_id, unnest(regexp_extract_all(lower(ref), '[\p{L}\p{N}_]+')) as tok from p),
sc as (select doc_id, tok, count(*) as n from s group by 1, 2), rc as (select doc_id, tok, count(*) as n from r group by 1, 2),
o as (select p.doc_id, p.source, coalesce((select sum(n) from sc where sc.doc_id = p.doc_id), 0)::bigint as n_sys, coalesce((select sum(n) from rc where rc.doc_id = p.doc_id), 0)::bigint as n_ref,
  coalesce((select sum(least(sc.n, rc.n)) from sc join rc on sc.doc_id = rc.doc_id and sc.tok = rc.tok where sc.doc_id = p.doc_id), 0)::bigint as n_both from p)"""


def _pairs(spark, sf_dir):
    at = F.instr("text", "\n")
    return table(spark, sf_dir, "documents").select("doc_id", "source", F.col("text").alias("ref"), F.when(at > 0, F.expr("substring(text, instr(text, '\\n') + 1)")).otherwise(F.lit("")).alias("sys"))


@query("token_prf_pooled", f"with {SQL_PAIR} select sum(n_both)::double / sum(n_sys) as precision, sum(n_both)::double / sum(n_ref) as recall, 2 * sum(n_both)::double / (sum(n_sys) + sum(n_ref)) as f1 from o")
def token_prf_pooled(spark, sf_dir):
    o = M.overlap(_pairs(spark, sf_dir), "doc_id", "sys", "ref").agg(F.sum("n_sys").alias("s"), F.sum("n_ref").alias("r"), F.sum("n_both").alias("b"))
    return o.select((F.col("b") / F.col("s")).alias("precision"), (F.col("b") / F.col("r")).alias("recall"), (2 * F.col("b") / (F.col("s") + F.col("r"))).alias("f1"))


@query("token_prf_by_page", f"with {SQL_PAIR}, q as (select doc_id, case when n_sys = 0 then 1.0::double else n_both / n_sys end as precision, case when n_ref = 0 then 1.0::double else n_both / n_ref end as recall from o) select doc_id, precision, recall, case when precision + recall = 0 then 0.0::double else 2 * precision * recall / (precision + recall) end as f1 from q")
def token_prf_by_page(spark, sf_dir):
    o = M.overlap(_pairs(spark, sf_dir), "doc_id", "sys", "ref")
    p, r, f1 = M.prf(F.col("n_sys"), F.col("n_ref"), F.col("n_both"))
    return o.select("doc_id", p.alias("precision"), r.alias("recall"), f1.alias("f1"))


@query("fidelity_by_length_quartile", f"with {SQL_PAIR}, k as (select *, row_number() over (order by n_ref, doc_id) as rn, count(*) over () as n from o) select (4 * (rn - 1) + 3)::bigint // n as quartile, count(*) as n_pages, min(n_ref) as shortest, max(n_ref) as longest, sum(n_both)::double / sum(n_ref) as recall from k group by 1")
def fidelity_by_length_quartile(spark, sf_dir):
    """Equal-count quartiles by length. The global rank is a rank inside length groups plus a running count over the
    distinct lengths, so no task ever sorts all pages."""
    o = M.overlap(_pairs(spark, sf_dir), "doc_id", "sys", "ref")
    n = o.agg(F.count("*")).scalar()
    lengths = o.groupBy("n_ref").agg(F.count("*").alias("c"))
    before = F.coalesce(F.sum("c").over(Window.orderBy("n_ref").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rank = o.withColumn("k", F.row_number().over(Window.partitionBy("n_ref").orderBy("doc_id"))).join(lengths.select("n_ref", before.alias("b")), "n_ref")
    q = rank.withColumn("n", n).withColumn("quartile", F.floor((4 * (F.col("b") + F.col("k") - 1) + 3) / F.col("n")))
    return q.groupBy("quartile").agg(F.count("*").alias("n_pages"), F.min("n_ref").alias("shortest"), F.max("n_ref").alias("longest"), (F.sum("n_both") / F.sum("n_ref")).alias("recall"))


@query("confusion_matrix", "with a(x) as (values (0), (1)), g as (select a.x as quality, b.x as toxic from a, a b) select g.quality::bigint as quality, g.toxic::bigint as toxic, count(l.doc_id) as n from g left join labels l on l.quality = g.quality and l.toxic = g.toxic group by 1, 2")
def confusion_matrix(spark, sf_dir):
    """All cells, empty ones too: one aggregate with a conditional count a cell."""
    cells = [(q, t) for q in (0, 1) for t in (0, 1)]
    one = table(spark, sf_dir, "labels").agg(*[F.count_if((F.col("quality") == q) & (F.col("toxic") == t)).alias(f"c{q}{t}") for q, t in cells])
    rows = F.array(*[F.struct(F.lit(q).cast("long").alias("quality"), F.lit(t).cast("long").alias("toxic"), F.col(f"c{q}{t}").alias("n")) for q, t in cells])
    return one.select(F.inline(rows))


@query("keepdrop_accuracy", "with j as (select d.doc_id, d.lang, l.quality = 1 as worthy, d.n_chars > 1200 as kept from documents d join labels l using (doc_id)) select lang, count(*) as n, count_if(kept and worthy)::bigint as tp, count_if(kept and not worthy)::bigint as fp, count_if(not kept and worthy)::bigint as fn, count_if(not kept and not worthy)::bigint as tn, (count_if(kept and worthy)::double / greatest(1, count_if(worthy)) + count_if(not kept and not worthy)::double / greatest(1, count_if(not worthy))) / 2 as keepdrop from j group by rollup(lang)")
def keepdrop_accuracy(spark, sf_dir):
    """Kept pages against judged ones, by language and in all."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", (F.col("n_chars") > 1200).alias("kept"))
    j = d.join(table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 1).alias("w")), "doc_id")
    k, w = F.col("kept"), F.col("w")
    g = j.rollup("lang").agg(F.count("*").alias("n"), F.count_if(k & w).alias("tp"), F.count_if(k & ~w).alias("fp"), F.count_if(~k & w).alias("fn"), F.count_if(~k & ~w).alias("tn"))
    return g.withColumn("keepdrop", (F.col("tp") / F.greatest(F.lit(1), F.col("tp") + F.col("fn")) + F.col("tn") / F.greatest(F.lit(1), F.col("tn") + F.col("fp"))) / 2)


@query("quality_buckets", "select case when n_chars < 500 then 'short' when n_chars < 2000 then 'middle' else 'long' end as bucket, count(*) as n, avg(quality)::double as mean_quality, count(quality) as n_judged from documents left join labels using (doc_id) group by 1")
def quality_buckets(spark, sf_dir):
    j = table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    b = F.when(F.col("n_chars") < 500, "short").when(F.col("n_chars") < 2000, "middle").otherwise("long")
    return j.groupBy(b.alias("bucket")).agg(F.count("*").alias("n"), F.avg("quality").alias("mean_quality"), F.count("quality").alias("n_judged"))


@query("score_summary", "select source, avg(quality)::double as mean_quality, count_if(quality >= 1)::bigint as n_good, count_if(toxic >= 1)::bigint as n_toxic from documents join labels using (doc_id) group by source")
def score_summary(spark, sf_dir):
    j = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels"), "doc_id")
    return j.groupBy("source").agg(F.avg("quality").alias("mean_quality"), F.count_if(F.col("quality") >= 1).alias("n_good"), F.count_if(F.col("toxic") >= 1).alias("n_toxic"))


@query("length_summary", "select lang, avg(n_chars)::double as mean, quantile_cont(n_chars, 0.5)::double as median, quantile_cont(n_chars, 0.1)::double as p10, quantile_cont(n_chars, 0.9)::double as p90 from documents group by lang")
def length_summary(spark, sf_dir):
    g = table(spark, sf_dir, "documents").groupBy("lang")
    return g.agg(F.avg("n_chars").alias("mean"), *[F.percentile("n_chars", p).alias(a) for p, a in ((0.5, "median"), (0.1, "p10"), (0.9, "p90"))])


@query("index_quantiles", "with x as (select lang, list_sort(list(n_chars)) as xs from documents group by lang) select lang, " + ", ".join(f"xs[least(len(xs), floor({p} * len(xs))::int + 1)] as {a}" for p, a in ((0.25, "p25"), (0.5, "median"), (0.9, "p90"))) + " from x")
def index_quantiles(spark, sf_dir):
    """Quantiles as elements: the value whose running count first passes p * n, over distinct lengths."""
    c = table(spark, sf_dir, "documents").groupBy("lang", "n_chars").agg(F.count("*").alias("c"))
    w = Window.partitionBy("lang")
    r = c.withColumn("upto", F.sum("c").over(w.orderBy("n_chars").rowsBetween(Window.unboundedPreceding, 0))).withColumn("n", F.sum("c").over(w))
    at = lambda p: F.least(F.col("n"), F.floor(F.lit(p) * F.col("n")) + 1)
    return r.groupBy("lang").agg(*[F.min(F.when(F.col("upto") >= at(p), F.col("n_chars"))).alias(a) for p, a in ((0.25, "p25"), (0.5, "median"), (0.9, "p90"))])


@query("stage_retention", "select count(*) as n_docs, sum(length(text))::bigint as chars, sum(length(text)) / 4.2601::double as tokens, sum(case when length(text) >= 500 then length(text) else 0 end)::bigint as kept_chars from documents")
def stage_retention(spark, sf_dir):
    n = F.length("text")
    return table(spark, sf_dir, "documents").agg(F.count("*").alias("n_docs"), F.sum(n).alias("chars"), (F.sum(n) / F.lit(4.2601)).alias("tokens"), F.sum(F.when(n >= 500, n).otherwise(0)).alias("kept_chars"))


@query("counter_deltas", "with e as (select user_id, event_id, value, lag(value) over (partition by user_id order by ts, event_id) as prev from events) select user_id, count(*) as n, sum(greatest(value - coalesce(prev, 0), 0)) as gained from e group by user_id")
def counter_deltas(spark, sf_dir):
    """Rises of a counter since the line before; falls count as nothing."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events").withColumn("prev", F.lag("value").over(w))
    return e.groupBy("user_id").agg(F.count("*").alias("n"), F.sum(F.greatest(F.col("value") - F.coalesce("prev", F.lit(0.0)), F.lit(0.0))).alias("gained"))


@query("last_write_wins", "select user_id, arg_max(event_type, (ts, event_id)) as event_type, max(ts) as ts from events group by user_id")
def last_write_wins(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("event_type"), F.max("ts").alias("ts"))


@query("centred_core", "with t as (select source, lang, avg(quality)::double as acc, (abs(length(source) + length(lang)) % 3) * 10 as b from documents join labels using (doc_id) group by 1, 2) select lang, avg((acc - 0.01 * b) / (1 - 0.01 * b))::double as core, count(*) as n_tasks from t group by lang")
def centred_core(spark, sf_dir):
    """Mean of task accuracies centred by their random baselines."""
    j = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    t = j.groupBy("source", "lang").agg(F.avg("quality").alias("acc")).withColumn("b", 0.01 * ((F.length("source") + F.length("lang")) % 3) * 10)
    return t.groupBy("lang").agg(F.avg((F.col("acc") - F.col("b")) / (1 - F.col("b"))).alias("core"), F.count("*").alias("n_tasks"))
