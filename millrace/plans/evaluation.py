"""Queries over page-aligned evaluation: alignment of systems, scores, line positions, densities and audits."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from millrace.catalog import query
from millrace.functions import text as T
from millrace.operators import models
from millrace.sources.tables import table


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


@query("system_alignment", "with a as (select doc_id from documents), b as (select doc_id, length(text) as n from documents where doc_id % 2 = 0), c as (select doc_id, quality from labels) select count(*) as n, count(b.n) as in_b, count(c.quality) as in_c, count_if(b.n is not null and c.quality is not null)::bigint as in_all from a left join b using (doc_id) left join c using (doc_id)")
def system_alignment(spark, sf_dir):
    """How many pages each system covers."""
    d = _docs(spark, sf_dir)
    j = d.select("doc_id").join(d.where("doc_id % 2 = 0").select("doc_id", F.length("text").alias("n")), "doc_id", "left").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    return j.agg(F.count("*").alias("n"), F.count("n").alias("in_b"), F.count("quality").alias("in_c"), F.count_if(F.col("n").isNotNull() & F.col("quality").isNotNull()).alias("in_all"))


SQL_FIELDS = "x as (select doc_id, 'text' as field, text as t from documents union all select doc_id, 'head', left(text, 200) from documents), u as (select distinct md5(t) as h, length(t) as score from x)"


@query("score_reattachment", f"with {SQL_FIELDS}, s as (select doc_id, field, score from x join u on md5(x.t) = u.h) select doc_id, max(case when field = 'text' then score end) as text_score, max(case when field = 'head' then score end) as head_score from s group by doc_id")
def score_reattachment(spark, sf_dir):
    """Unique texts are scored once; scores go back to pages and fields by digest."""
    x = _docs(spark, sf_dir).select("doc_id", F.explode(F.array(F.struct(F.lit("text").alias("field"), F.col("text").alias("t")), F.struct(F.lit("head").alias("field"), F.substring("text", 1, 200).alias("t")))).alias("x")).select("doc_id", "x.*")
    scores = x.select(F.md5("t").alias("h"), F.length("t").cast("long").alias("score")).distinct()
    s = models.replayed(x, "t", scores, "score")
    return s.groupBy("doc_id").pivot("field", ["text", "head"]).agg(F.max("score")).withColumnsRenamed({"text": "text_score", "head": "head_score"})


@query("unique_texts", f"with {SQL_FIELDS} select count(*) as n, count(distinct md5(t)) as n_unique, (select sum(score) from u)::bigint as chars from x")
def unique_texts(spark, sf_dir):
    x = _docs(spark, sf_dir).select(F.explode(F.array(F.col("text"), F.substring("text", 1, 200))).alias("t"))
    u = x.groupBy(F.md5("t").alias("h")).agg(F.count("*").alias("n"), F.first(F.length("t")).alias("c"))
    return u.agg(F.sum("n").alias("n"), F.count("*").alias("n_unique"), F.sum("c").alias("chars"))


@query("removed_runs", r"""with b as (select doc_id, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x, E' \t\r')), lambda x: x <> '') as ls from documents),
g as (select doc_id, list_transform(ls, lambda x: length(x) >= 60) as kept from b where len(ls) > 0),
p as (select doc_id, len(kept) as n, list_position(kept, true) as first, list_position(list_reverse(kept), true) as last, len(list_filter(kept, lambda k: not k)) as gone from g)
select doc_id, gone::bigint as n_removed, coalesce(first - 1, n)::bigint as leading, coalesce(last - 1, n)::bigint as trailing from p""")
def removed_runs(spark, sf_dir):
    """Runs of removed (short) lines at the start and end of each page."""
    kept = F.transform(T.lines_of(T.text_of("text")), lambda x: F.length(x) >= 60)
    d = _docs(spark, sf_dir).select("doc_id", kept.alias("k")).where(F.size("k") > 0)
    lead = lambda c: F.when(F.array_position(c, F.lit(True)) == 0, F.size("k")).otherwise(F.array_position(c, F.lit(True)) - 1).cast("long")
    return d.select("doc_id", F.size(F.filter("k", lambda x: ~x)).cast("long").alias("n_removed"), lead(F.col("k")).alias("leading"), lead(F.reverse("k")).alias("trailing"))


@query("removed_line_deciles", r"""with b as (select list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x, E' \t\r')), lambda x: x <> '') as ls from documents),
u as (select unnest(list_transform(ls, lambda x, i: {'d': least(9, floor(10 * (i - 0.5) / len(ls)))::int, 'gone': length(x) < 60})) as s from b) select s.d as decile, count(*) as n, count_if(s.gone)::bigint as n_removed from u group by 1""")
def removed_line_deciles(spark, sf_dir):
    """Where on the page removed lines are, in tenths of its lines."""
    lines = T.lines_of(T.text_of("text"))
    d = _docs(spark, sf_dir).select(lines.alias("ls")).withColumn("n", F.size("ls"))
    u = d.select("n", F.posexplode("ls").alias("i", "x"))
    return u.groupBy(F.least(F.lit(9), F.floor(10 * (F.col("i") + 0.5) / F.col("n"))).cast("int").alias("decile")).agg(F.count("*").alias("n"), F.count_if(F.length("x") < 60).alias("n_removed"))


@query("log_length_density", f"with x as (select ln(n_chars) as x from documents where n_chars > 0), s as (select count(*) as n, stddev_samp(x) as sd from x), h as (select n, sd * pow(n, -0.2) as h from s), g as (select 4 + i * 0.5 as point from range(15) r(i)) select point::double as point, (sum(exp(-0.5 * pow((point - x) / h, 2))) / (max(n) * max(h) * {math.sqrt(2 * math.pi)!r}))::double as density from x, h, g group by point")
def log_length_density(spark, sf_dir):
    """Gaussian kernel density of log lengths on a grid of 15 points, Scott's bandwidth. Lengths are counted first, so the
    grid multiplies distinct lengths and not documents."""
    x = _docs(spark, sf_dir).where("n_chars > 0").groupBy("n_chars").agg(F.count("*").alias("c")).withColumn("x", F.ln("n_chars"))
    n, m, q = F.sum("c"), F.sum(F.col("c") * F.col("x")), F.sum(F.col("c") * F.col("x") * F.col("x"))
    s = x.agg(F.struct(n.alias("n"), (F.sqrt((q - m * m / n) / (n - 1)) * F.pow(n.cast("double"), F.lit(-0.2))).alias("h"))).scalar()
    grid = F.explode(F.transform(F.sequence(F.lit(0), F.lit(14)), lambda i: (4 + i * 0.5).cast("double")))
    j = x.select("x", "c", grid.alias("point"), s.alias("s"))
    k = F.sum(F.col("c") * F.exp(-0.5 * F.pow((F.col("point") - F.col("x")) / F.col("s.h"), F.lit(2.0))))
    return j.groupBy("point").agg((k / (F.max("s.n") * F.max("s.h") * F.lit(math.sqrt(2 * math.pi)))).alias("density"))


@query("chunk_merge_parity", "with a as (select source, lang, count(*) as n from documents where doc_id % 2 = 0 group by 1, 2), b as (select source, lang, count(*) as n from documents where doc_id % 2 = 1 group by 1, 2) select coalesce(a.source, b.source) as source, count(*) as n_tasks, count_if(a.n is not null and b.n is not null)::bigint as in_both, sum(coalesce(a.n, 0) + coalesce(b.n, 0))::bigint as total from a full join b on a.source = b.source and a.lang = b.lang group by 1")
def chunk_merge_parity(spark, sf_dir):
    d = _docs(spark, sf_dir)
    g = d.groupBy("source", "lang").agg(F.count_if(F.col("doc_id") % 2 == 0).alias("a"), F.count_if(F.col("doc_id") % 2 == 1).alias("b"))
    return g.groupBy("source").agg(F.count("*").alias("n_tasks"), F.count_if((F.col("a") > 0) & (F.col("b") > 0)).alias("in_both"), F.sum(F.col("a") + F.col("b")).alias("total"))


@query("exact_match_metric", r"""with p as (select lang, text as ref, case doc_id % 4 when 0 then translate(text, 'aeiou', 'AEIOU') when 1 then replace(text, ',', ';') when 2 then regexp_replace(text, '[0-9]', '', 'g') || ' 7' else substr(text, 2) end as gen from documents),
n as (select lang, ref = gen as plain, lower(ref) = lower(gen) as no_case, regexp_replace(ref, '[!-/:-@\[-`{-~]', '', 'g') = regexp_replace(gen, '[!-/:-@\[-`{-~]', '', 'g') as no_punct, regexp_replace(ref, '[0-9]|\s', '', 'g') = regexp_replace(gen, '[0-9]|\s', '', 'g') as no_digits from p)
select lang, avg(plain::int)::double as plain, avg(no_case::int)::double as no_case, avg(no_punct::int)::double as no_punct, avg(no_digits::int)::double as no_digits from n group by lang""")
def exact_match_metric(spark, sf_dir):
    """Share of generations that equal their references, with each of the metric's options."""
    from millrace.operators.metrics import exact_match

    k = F.col("doc_id") % 4
    gen = F.when(k == 0, F.translate("text", "aeiou", "AEIOU")).when(k == 1, F.replace("text", F.lit(","), F.lit(";"))).when(k == 2, F.concat(F.regexp_replace("text", "[0-9]", ""), F.lit(" 7"))).otherwise(F.expr("substring(text, 2)"))
    p = _docs(spark, sf_dir).select("lang", F.col("text").alias("ref"), gen.alias("gen"))
    same = {"plain": {}, "no_case": {"case": True}, "no_punct": {"punctuation": True}, "no_digits": {"digits": True, "drop": r"\s"}}
    return p.groupBy("lang").agg(*[F.avg(exact_match(F.col("gen"), F.col("ref"), **o).cast("int")).alias(n) for n, o in same.items()])


@query("loop_counts", r"""with w as (select doc_id, n_chars, list_filter(string_split_regex(lower(text), '\s+'), lambda x: x <> '') as w from documents), g as (select n_chars, case when len(w) >= 40 then list_transform(range(1, len(w) - 6), lambda i: array_to_string(w[i:i + 7], ' ')) end as g from w),
r as (select n_chars >= 2000 as long, 1 - len(list_distinct(g)) / len(g) as r from g) select case when long then 'length' else 'stop' end as finish, count(*) as n, count_if(r > 0.3)::bigint as over_30, count_if(r > 0.5)::bigint as over_50 from r group by 1""")
def loop_counts(spark, sf_dir):
    """Repetitive outputs by how they ended."""
    d = T.with_repetition(_docs(spark, sf_dir).select("n_chars", "text"), "r", "text")
    return d.groupBy(F.when(F.col("n_chars") >= 2000, "length").otherwise("stop").alias("finish")).agg(F.count("*").alias("n"), F.count_if(F.col("r") > 0.3).alias("over_30"), F.count_if(F.col("r") > 0.5).alias("over_50"))


@query("judge_positions", "with p as (select doc_id, source, row_number() over (partition by source order by md5(doc_id || source)) as pos from documents) select pos, count(*) as n, avg(quality)::double as mean_quality from p join labels using (doc_id) where pos <= 10 group by pos")
def judge_positions(spark, sf_dir):
    """Mean score by the place at which a group's item was submitted."""
    from pyspark.sql.window import Window

    w = Window.partitionBy("source").orderBy(F.md5(F.concat(F.col("doc_id").cast("string"), "source")))
    p = _docs(spark, sf_dir).select("doc_id", F.row_number().over(w).alias("pos")).where("pos <= 10")
    return p.join(table(spark, sf_dir, "labels"), "doc_id").groupBy(F.col("pos").cast("long").alias("pos")).agg(F.count("*").alias("n"), F.avg("quality").alias("mean_quality"))


@query("windowed_events", "select time_bucket(interval '1 day', ts) as day, event_type, count(*) as n from events group by 1, 2")
def windowed_events(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day"), "event_type").agg(F.count("*").alias("n"))
