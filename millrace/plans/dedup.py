"""Queries for deduplication, n-grams, leakage and sets of documents."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.catalog import query
from millrace.functions import text as T
from millrace.operators import dedup as D
from millrace.sources.tables import table


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


@query("exact_dedup_first", "select md5(text) as h, min(doc_id) as doc_id, count(*) as n_copies from documents group by 1")
def exact_dedup_first(spark, sf_dir):
    return _docs(spark, sf_dir).groupBy(F.md5("text").alias("h")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n_copies"))


@query("dup_text_drop_all", "select doc_id from documents where md5(text) in (select md5(text) from documents group by 1 having count(*) = 1)")
def dup_text_drop_all(spark, sf_dir):
    d = _docs(spark, sf_dir).select("doc_id", F.md5("text").alias("h"))
    return d.groupBy("h").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n")).where("n = 1").select("doc_id")


SQL_NGRAM = r"""
with p0 as (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as para, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) as k from documents),
w as (select doc_id, k, para, list_filter(string_split_regex(lower(para), '\s+'), lambda x: x <> '') as w from p0),
g as (select doc_id, k, unnest(list_distinct(list_transform(range(1, len(w) - 11), lambda i: array_to_string(w[i:i + 12], ' ')))) as g from w where len(w) >= 13),
f as (select g, min((doc_id, k)) as first from g group by g),
s as (select g.doc_id, g.k, count(*) as n, sum(cast((g.doc_id, g.k) > f.first as int)) as seen from g join f using (g) group by 1, 2),
d as (select doc_id, sum(n) as n, sum(seen) as seen from s group by 1)
select w.doc_id, count(*)::bigint as n_paragraphs, sum(cast(coalesce(s.seen >= 0.8 * s.n, false) as int))::bigint as n_dropped, coalesce(max(d.seen) >= 0.8 * max(d.n), false) as doc_dropped
from w left join s on w.doc_id = s.doc_id and w.k = s.k left join d on w.doc_id = d.doc_id group by w.doc_id
"""


@query("ngram13_dedup", SQL_NGRAM)
def ngram13_dedup(spark, sf_dir):
    return D.ngram_dedup(_docs(spark, sf_dir), n=13, threshold=0.8)


@query("leak_filter", "select doc_id from documents where md5(text) not in (select md5(text) from benchmark)")
def leak_filter(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark").select(F.md5("text").alias("h"))
    return _docs(spark, sf_dir).withColumn("h", F.md5("text")).join(b, "h", "left_anti").select("doc_id")


@query("leak_passages", r"""with b as (select item_id, list_filter(string_split_regex(lower(text), '\s+'), lambda x: x <> '') as w from benchmark), bg as (select distinct unnest(list_transform(range(1, len(w) - 11), lambda i: array_to_string(w[i:i + 12], ' '))) as g from b where len(w) >= 13),
d as (select doc_id, list_filter(string_split_regex(lower(text), '\s+'), lambda x: x <> '') as w from documents), dg as (select distinct doc_id, unnest(list_transform(range(1, len(w) - 11), lambda i: array_to_string(w[i:i + 12], ' '))) as g from d where len(w) >= 13)
select doc_id, count(*) as n_shared from dg where g in (select g from bg) group by doc_id""")
def leak_passages(spark, sf_dir):
    """Documents that share 13-word runs with the benchmark, on 64-bit hashes; only documents' hashes are shuffled."""
    b = D.grams(table(spark, sf_dir, "benchmark").select("text"), [], 13).distinct()
    g = D.grams(_docs(spark, sf_dir).select("doc_id", "text"), ["doc_id"], 13).distinct()
    return g.join(b, "g", "left_semi").groupBy("doc_id").agg(F.count("*").alias("n_shared"))


@query("ngram_diversity_cumulative", r"""with w as (select doc_id, source, list_filter(string_split_regex(lower(text), '\s+'), lambda x: x <> '') as w from documents),
g as (select source, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) as g from w where len(w) >= 2),
f as (select g, min(source) as source from g group by g), n as (select source, count(*) as fresh from f group by 1), o as (select source, count(*) as occurrences, count(distinct g) as distinct_in_source from g group by 1)
select o.source, occurrences, distinct_in_source, sum(coalesce(fresh, 0)) over (order by o.source)::bigint as cumulative_distinct from o left join n using (source)""")
def ngram_diversity_cumulative(spark, sf_dir):
    """Distinct 2-grams by source, and how many are known after each source: a 2-gram's sources in order, then one
    running sum over as many rows as there are sources. Texts are read, and 2-grams shuffled, once."""
    per = D.gram_counts(_docs(spark, sf_dir).select("source", "text"), "source", 2)
    w = Window.partitionBy("g").orderBy(F.asc_nulls_last("source"))
    first = F.row_number().over(w) == 1
    per = per.withColumns({"first": first & F.col("source").isNotNull(), "new": first | ~F.col("source").eqNullSafe(F.lag("source").over(w))})
    j = per.groupBy("source").agg(F.sum("n").alias("occurrences"), F.count_if("new").alias("distinct_in_source"), F.count_if("first").alias("fresh"))
    return j.select("source", "occurrences", "distinct_in_source", F.sum("fresh").over(Window.orderBy("source").rowsBetween(Window.unboundedPreceding, 0)).alias("cumulative_distinct"))


@query("source_overlap", "select source from documents where lang = 'en' intersect select source from documents where lang = 'de'")
def source_overlap(spark, sf_dir):
    d = _docs(spark, sf_dir)
    return d.where("lang = 'en'").select("source").intersect(d.where("lang = 'de'").select("source"))


@query("shards_todo", "select distinct source from documents except select distinct source from documents where lang = 'es'")
def shards_todo(spark, sf_dir):
    """Shards that have input but no output yet."""
    d = _docs(spark, sf_dir)
    return d.select("source").distinct().join(d.where("lang = 'es'").select("source").distinct(), "source", "left_anti")


@query("hash_sample_per_source", "select doc_id, source from (select doc_id, source, row_number() over (partition by source order by md5('7' || doc_id), doc_id) as n from documents) where n <= 5")
def hash_sample_per_source(spark, sf_dir):
    """Five documents a source, in the order of a seeded hash."""
    w = Window.partitionBy("source").orderBy(F.md5(F.concat(F.lit("7"), F.col("doc_id").cast("string"))), "doc_id")
    return _docs(spark, sf_dir).select("doc_id", "source", F.row_number().over(w).alias("n")).where("n <= 5").select("doc_id", "source")


SQL_QUOTA = r"""with c as (select lang, count(*) as n from documents group by 1), t as (select sum(case when lang = 'es' then n else 0 end) as rare, sum(case when lang = 'es' then 0 else n end) as rest from c),
q as (select lang, case when lang = 'es' then n else least(n, round_even(round_even(rare * 0.7 / 0.3, 0) * n / rest, 0)) end as quota from c, t),
r as (select doc_id, lang, row_number() over (partition by lang order by md5('3' || doc_id), doc_id) as k from documents) select doc_id, r.lang from r join q using (lang) where k <= quota"""


@query("stratified_subsample", SQL_QUOTA)
def stratified_subsample(spark, sf_dir):
    return D.stratified(_docs(spark, sf_dir).select("doc_id", "lang"), "lang", "es", 0.3, "3")


@query("every_nth", "select source, count(*) as n from (select source, row_number() over (partition by source order by doc_id) as k from documents) where (k - 1) % 20 = 0 group by 1")
def every_nth(spark, sf_dir):
    w = Window.partitionBy("source").orderBy("doc_id")
    d = _docs(spark, sf_dir).select("source", F.row_number().over(w).alias("k")).where("(k - 1) % 20 = 0")
    return d.groupBy("source").agg(F.count("*").alias("n"))


@query("top_documents", "select doc_id, n_chars from documents order by n_chars desc, doc_id limit 25")
def top_documents(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", "n_chars").orderBy(F.desc("n_chars"), "doc_id").limit(25)


@query("tag_frequency_prompt", "with c as (select lang, count(*) as n, sum(count(*)) over () as total from documents group by 1) select string_agg(lang || ' ' || case when 100.0 * n / total >= 1 then cast(cast(round_even(100.0 * n / total, 0) as int) as varchar) else cast(round_even(100.0 * n / total, 1) as varchar) end || '%', ', ' order by lang) as line from c")
def tag_frequency_prompt(spark, sf_dir):
    c = _docs(spark, sf_dir).groupBy("lang").count()
    p = 100.0 * F.col("count") / c.agg(F.sum("count")).scalar()
    s = F.concat("lang", F.lit(" "), F.when(p >= 1, F.bround(p, 0).cast("int").cast("string")).otherwise(F.bround(p, 1).cast("string")), F.lit("%"))
    return c.select(s.alias("s")).agg(F.array_join(F.array_sort(F.collect_list("s")), ", ").alias("line"))


@query("interval_merge", r"""with e as (select user_id, floor(epoch(ts) / 60)::bigint as a, floor(epoch(ts) / 60)::bigint + event_id % 50 as b from events), m as (select *, max(b) over (partition by user_id order by a, b rows between unbounded preceding and 1 preceding) as prev from e),
g as (select *, sum(case when prev is null or a > prev + 1 then 1 else 0 end) over (partition by user_id order by a, b rows unbounded preceding) as island from m) select user_id, min(a) as a, max(b) as b, count(*) as n from g group by user_id, island""")
def interval_merge(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", F.floor(F.unix_timestamp("ts") / 60).cast("long").alias("a"), "event_id")
    return D.merge_intervals(e.withColumn("b", F.col("a") + F.col("event_id") % 50).drop("event_id"), "user_id", "a", "b")


@query("prose_runs", r"""with u as (select doc_id, unnest(list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x, E' \t\r')), lambda x: x <> '')) as x, unnest(range(len(list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x, E' \t\r')), lambda x: x <> '')))) as i from documents),
n as (select doc_id, i, len(list_filter(string_split_regex(x, '\s+'), lambda y: y <> '')) as n from u), g as (select *, sum(case when n < 8 then 1 else 0 end) over (partition by doc_id order by i rows unbounded preceding) as g from n),
r as (select doc_id, g, sum(case when n >= 8 then n else 0 end) as w from g group by 1, 2) select doc_id, max(w)::bigint as longest_run from r group by 1""")
def prose_runs(spark, sf_dir):
    """Most words in consecutive lines of eight words or more: a fold over a document's lines, without a shuffle."""
    sizes = F.transform(T.lines_of(T.text_of("text")), lambda x: F.size(T.words(x)))
    start = F.struct(F.lit(0).alias("best"), F.lit(0).alias("run"))
    step = lambda s, n: F.when(n >= 8, F.struct(F.greatest(s.best, s.run + n).alias("best"), (s.run + n).alias("run"))).otherwise(F.struct(s.best.alias("best"), F.lit(0).alias("run")))
    d = _docs(spark, sf_dir).select("doc_id", sizes.alias("n")).where(F.size("n") > 0)
    return d.select("doc_id", F.aggregate("n", start, step, lambda s: s.best).cast("long").alias("longest_run"))
