"""Queries over joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.catalog import query
from millrace.operators import joins as J
from millrace.sources.tables import table


@query("fallback_join_kind", """with l as (select doc_id as id, 'u' || (doc_id % 97) as url from documents), r as (select page_id * 3 as id, 'u' || (page_id % 90) as url, length(html) as chars from pages),
u as (select url, min(chars) as chars from r group by url having count(*) = 1)
select l.id, case when r.id is not null then 'id' when u.url is not null then 'url' else 'none' end as join_kind, coalesce(r.chars, u.chars) as chars from l left join r on l.id = r.id left join u on l.url = u.url""")
def fallback_join_kind(spark, sf_dir):
    left = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.concat(F.lit("u"), (F.col("doc_id") % 97).cast("string")).alias("url"))
    right = table(spark, sf_dir, "pages").select((F.col("page_id") * 3).alias("id"), F.concat(F.lit("u"), (F.col("page_id") % 90).cast("string")).alias("url"), F.length("html").cast("long").alias("chars"))
    return J.fallback_join(left, right, "id", "url", ["chars"]).select("id", "join_kind", "chars")


@query("exact_text_join", "with r as (select source, md5(text) as h, min(doc_id) as first_id, count(*) as n from documents where lang <> 'fr' group by 1, 2) select d.doc_id, r.first_id, coalesce(r.n, 0) as n_matches from documents d left join r on d.source = r.source and md5(d.text) = r.h")
def exact_text_join(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    right = d.where("lang <> 'fr'").select("source", "text", F.col("doc_id").alias("first_id"))
    return J.text_join(d.select("doc_id", "source", "text"), right, "source", "text", "first_id", ["first_id"]).select("doc_id", "first_id", "n_matches")


@query("positional_zip", "with s as (select source, doc_id, row_number() over (partition by source order by doc_id) as r from documents where lang = 'en'), t as (select source, doc_id, row_number() over (partition by source order by doc_id) as r from documents where lang <> 'en'), c as (select source from (select source, count_if(lang = 'en') as a, count_if(lang <> 'en') as b from documents group by 1) where a >= b) select s.source, s.doc_id as left_id, t.doc_id as right_id from s join t on s.source = t.source and s.r = t.r where s.source in (select source from c)")
def positional_zip(spark, sf_dir):
    """Rows of two lists joined by place; shards whose lists do not fit are left out."""
    from pyspark.sql.window import Window

    d = table(spark, sf_dir, "documents").select("source", "doc_id", "lang")
    r = F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))
    s = d.where("lang = 'en'").select("source", F.col("doc_id").alias("left_id"), r.alias("r"))
    t = d.where("lang <> 'en'").select("source", F.col("doc_id").alias("right_id"), r.alias("r"))
    fits = d.groupBy("source").agg(F.count_if(F.col("lang") == "en").alias("a"), F.count_if(F.col("lang") != "en").alias("b")).where("a >= b").select("source")
    return s.join(t, ["source", "r"]).join(fits, "source", "left_semi").select("source", "left_id", "right_id")


@query("interval_attribution", "with m as (select event_id, user_id, floor(epoch(ts))::bigint as t from events where event_type = 'purchase'), s as (select user_id, min(floor(epoch(ts))::bigint) as a, min(floor(epoch(ts))::bigint) + 86400 as b from events group by 1) select s.user_id, count(*) as n from m join s on m.user_id = s.user_id and m.t >= s.a and m.t <= s.b + 10 group by 1")
def interval_attribution(spark, sf_dir):
    """Markers that fall in an interval of their key, with ten seconds of grace. Intervals are laid into slots of their
    length, two each, so that a key with very many markers and intervals meets only those of its slot."""
    e = table(spark, sf_dir, "events").withColumn("t", F.unix_timestamp(F.col("ts").cast("timestamp")))
    slot = lambda c: F.floor(c / 86400)
    m = e.where("event_type = 'purchase'").select("event_id", "user_id", "t", slot(F.col("t")).alias("slot"))
    s = e.groupBy("user_id").agg(F.min("t").alias("a")).withColumn("b", F.col("a") + 86410)
    s = s.withColumn("slot", F.explode(F.sequence(slot(F.col("a")), slot(F.col("b")))))
    return m.join(s, ["user_id", "slot"]).where("t >= a and t <= b").groupBy("user_id").agg(F.count("*").alias("n"))


@query("hash_cache_split", "with c as (select distinct md5(text) as h from documents where doc_id % 3 = 0) select case when md5(text) in (select h from c) then 'hit' else 'miss' end as state, count(*) as n, count(distinct md5(text)) as n_texts from documents group by 1")
def hash_cache_split(spark, sf_dir):
    """Unique texts whose scores are known already, and those left to score."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("h"))
    cache = d.where("doc_id % 3 = 0").select("h").distinct().withColumn("known", F.lit(True))
    per = d.groupBy("h").agg(F.count("*").alias("n")).join(cache, "h", "left")
    return per.groupBy(F.when(F.col("known"), F.lit("hit")).otherwise(F.lit("miss")).alias("state")).agg(F.sum("n").alias("n"), F.count("*").alias("n_texts"))


@query("transition_matrix", "select a.role as from_role, b.role as to_role, count(*) as n from conversations a full outer join conversations b on a.conv_id = b.conv_id and a.turn + 1 = b.turn group by 1, 2")
def transition_matrix(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    a = c.select("conv_id", (F.col("turn") + 1).alias("t"), F.col("role").alias("from_role"))
    b = c.select("conv_id", F.col("turn").alias("t"), F.col("role").alias("to_role"))
    return a.join(b, ["conv_id", "t"], "full").groupBy("from_role", "to_role").agg(F.count("*").alias("n"))


@query("head_check_join")
def head_check_join(spark, sf_dir):
    """Documents as rendered rows of a shard, every seventh missing from the texts, aligned by their first words."""
    d = table(spark, sf_dir, "documents").select("source", "doc_id", "text")
    head = F.substring(F.lower(F.regexp_replace("text", r"\s+", " ")), 1, 600)
    return J.aligned(d.withColumn("head", head), d.where("doc_id % 7 <> 0"), "source", "doc_id")
