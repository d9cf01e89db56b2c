"""Queries over rendering, derived programs, chunk programs and packing."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.catalog import query
from millrace.functions import markup as K
from millrace.functions import text as T
from millrace.operators import diffs, fitting, prox
from millrace.operators import program as P
from millrace.sources import corpus
from millrace.sources.tables import table


@query("render_pages")
def render_pages(spark, sf_dir):
    p = table(spark, sf_dir, "pages").where("html is not null and trim(html) <> ''").select("page_id", K.render("html").alias("text"))
    return p.select("page_id", F.length("text").cast("long").alias("chars"), F.size(T.lines_of(T.text_of("text"))).cast("long").alias("n_lines"), F.md5("text").alias("text_md5"))


@query("extract_main")
def extract_main(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", K.main_content("html").alias("text"))
    return p.select("page_id", F.length("text").cast("long").alias("chars"), F.md5("text").alias("text_md5"))


@query("dom_labels")
def dom_labels(spark, sf_dir):
    """How many rendered lines each block label has."""
    p = table(spark, sf_dir, "pages").select(F.explode(F.split(K.labelled("html"), "\n")).alias("line"))
    return p.groupBy(F.regexp_extract("line", r"^<lid:\d+\|([^>.]*)", 1).alias("tag")).agg(F.count("*").alias("n"))


@query("make_ops_roundtrip")
def make_ops_roundtrip(spark, sf_dir):
    """Programs derived from pages and their lines without every third one, executed again: all exact ones must give the target."""
    lines = T.lines_of(T.text_of("text"))
    d = table(spark, sf_dir, "documents").select("doc_id", F.array_join(lines, "\n").alias("src"), F.array_join(F.filter(lines, lambda x, i: i % 3 != 1), "\n").alias("dst"))
    d = d.withColumn("ops", diffs.program_of("src", "dst"))
    e = P.execute(d.select("doc_id", "dst", "ops", F.col("src").alias("page"), F.concat(F.lit("<keep>\n<extract>\n"), F.coalesce("ops", F.lit("")), F.lit("\n<keep>")).alias("program")))
    same = T.collapse(F.col("final")) == T.collapse(F.col("dst"))
    return e.select(F.col("ops").isNotNull().alias("exact"), same.alias("same")).agg(F.count("*").alias("n"), F.count_if("exact").alias("n_exact"), F.count_if("same").alias("n_same"))


@query("edit_effects")
def edit_effects(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("text").alias("a"), F.regexp_replace("text", r"^[^\n]*\n", "").alias("b"))
    return d.select(diffs.effect_of("a", "b").alias("effect")).groupBy("effect").agg(F.count("*").alias("n"))


@query("prox_execute")
def prox_execute(spark, sf_dir):
    program = F.when(F.col("doc_id") % 3 == 0, F.lit("remove_lines(start=0, end=1)\nnormalize(source=\"the\", target=\"a\")")).when(F.col("doc_id") % 3 == 1, F.lit("remove_all()")).otherwise(F.lit("remove_lines(start=5\nbroken"))
    d = table(spark, sf_dir, "documents").select("doc_id", prox.executed("text", program).alias("x"))
    return d.select("doc_id", F.md5("x.text").alias("text_md5"), F.col("x.errors").cast("long").alias("errors"))


@query("bfd_pack")
def bfd_pack(spark, sf_dir):
    shard = F.concat_ws("-", "source", F.floor(F.col("doc_id") / 2048).cast("string")).alias("shard")  # bounded, as files are
    d = table(spark, sf_dir, "documents").select(shard, "doc_id", "n_chars")
    packed = fitting.pack(d, "shard", "doc_id", "n_chars", 32768)
    return packed.groupBy("shard").agg(F.count_distinct("bin").alias("bins"), F.count("*").alias("n"), F.sum("length").alias("total"))


@query("line_chunks", r"""with recursive l as (select doc_id, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x, E' \t\r')), lambda x: x <> '') as l from documents),
c(doc_id, i, used, chunk) as (select doc_id, 1, length(l[1]), 1 from l where len(l) > 0
  union all select c.doc_id, i + 1, case when used + length(l[i + 1]) <= 1500 then used + length(l[i + 1]) else length(l[i + 1]) end, case when used + length(l[i + 1]) <= 1500 then chunk else chunk + 1 end from c join l using (doc_id) where i < len(l))
select doc_id, chunk::bigint as chunk, count(*) as n_lines, max(used)::bigint as chars from c group by 1, 2""")
def line_chunks(spark, sf_dir):
    """Chunks of consecutive lines within 1,500 characters."""
    lines = T.lines_of(T.text_of("text"))
    d = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(fitting.line_chunks(lines, F.length, 1500)).alias("k", "chunk"))
    return d.select("doc_id", (F.col("k") + 1).cast("long").alias("chunk"), F.size("chunk").cast("long").alias("n_lines"), F.length(F.array_join("chunk", "")).cast("long").alias("chars"))


@query("accounting_hours", "select event_type as state, sum(cast(floor(abs(value) * 10) as bigint) * (user_id % 8)) / 3600 as gpu_hours, count(*) as n, count_if(user_id % 8 = 0)::bigint as without_gpus from events group by 1")
def accounting_hours(spark, sf_dir):
    """Accounting lines with a header's names, read by the accounting reader."""
    seconds, devices = F.floor(F.abs("value") * 10).cast("string"), (F.col("user_id") % 8).cast("string")
    gpus = F.when(F.col("user_id") % 8 == 0, F.lit("billing=4,cpu=4")).otherwise(F.concat(F.lit("billing=4,cpu=4,gres/gpu="), devices, F.lit(",node=1")))
    lines = table(spark, sf_dir, "events").select(F.concat_ws("|", F.col("user_id").cast("string"), "event_type", seconds, gpus).alias("value"))
    e = corpus.parsed_accounting(lines, "JobID|State|ElapsedRaw|AllocTRES")
    return e.groupBy(F.col("State").alias("state")).agg(F.sum("gpu_hours").alias("gpu_hours"), F.count("*").alias("n"), F.count_if(F.col("gpus") == 0).alias("without_gpus"))


@query("length_batches", "with d as (select doc_id, n_chars from documents where n_chars is not null), o as (select *, row_number() over (order by n_chars, doc_id) - 1 as k, sum(n_chars) over (order by n_chars, doc_id) - n_chars as before from d) select k // 50 as rows_batch, (before // 200000)::bigint as size_batch, count(*) as n, sum(n_chars)::bigint as chars, max(n_chars) as longest from o group by 1, 2")
def length_batches(spark, sf_dir):
    """Batches of rows of like length, for a model's input."""
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars").where("n_chars is not null")
    b = fitting.length_batches(d, "doc_id", "n_chars", 50, 200_000)
    return b.groupBy(F.col("batch.rows").alias("rows_batch"), F.col("batch.total").alias("size_batch")).agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"), F.max("n_chars").alias("longest"))


@query("shard_schedule")
def shard_schedule(spark, sf_dir):
    """Shards to four workers, the largest first."""
    s = table(spark, sf_dir, "documents").groupBy("source").agg(F.sum("n_chars").alias("size"))
    return fitting.scheduled(s, "source", "size", 4)


@query("annotated_lines")
def annotated_lines(spark, sf_dir):
    """Lines of rendered pages with the labels of the smallest blocks that hold them."""
    p = table(spark, sf_dir, "pages").where("html is not null").select("page_id", K.annotated("html", K.render("html")).alias("t"))
    return p.select("page_id", F.regexp_count("t", F.lit(r"(?m)^<lid:\d+\|")).cast("long").alias("n_labelled"), F.size(T.lines_of(T.text_of("t"))).cast("long").alias("n_lines"), F.md5("t").alias("text_md5"))
