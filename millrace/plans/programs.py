"""Queries over edit programs. The tables hold no programs, so they are derived from the documents by rule."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.catalog import query
from millrace.functions import text as T
from millrace.operators import program as P
from millrace.sources.tables import table


def programs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, source, page (numbered), program: five kinds of program, by id."""
    d = table(spark, sf_dir, "documents").withColumn("page", T.number_lines(T.text_of("text")))
    k = F.col("doc_id") % 5
    p = (
        F.when(k == 0, F.lit("<keep>\n<extract>\nrm 1\n<keep>"))
        .when(k == 1, F.lit('<edit>\n<extract>\nrm 2-3\n<edit>\nrm 1\nsub 4: "the "'))
        .when(k == 2, F.lit("<delete>\n<extract>\n<delete>"))
        .when(k == 3, F.concat(F.lit("<rewrite>\n<extract>\n<rewrite>\nA short rewrite of document "), F.col("doc_id").cast("string"), F.lit(".")))
        .otherwise(F.lit("<edit>\n<extract>\nrm 1\n<edit>\nnew text\nrm 9"))
    )
    return d.select("doc_id", "source", "page", p.alias("program"))


#: Lines of documents and what the five kinds of program make of them, written out case by case.
SQL_LINES = r"""
l as (select doc_id, source, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> '') as ls from documents),
x as (
  select doc_id, source, doc_id % 5 as k, ls,
    array_to_string(ls[2:], chr(10)) as one,
    array_to_string(list_concat(ls[1:1], ls[4:]), chr(10)) as two_three,
    array_to_string(list_filter(list_concat(
      case when len(ls) >= 4 then [trim(regexp_replace(case when strpos(ls[4], 'the ') > 0 then ls[4][:strpos(ls[4], 'the ') - 1] || ls[4][strpos(ls[4], 'the ') + 4:] else ls[4] end, '\s+', ' ', 'g'))] else [] end,
      ls[5:]), lambda y: y <> ''), chr(10)) as edited
  from l),
e as (
  select doc_id, source,
    case k when 0 then '<extract>' when 1 then '<refine>' when 2 then '<delete>' when 3 then '<rewrite>' else '<refine>' end as tag,
    case k when 0 then one when 1 then edited when 2 then '' when 3 then 'A short rewrite of document ' || doc_id || '.' else 'new text' || chr(10) || 'rm 9' end as final,
    case k when 0 then one when 1 then two_three when 2 then array_to_string(ls, chr(10)) when 3 then array_to_string(ls, chr(10)) else one end as extracted,
    case k when 0 then 'keep' when 1 then case when edited = two_three then 'edit, no effective change' else 'edit: lines + strings' end when 2 then 'delete' when 3 then 'rewrite'
      else 'edit: full-text fallback' end as op_class
  from x)
"""


@query("execute_programs", f"with {SQL_LINES} select doc_id, tag, md5(final) as final_md5, md5(extracted) as extracted_md5, op_class, false as parse_fail from e")
def execute_programs(spark, sf_dir):
    e = P.execute(programs(spark, sf_dir))
    return e.select("doc_id", "tag", F.md5("final").alias("final_md5"), F.md5("extracted").alias("extracted_md5"), "op_class", "parse_fail")


@query("executed_tag_mix", f"with {SQL_LINES} select tag, count(*) as n, sum(cast(tag <> '<delete>' and final <> '' as bigint))::bigint as n_emitted from e group by tag")
def executed_tag_mix(spark, sf_dir):
    e = P.execute(programs(spark, sf_dir)).select("tag", P.emitted(F.col("tag"), F.col("final")).alias("out"))
    return e.groupBy("tag").agg(F.count("*").alias("n"), F.count_if("out").alias("n_emitted"))


@query("op_class_mix", f"with {SQL_LINES} select source, op_class, count(*) as n from e group by rollup(source, op_class)")
def op_class_mix(spark, sf_dir):
    return P.execute(programs(spark, sf_dir)).rollup("source", "op_class").agg(F.count("*").alias("n"))


@query("arms_nodel_noedit_norw", f"""with {SQL_LINES}, a(arm, target) as (values ('nodel', '<delete>'), ('noedit', '<refine>'), ('norw', '<rewrite>')),
o as (select a.arm, e.doc_id, case when e.tag = a.target then extracted else final end as text, case when e.tag = a.target then '<extract>' else e.tag end as tag, case when e.tag = a.target then e.tag end as ablation_from from e, a)
select arm, tag, count(*) as n, count(ablation_from) as n_changed, sum(length(text))::bigint as chars from o where tag <> '<delete>' and trim(text) <> '' group by arm, tag""")
def arms(spark, sf_dir):
    """Each arm gives up one operation: its documents fall back to the extracted text. One pass, three rows a document."""
    e = P.execute(programs(spark, sf_dir))
    arm = F.explode(F.array(*[F.struct(F.lit(a).alias("arm"), F.lit(t).alias("target")) for a, t in (("nodel", "<delete>"), ("noedit", "<refine>"), ("norw", "<rewrite>"))]))
    x = e.select("doc_id", "tag", "final", "extracted", arm.alias("a"))
    hit = F.col("tag") == F.col("a.target")
    o = x.select("a.arm", F.when(hit, F.col("extracted")).otherwise(F.col("final")).alias("text"), F.when(hit, F.lit("<extract>")).otherwise(F.col("tag")).alias("tag"), F.when(hit, F.col("tag")).alias("ablation_from"))
    return o.groupBy("arm", "tag").agg(F.count_if(P.emitted(F.col("tag"), F.col("text"))).alias("n"), F.count_if(P.emitted(F.col("tag"), F.col("text")) & F.col("ablation_from").isNotNull()).alias("n_changed"), F.sum(F.when(P.emitted(F.col("tag"), F.col("text")), F.length("text")).otherwise(0)).alias("chars")).where("n > 0")


@query("arm_norwdel", f"with {SQL_LINES} select count(*) as n, sum(length(final))::bigint as chars from e where tag not in ('<delete>', '<rewrite>') and trim(final) <> ''")
def arm_norwdel(spark, sf_dir):
    e = P.execute(programs(spark, sf_dir)).select("tag", "final")
    out = (F.col("tag") != "<rewrite>") & P.emitted(F.col("tag"), F.col("final"))
    return e.agg(F.count_if(out).alias("n"), F.sum(F.when(out, F.length("final"))).alias("chars"))


@query("arm_noext", r"""with l as (select doc_id, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> '') as ls from documents)
select doc_id, len(ls)::bigint as n_lines, md5(array_to_string(ls, chr(10))) as text_md5 from l where doc_id % 5 = 0 and len(ls) > 0""")
def arm_noext(spark, sf_dir):
    """The keep programs of `arm_noext_all`: the whole page comes back."""
    e = P.execute(programs(spark, sf_dir), drop_extract=True).where("tag = '<extract>'")
    return e.select("doc_id", F.size(T.lines_of(F.col("final"))).cast("long").alias("n_lines"), F.md5("final").alias("text_md5")).where("n_lines > 0")


@query("arm_noext_all", rf"""with {SQL_LINES},
n as (select doc_id, k, ls, array_to_string(list_filter(list_concat(ls[2:3],
    case when len(ls) >= 4 then [trim(regexp_replace(case when strpos(ls[4], 'the ') > 0 then ls[4][:strpos(ls[4], 'the ') - 1] || ls[4][strpos(ls[4], 'the ') + 4:] else ls[4] end, '\s+', ' ', 'g'))] else [] end,
    ls[5:]), lambda y: y <> ''), chr(10)) as edit_only from x),
o as (select e.doc_id, e.tag, case n.k when 0 then array_to_string(n.ls, chr(10)) when 1 then n.edit_only else e.final end as text from e join n using (doc_id))
select doc_id, tag, md5(text) as text_md5 from o where tag <> '<delete>' and trim(text) <> ''""")
def arm_noext_all(spark, sf_dir):
    """Programs of all kinds without their extract block: removals and cuts of an edit alone apply, to the whole page."""
    e = P.execute(programs(spark, sf_dir), drop_extract=True)
    return e.where(P.emitted(F.col("tag"), F.col("final"))).select("doc_id", "tag", F.md5("final").alias("text_md5"))


@query("decision_flow", f"""with {SQL_LINES}, o as (select case op_class when 'keep' then 'keep' when 'delete' then 'delete' when 'rewrite' then 'rewrite' else 'edit' end as decision, case when tag <> '<delete>' and final <> '' then 'emitted' else 'dropped' end as outcome from e)
select decision, count_if(outcome = 'emitted')::bigint as emitted, count_if(outcome = 'dropped')::bigint as dropped from o group by decision""")
def decision_flow(spark, sf_dir):
    e = P.execute(programs(spark, sf_dir))
    decision = F.regexp_extract("op_class", "^(keep|edit|delete|rewrite)", 1)
    out = P.emitted(F.col("tag"), F.col("final"))
    return e.select(decision.alias("decision"), out.alias("o")).groupBy("decision").agg(F.count_if("o").alias("emitted"), F.count_if(~F.col("o")).alias("dropped"))


@query("postfilter_flags", r"""with t as (select doc_id, case doc_id % 4 when 0 then 'rm 3' || chr(10) || 'rm 4-5' || chr(10) || text when 1 then '<keep> ' || left(text, 100) when 2 then text || chr(10) || ' <edit> ' else text end as text,
case doc_id % 3 when 0 then '<extract>' when 1 then null else '<rewrite>' end as tag from documents)
select doc_id, (len(regexp_extract_all(text, '(?m)^(rm \d+(-\d+)?(:\d+)?|sub \d+: )')) >= 2 or (regexp_matches(ltrim(text), '^(<extract>|<edit>|<delete>|<keep>)') and length(text) < 200)) as a2,
coalesce(tag not in ('<extract>', '<refine>', '<rewrite>'), true) as a3,
len(list_filter(string_split(text, chr(10)), lambda x: trim(x) in ('<extract>', '<refine>', '<rewrite>', '<delete>', '<edit>'))) > 0 as a5 from t""")
def postfilter_flags(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    k = F.col("doc_id") % 4
    text = F.when(k == 0, F.concat(F.lit("rm 3\nrm 4-5\n"), "text")).when(k == 1, F.concat(F.lit("<keep> "), F.substring("text", 1, 100))).when(k == 2, F.concat("text", F.lit("\n <edit> "))).otherwise(F.col("text"))
    tag = F.when(F.col("doc_id") % 3 == 0, F.lit("<extract>")).when(F.col("doc_id") % 3 == 1, F.lit(None).cast("string")).otherwise(F.lit("<rewrite>"))
    r = d.select("doc_id", P.postfilter(text, tag).alias("r"))
    return r.select("doc_id", *[F.array_contains("r", x).alias(x.lower()) for x in ("A2", "A3", "A5")])


@query("merged_line_ranges", r"""with l as (select doc_id, unnest(range(1, 13)) as i from documents), k as (select doc_id, i from l where (i * 7 + doc_id) % 3 <> 0),
g as (select doc_id, i, i - row_number() over (partition by doc_id order by i) as g from k), r as (select doc_id, min(i) as a, max(i) as b from g group by doc_id, g)
select doc_id, string_agg(case when a = b then 'rm ' || a else 'rm ' || a || '-' || b end, chr(10) order by a) as ops from r group by doc_id""")
def merged_line_ranges(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id")
    ids = F.filter(F.sequence(F.lit(1), F.lit(12)), lambda i: (i * 7 + F.col("doc_id")) % 3 != 0)
    return d.select("doc_id", F.array_join(P.merged_ranges(ids), "\n").alias("ops"))
