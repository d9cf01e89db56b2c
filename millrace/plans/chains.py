"""The two rule stacks as whole chains with one verdict a page."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.catalog import query
from millrace.functions import repetition
from millrace.functions import rules as R
from millrace.functions import text as T
from millrace.functions.repetition import repetition_pairs, repetition_shares
from millrace.plans.rules import SQL_M, SQL_RW
from millrace.sources.tables import table

#: Word n-grams that repeat, from 2 to 10 words, each size from the one before it, as only repeated ones can repeat
#: when they grow: which pages exceed a limit of the repetition rule, written out.
SQL_GRAMS = (
    """wd as (select doc_id, unnest(w) as x, unnest(range(1, len(w) + 1)) as p from m),
p1 as (select doc_id, p as i, x as g from wd),
"""
    + "\n".join(
        f"""p{n} as (select p{n - 1}.doc_id, i, g || ' ' || x as g, count(*) over (partition by p{n - 1}.doc_id, g || ' ' || x) as c from p{n - 1} join wd on wd.doc_id = p{n - 1}.doc_id and wd.p = i + {n - 1} qualify c > 1),"""
        for n in range(2, 11)
    )
    + """
top as (select doc_id, n, max({'c': c, 'k': length(g)}) as t from (select 2 as n, * from p2 union all select 3, * from p3 union all select 4, * from p4) group by 1, 2),
pos as (select distinct doc_id, n, i + j as p from (select 5 as n, * from p5 union all select 6, * from p6 union all select 7, * from p7 union all select 8, * from p8 union all select 9, * from p9 union all select 10, * from p10), range(10) r(j) where j < n),
cov as (select pos.doc_id, n, sum(length(x)) as k from pos join wd on pos.doc_id = wd.doc_id and pos.p = wd.p group by 1, 2),
over_top as (select distinct top.doc_id from top join m on top.doc_id = m.doc_id where top.t.c * top.t.k / length(m.t) > case n when 2 then 0.2 when 3 then 0.18 else 0.16 end),
over_cov as (select distinct cov.doc_id from cov join m on cov.doc_id = m.doc_id where k / length(array_to_string(m.w, '')) > case n when 5 then 0.15 when 6 then 0.14 when 7 then 0.13 when 8 then 0.12 when 9 then 0.11 else 0.10 end)
"""
)
SQL_LEFT = rf"""
mods as (select doc_id, list_filter(list_transform(list_filter(l, lambda x: length(regexp_replace(x, '[^A-Z]', '', 'g')) <= 0.5 * length(x) and length(regexp_replace(x, '[^0-9]', '', 'g')) <= 0.999999 * length(regexp_replace(x, '\s', '', 'g'))
  and not regexp_matches(x, '{R.COUNTER}') and len(list_filter(string_split_regex(x, '\s+'), lambda y: y <> '')) >= 2),
  lambda x: trim(case when len(list_filter(string_split_regex(x, '\s+'), lambda y: y <> '')) <= 10 then regexp_replace(regexp_replace(regexp_replace(x, 'items in cart', '', 'gi'), '(?i)Read more\.\.\.$', ''), '^(?i)Sign-in', '') else x end, E' \t\r\n')), lambda x: x <> '') as k from m),
cut as (select mods.doc_id, k, (n_words - len(list_filter(string_split_regex(array_to_string(k, ' '), '\s+'), lambda y: y <> ''))) / n_words as removed from mods join m using (doc_id))
"""
_SQL_CLEANED = SQL_M.replace("coalesce(text, '')", r"regexp_replace(regexp_replace(coalesce(text, ''), 'https?://\S+', '', 'g'), '\n{3,}', chr(10) || chr(10), 'g')")
SQL_CHAIN = f"""with {_SQL_CLEANED}, {SQL_GRAMS}, {SQL_LEFT},
f as (select m.doc_id, d.lang, k, case when m.doc_id in (select doc_id from over_top) or m.doc_id in (select doc_id from over_cov) then true else false end as grams, removed, {SQL_RW} as r
  from m join d using (doc_id) join cut using (doc_id)),
a as (select doc_id, k, list_concat(case when lang is distinct from 'en' then ['language'] else [] end, case when grams and not list_contains(r, 'repetition') then list_concat(r, ['repetition']) else r end,
  case when coalesce(removed > 0.05, false) or len(k) = 0 then ['word_removal_ratio'] else [] end) as r from f)"""


def _left(spark, sf_dir):
    """Documents with their measurements m and g, the lines k that the modifiers leave, and the reasons r."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars", R.cleaned(T.text_of("text")).alias("text"))
    d = R.measured(d).withColumn("g", repetition_shares("text")).withColumn("k", R.shortened(T.lines_of(F.col("text"))))
    removed = F.try_divide(F.col("m.n_words") - T.n_words(F.array_join("k", " ")), F.col("m.n_words"))
    emptied = F.coalesce(removed > 0.05, F.lit(False)) | (F.size("k") == 0)
    name = lambda c, n: F.when(c, F.array(F.lit(n))).otherwise(F.array().cast("array<string>"))
    gate = ~F.coalesce(F.col("lang") == "en", F.lit(False))
    return d.withColumn("r", F.concat(name(gate, "language"), R.reasons(R.REFINEDWEB_WHOLE), name(emptied, "word_removal_ratio")))


@query("rw_chain", f"{SQL_CHAIN} select doc_id, r[1] as reason, array_to_string(r, ',') as all_reasons, len(r) = 0 as kept, case when len(r) = 0 then md5(array_to_string(k, chr(10))) end as text_md5 from a")
def rw_chain(spark, sf_dir):
    """Language gate, text modifiers, page filters, line modifiers and the share of words they may remove. One map: the
    first reason is the verdict of the chain that stops early, all reasons that of the one that does not."""
    d = _left(spark, sf_dir)
    return d.select("doc_id", F.get("r", F.lit(0)).alias("reason"), F.array_join("r", ",").alias("all_reasons"), (F.size("r") == 0).alias("kept"), F.when(F.size("r") == 0, F.md5(F.array_join("k", "\n"))).alias("text_md5"))


@query("rw_length_only", "with w as (select len(list_filter(string_split_regex(coalesce(text, ''), '\\s+'), lambda x: x <> '')) as n from documents) select n between 60 and 90000 as kept, count(*) as n from w group by 1")
def rw_length_only(spark, sf_dir):
    """A stack read from a configuration: the length filter alone, with limits of its own."""
    rules = R.stack([{"func": "page_length_filter", "kwargs": {"min": 60, "max": 90000}}])
    m = R.measured(table(spark, sf_dir, "documents").select("text")).select((F.size(R.reasons(rules)) == 0).alias("kept"))
    return m.groupBy("kept").agg(F.count("*").alias("n"))


@query("gate_and_stacks", f"""{SQL_CHAIN}, p as (select doc_id, coalesce(lang = 'en', false) and n_chars >= 300 as pool, text from documents),
c as (select doc_id, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x, E' \\t\\r\\n')), lambda x: x <> '') as l, coalesce(text, '') as t from documents),
ck as (select doc_id, t, list_filter(l, lambda x: len(list_filter(string_split_regex(x, '\\s+'), lambda y: y <> '')) >= 3 and len(list_filter(string_split_regex(x, '\\s+'), lambda y: length(y) > 1000)) = 0 and not regexp_matches(lower(x), 'javascript|terms of use|privacy policy|cookie policy|uses cookies|use of cookies|use cookies')) as k from c),
cr as (select doc_id, case when contains(lower(t), 'lorem ipsum') then 'lorem_ipsum' when contains(t, '{{') then 'curly_bracket' when len(regexp_extract_all(array_to_string(k, chr(10)), '[.!?]+(\\s|$)')) < 5 then 'too_few_sentences' end as c4 from ck)
select pool, not list_contains(r, 'language') and not list_contains(r, 'page_length') as recomputed, len(r) = 0 as rw_kept, coalesce(c4, 'kept') as c4_reason, count(*) as n from a join p using (doc_id) join cr using (doc_id) group by all""")
def gate_and_stacks(spark, sf_dir):
    """Both stacks behind the pool's own gate, which decides; the gate worked out again is a diagnosis beside it."""
    d = _left(spark, sf_dir).select("doc_id", "r", (F.coalesce(F.col("lang") == "en", F.lit(False)) & (F.col("n_chars") >= 300)).alias("pool"))
    raw = table(spark, sf_dir, "documents").select("doc_id", T.text_of("text").alias("t"))
    c4 = raw.withColumn("k", R.c4_lines(T.lines_of(F.col("t")))).select("doc_id", F.coalesce(R.c4_page(F.col("t"), F.col("k")), F.lit("kept")).alias("c4_reason"))
    gate = ~F.array_contains("r", "language") & ~F.array_contains("r", "page_length")
    return d.join(c4, "doc_id").groupBy("pool", gate.alias("recomputed"), (F.size("r") == 0).alias("rw_kept"), "c4_reason").agg(F.count("*").alias("n"))


PAGE_RULES = [r for r in R.FINEWEB if r[0].startswith("gopher_rep")] + R.GOPHER_GRAMS + [r for r in R.FINEWEB if r[0].startswith("gopher_qual")]
REPETITION = [r for r in PAGE_RULES if r[0].startswith("gopher_rep")]
LAST_RULES = [r for r in R.FINEWEB if r[0].startswith("fineweb")]


@query("fw_chain")
def fw_chain(spark, sf_dir):
    """The second stack, from the extraction to the last line statistics. The repetition and quality checks see the text
    without blank lines, the last ones what the line rules leave of it; a page emptied by those is dropped, as is
    one whose ratios cannot be taken (error). `reason` stops early, `all_reasons` does not; `diag_raw` says whether the
    repetition checks would have dropped the text with its blank lines."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    # both texts have the same words, so n-grams are looked for once
    d = d.withColumn("dense", T.strip_blank_lines(T.text_of("text"))).withColumn("p", repetition_pairs("text", F.length("dense")))
    raw = R.measured(d).withColumn("g", F.col("p")).withColumn("diag", F.size(R.reasons(REPETITION)) > 0)
    other = F.struct(*[F.col(f"p.other_{f}").alias(f) for f in repetition.FIELDS])
    d = raw.select("doc_id", "lang", F.col("text").alias("raw"), F.col("dense").alias("text"), F.col("diag").alias("diag_raw"), other.alias("g"))
    d = R.measured(d).withColumn("a", R.reasons(PAGE_RULES))
    d = d.withColumn("k", R.c4_lines(T.lines_of(F.col("text")))).withColumn("c4", R.c4_page(F.col("text"), F.col("k"))).drop("m", "g")
    d = R.measured(d.withColumn("left", F.array_join("k", "\n")), "left")
    empty = F.col("left") == ""
    name = lambda c, n: F.when(c, F.array(n if isinstance(n, type(c)) else F.lit(n))).otherwise(F.array().cast("array<string>"))
    blank = F.col("raw").isNotNull() & (T.strip(T.text_of("raw")) == "")
    lang = ~F.coalesce(F.col("lang") == "en", F.lit(False))
    found = F.concat(name(F.col("raw").isNull(), "extract_failed"), name(blank, "extract_empty"), name(lang, F.concat(F.lit("lang_"), F.coalesce("lang", F.lit("None")))))
    last = F.when(empty, F.array(F.lit("empty_after_c4"), F.lit("error_ZeroDivisionError"))).otherwise(R.reasons(LAST_RULES))
    every = F.concat(found, "a", name(F.col("c4").isNotNull(), F.concat(F.lit("c4_"), "c4")), last)
    r = d.select("doc_id", every.alias("r"), "diag_raw")
    return r.select("doc_id", F.get("r", F.lit(0)).alias("reason"), F.array_join("r", ",").alias("all_reasons"), (F.size("r") == 0).alias("kept"), "diag_raw")
