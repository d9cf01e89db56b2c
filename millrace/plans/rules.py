"""Queries over the rule stacks."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.catalog import query
from millrace.functions import rules as R
from millrace.functions import text as T
from millrace.sources.tables import table

SQL_M = r"""
d as (select doc_id, source, lang, coalesce(text, '') as t,
  list_filter(string_split_regex(coalesce(text, ''), '\s+'), lambda x: x <> '') as w,
  list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x, E' \t\r\n')), lambda x: x <> '') as l,
  list_filter(list_transform(string_split_regex(coalesce(text, ''), '\n{2,}'), lambda x: trim(x, E' \t\r\n')), lambda x: x <> '') as p from documents),
m as (select doc_id, source, t, l, w, len(w) as n_words,
  case when len(w) > 0 then length(array_to_string(w, '')) / len(w) else 0 end as mean_word,
  case when len(w) > 0 then len(regexp_extract_all(t, '#|\.\.\.|…')) / len(w) else 0 end as symbol_ratio,
  case when len(l) > 0 then len(list_filter(l, lambda x: strpos('•‣►-*', left(x, 1)) > 0)) / len(l) else 0 end as bullet_ratio,
  case when len(l) > 0 then len(list_filter(l, lambda x: regexp_matches(x, '(\.\.\.|…)$'))) / len(l) else 0 end as ellipsis_ratio,
  case when len(w) > 0 then len(list_filter(w, lambda x: regexp_matches(x, '\p{L}'))) / len(w) else 0 end as alpha_ratio,
  len(list_filter(w, lambda x: lower(x) in ('the', 'be', 'to', 'of', 'and', 'that', 'have', 'with'))) as stop_words,
  len(list_filter(['the', 'be', 'to', 'of', 'and', 'that', 'have', 'with'], lambda x: list_contains(w, x))) as stop_distinct,
  case when len(l) > 0 then 1 - len(list_distinct(l)) / len(l) else 0 end as dup_line,
  case when len(p) > 0 then 1 - len(list_distinct(p)) / len(p) else 0 end as dup_para,
  case when length(t) > 0 then (length(array_to_string(l, '')) - length(array_to_string(list_distinct(l), ''))) / length(t) else 0 end as dup_line_chars,
  case when length(t) > 0 then (length(array_to_string(p, '')) - length(array_to_string(list_distinct(p), ''))) / length(t) else 0 end as dup_para_chars,
  case when len(l) > 0 then len(list_filter(l, lambda x: regexp_matches(x, '[.!?"”]$'))) / len(l) else 0 end as punct_lines,
  case when len(l) > 0 then len(list_filter(l, lambda x: length(x) <= 30)) / len(l) else 0 end as short_lines,
  case when len(w) > 0 then (length(t) - length(replace(t, chr(10), ''))) / len(w) else 0 end as newline_ratio from d)
"""


#: The rules that fire, written out: limits here are not those of the code under test.
SQL_RW = """list_filter([case when n_words < 50 or n_words > 100000 then 'page_length' end, case when mean_word < 3 or mean_word > 10 then 'word_length' end,
 case when symbol_ratio > 0.1 then 'symbol_ratio' end, case when bullet_ratio > 0.9 then 'bullet_count' end, case when ellipsis_ratio > 0.3 then 'ellipsis_count' end,
 case when alpha_ratio < 0.8 then 'alphabetic_ratio' end, case when stop_words < 2 then 'stop_words' end,
 case when dup_line > 0.3 or dup_para > 0.3 or dup_line_chars > 0.2 or dup_para_chars > 0.2 then 'repetition' end], lambda x: x is not null)"""
SQL_FW = """list_filter([case when dup_para > 0.3 then 'gopher_rep_dup_para_frac' end, case when dup_para_chars > 0.2 then 'gopher_rep_dup_para_char_frac' end,
 case when dup_line > 0.3 then 'gopher_rep_dup_line_frac' end, case when dup_line_chars > 0.2 then 'gopher_rep_dup_line_char_frac' end,
 case when n_words < 50 then 'gopher_qual_gopher_short_doc' end, case when n_words > 100000 then 'gopher_qual_gopher_long_doc' end,
 case when mean_word < 3 or mean_word > 10 then 'gopher_qual_mean_word' end, case when symbol_ratio > 0.1 then 'gopher_qual_symbol_ratio' end,
 case when bullet_ratio > 0.9 then 'gopher_qual_bullets' end, case when ellipsis_ratio > 0.3 then 'gopher_qual_ellipses' end,
 case when alpha_ratio < 0.8 then 'gopher_qual_gopher_below_alpha_threshold' end, case when stop_distinct < 2 then 'gopher_qual_stop_words' end,
 case when punct_lines < 0.12 then 'fineweb_line_punct_ratio' end, case when short_lines > 0.67 then 'fineweb_short_line_ratio' end,
 case when dup_line_chars > 0.01 then 'fineweb_char_dup_ratio' end, case when newline_ratio > 0.3 then 'fineweb_list_ratio' end], lambda x: x is not null)"""


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "source", "text")


@query("rw_rule_reasons", f"with {SQL_M}, r as (select doc_id, {SQL_RW} as r from m) select doc_id, array_to_string(r, ',') as reasons, r[1] as first_reason, len(r) = 0 as none_fired from r")
def rw_rule_reasons(spark, sf_dir):
    """The filters that are Column expressions; `rw_chain` has the whole stack and the verdict."""
    r = R.measured(_docs(spark, sf_dir)).select("doc_id", R.reasons(R.REFINEDWEB).alias("r"))
    return r.select("doc_id", F.array_join("r", ",").alias("reasons"), F.get("r", F.lit(0)).alias("first_reason"), (F.size("r") == 0).alias("none_fired"))


@query("rw_first_reason_hist", f"with {SQL_M}, r as (select {SQL_RW}[1] as reason from m) select coalesce(reason, 'kept') as reason, count(*) as n from r group by 1")
def rw_first_reason_hist(spark, sf_dir):
    r = R.measured(_docs(spark, sf_dir)).select(F.coalesce(F.get(R.reasons(R.REFINEDWEB), F.lit(0)), F.lit("kept")).alias("reason"))
    return r.groupBy("reason").agg(F.count("*").alias("n"))


@query("fw_rule_flags", f"with {SQL_M}, r as (select doc_id, {SQL_FW} as r from m) select doc_id, array_to_string(r, ',') as reasons, r[1] as first_reason, len(r) = 0 as none_fired from r")
def fw_rule_flags(spark, sf_dir):
    """The checks that are Column expressions; `fw_chain` has the whole stack and the verdict."""
    r = R.measured(_docs(spark, sf_dir)).select("doc_id", R.reasons(R.FINEWEB).alias("r"))
    return r.select("doc_id", F.array_join("r", ",").alias("reasons"), F.get("r", F.lit(0)).alias("first_reason"), (F.size("r") == 0).alias("none_fired"))


@query("fw_all_rules_hist", f"with {SQL_M}, r as (select unnest({SQL_FW}) as reason from m) select reason, count(*) as n from r group by 1")
def fw_all_rules_hist(spark, sf_dir):
    r = R.measured(_docs(spark, sf_dir)).select(F.explode(R.reasons(R.FINEWEB)).alias("reason"))
    return r.groupBy("reason").agg(F.count("*").alias("n"))


@query("rw_line_modifiers", rf"""with {SQL_M}, k as (select doc_id, n_words, list_filter(l, lambda x: length(regexp_replace(x, '[^A-Z]', '', 'g')) <= 0.5 * length(x) and length(regexp_replace(x, '[^0-9]', '', 'g')) <= 0.999999 * length(regexp_replace(x, '\s', '', 'g'))
  and not regexp_matches(x, '{R.COUNTER}') and len(list_filter(string_split_regex(x, '\s+'), lambda y: y <> '')) >= 2) as k from m)
select doc_id, md5(array_to_string(k, chr(10))) as text_md5, len(k)::bigint as n_lines, n_words > 0 and (n_words - len(list_filter(string_split_regex(array_to_string(k, ' '), '\s+'), lambda y: y <> ''))) / n_words > 0.05 as too_much_removed from k""")
def rw_line_modifiers(spark, sf_dir):
    d = _docs(spark, sf_dir).withColumn("l", T.lines_of(T.text_of("text"))).withColumn("n", T.n_words(T.text_of("text")))
    d = d.withColumn("k", R.modified_lines(F.col("l"))).withColumn("left", T.n_words(F.array_join("k", " ")))
    return d.select("doc_id", F.md5(F.array_join("k", "\n")).alias("text_md5"), F.size("k").cast("long").alias("n_lines"), F.coalesce((F.col("n") > 0) & (F.try_divide(F.col("n") - F.col("left"), "n") > 0.05), F.lit(False)).alias("too_much_removed"))


@query("c4_line_filter", rf"""with {SQL_M}, k as (select doc_id, t, list_filter(l, lambda x: len(list_filter(string_split_regex(x, '\s+'), lambda y: y <> '')) >= 3 and len(list_filter(string_split_regex(x, '\s+'), lambda y: length(y) > 1000)) = 0
  and not regexp_matches(lower(x), 'javascript|{'|'.join(R.POLICY)}')) as k from m)
select doc_id, md5(array_to_string(k, chr(10))) as text_md5, case when contains(lower(t), 'lorem ipsum') then 'lorem_ipsum' when contains(t, '{{') then 'curly_bracket' when len(regexp_extract_all(array_to_string(k, chr(10)), '[.!?]+(\s|$)')) < 5 then 'too_few_sentences' end as reason from k""")
def c4_line_filter(spark, sf_dir):
    d = _docs(spark, sf_dir).withColumn("k", R.c4_lines(T.lines_of(T.text_of("text"))))
    return d.select("doc_id", F.md5(F.array_join("k", "\n")).alias("text_md5"), R.c4_page(T.text_of("text"), F.col("k")).alias("reason"))


BANNED = {"domains": ["example.com", "spam.example.org"], "strict": ["casino", "xxx"], "hard": ["porn", "poker"], "soft": ["news", "blog", "page", "item"]}


@query("url_filter_counts", r"""with u as (select lower(url) as url, regexp_replace(regexp_extract(lower(url), '^[a-z]+://([^/:?#]+)', 1), '^www\.', '') as host from pages),
w as (select *, list_distinct(regexp_extract_all(url, '([a-z]+)', 1)) as w, regexp_replace(url, '[-._]', '', 'g') as flat from u)
select coalesce(case when host in ('example.com', 'spam.example.org') then 'url_domain' when contains(flat, 'casino') or contains(flat, 'xxx') then 'url_strict' when len(list_intersect(w, ['porn', 'poker'])) > 0 then 'url_hard'
 when len(list_intersect(w, ['news', 'blog', 'page', 'item'])) >= 2 then 'url_soft' end, 'kept') as reason, count(*) as n from w group by 1""")
def url_filter_counts(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select(F.coalesce(R.url_reason(F.col("url"), **BANNED), F.lit("kept")).alias("reason"))
    return p.groupBy("reason").agg(F.count("*").alias("n"))


@query("within_page_line_dedup", r"with l as (select doc_id, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x, E' \t\r\n')), lambda x: x <> '') as l from documents), u as (select doc_id, unnest(l) as x, unnest(range(len(l))) as i from l), f as (select doc_id, x, min(i) as i from u group by 1, 2) select doc_id, count(*) as n_lines, md5(string_agg(x, chr(10) order by i)) as text_md5 from f group by 1")
def within_page_line_dedup(spark, sf_dir):
    d = _docs(spark, sf_dir).withColumn("l", F.array_distinct(T.lines_of(T.text_of("text"))))
    return d.select("doc_id", F.size("l").cast("long").alias("n_lines"), F.md5(F.array_join("l", "\n")).alias("text_md5")).where("n_lines > 0")


@query("fw_repetition_hist")
def fw_repetition_hist(spark, sf_dir):
    """Documents that each n-gram repetition check fires for."""
    from millrace.functions.repetition import repetition_reasons

    r = _docs(spark, sf_dir).select(F.explode(repetition_reasons("text")).alias("reason"))
    return r.groupBy("reason").agg(F.count("*").alias("n"))


@query("substring_line_modifier", r"""with m as (select doc_id, list_transform(list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x, E' \t\r')), lambda x: x <> ''),
 lambda x: case when len(list_filter(string_split_regex(x, '\s+'), lambda y: y <> '')) <= 10 then regexp_replace(regexp_replace(regexp_replace(x, 'items in cart', '', 'gi'), '(?i)Read more\.\.\.$', ''), '^(?i)Sign-in', '') else x end) as l from documents) select doc_id, md5(array_to_string(l, chr(10))) as text_md5 from m""")
def substring_line_modifier(spark, sf_dir):
    d = _docs(spark, sf_dir).select("doc_id", F.transform(T.lines_of(T.text_of("text")), R.without_substrings).alias("l"))
    return d.select("doc_id", F.md5(F.array_join("l", "\n")).alias("text_md5"))
