"""Queries over the text functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.catalog import query
from millrace.functions import text as T
from millrace.sources.tables import table


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


@query("number_lines", r"""with l as (select doc_id, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x, E' \t\r\n')), lambda x: x <> '') as l from documents)
select doc_id, md5(array_to_string(list_transform(l, lambda x, i: '<lid:' || i || '> ' || x), chr(10))) as numbered_md5, md5(array_to_string(l, chr(10))) as stripped_md5 from l""")
def number_lines(spark, sf_dir):
    d = _docs(spark, sf_dir).withColumn("n", T.number_lines(T.text_of("text")))
    return d.select("doc_id", F.md5("n").alias("numbered_md5"), F.md5(T.strip_ids(F.col("n"))).alias("stripped_md5"))


@query("webkit_post", r"""with t as (select doc_id, regexp_replace(regexp_replace(regexp_replace(text || chr(10) || ' --| ' || chr(10) || 'a\*b||c', '\|+', ' ', 'g'), '(?m)^[ \t\-|]+$', '', 'g'), '\\([$*\[\]_`#])', '\1', 'g') as t from documents)
select doc_id, md5(array_to_string(list_filter(list_transform(string_split(t, chr(10)), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> ''), chr(10))) as text_md5 from t""")
def webkit_post(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.md5(T.webkit_post(F.concat("text", F.lit("\n --| \na\\*b||c")))).alias("text_md5"))


@query("markup_detector", r"select count_if(regexp_matches(html, '(?i)</\w+>|<\\/\w+>|<(div|span|nav|ul|li|table|tr|td)\b[^>]*>'))::bigint as n_markup, count(*) as n from pages")
def markup_detector(spark, sf_dir):
    return table(spark, sf_dir, "pages").agg(F.count_if(T.has_markup(F.col("html"))).alias("n_markup"), F.count("*").alias("n"))


@query("content_keys", r"select doc_id, md5(text) as md5, sha1(text) as sha1, sha256(text) as sha256, sha1(lower(left(trim(regexp_replace(text, '\s+', ' ', 'g')), 1500))) as dedup_key from documents")
def content_keys(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.md5("text").alias("md5"), F.sha1("text").alias("sha1"), F.sha2("text", 256).alias("sha256"), T.dedup_key(F.col("text")).alias("dedup_key"))


@query("clip_and_fit", r"""select doc_id, md5(case when length(text) > 500 then left(text, 500) || chr(10) || '[... truncated for length]' else text end) as clip_md5,
md5(case when length(text) > 1000 then left(text, 500) || '... ' || right(text, 500) else text end) as head_tail_md5,
case when strlen(text) + 2560 <= 4000 then length(text) else length(left(text, list_filter(list_transform(range(61), lambda k: cast(floor(length(text) * pow(0.8, k)) as int)), lambda m: strlen(left(text, m)) + 2560 <= 4000 or m < 500)[1])) end as fit_chars from documents""")
def clip_and_fit(spark, sf_dir):
    t = F.col("text")
    return _docs(spark, sf_dir).select("doc_id", F.md5(T.clip(t, 500)).alias("clip_md5"), F.md5(T.head_tail(t, 1000)).alias("head_tail_md5"), F.length(T.fit(t, 4000)).cast("long").alias("fit_chars"))


@query("chunk_stitch", r"""with c as (select doc_id, text, unnest(range(0, length(text), 700)) as s from documents), p as (select doc_id, s, text[s + 1:s + 700] as piece from c)
select doc_id, count(*) as n_chunks, max(length(piece)) as longest, md5(string_agg(piece, ' ' order by s)) as stitched_md5 from p group by doc_id""")
def chunk_stitch(spark, sf_dir):
    """Pieces of 700 characters, exploded to rows and stitched again in order."""
    p = _docs(spark, sf_dir).select("doc_id", F.posexplode(T.chunks(F.col("text"), 700)).alias("k", "piece"))
    parts = F.array_sort(F.collect_list(F.struct("k", "piece"))).getField("piece")
    return p.groupBy("doc_id").agg(F.count("*").alias("n_chunks"), F.max(F.length("piece")).cast("long").alias("longest"), F.md5(F.array_join(parts, " ")).alias("stitched_md5"))


@query("rewrite_cleaning", r"""with t as (select doc_id, case doc_id % 4 when 0 then 'I need to rephrase. </think> Here is a paraphrased version: ' || left(text, 300) when 1 then 'Okay, the user asks' || chr(10) || left(text, 100) || ' while ensuring clarity' when 2 then '--- ' || left(text, 200) || ' ---' else text end as t from documents),
c as (select doc_id, t, case doc_id % 4 when 0 then ltrim(left(text, 300), E' \n') when 2 then left(text, 200) || ' ---' else t end as b from t join documents using (doc_id))
select doc_id, md5(array_to_string(list_filter(list_transform(string_split(b, chr(10)), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> ''), chr(10))) as clean_md5,
array_to_string(list_filter([case when regexp_matches(t, '(?i)</?think>') then 'think_tag' end, case when regexp_matches(t, '(?i)your task is to read and paraphrase|delete clearly irrelevant content') then 'prompt_echo' end,
case when regexp_matches(t, '(?i)here is a paraphrased version') then 'answer_preamble' end, case when regexp_matches(t, '(?i)\bthis (paraphrased version|paraphrase) (retains|maintains|keeps|preserves)') then 'self_commentary' end,
case when regexp_matches(t, '(?i)\b(retains all relevant details|while ensuring clarity|adherence to the instructions)\b') then 'instr_compliance' end,
case when regexp_matches(t, '(?im)^\s*(?:(?:okay|alright)[,.]? the user\b|let me (?:reorganize|rephrase|paraphrase|rewrite) )') then 'narration_strict' end,
case when regexp_matches(t, '(?i)\b(the user wants|i need to (?:make sure|rephrase|paraphrase))\b') then 'needs_to' end], lambda x: x is not null), ',') as dirt from c""")
def rewrite_cleaning(spark, sf_dir):
    k = F.col("doc_id") % 4
    t = F.when(k == 0, F.concat(F.lit("I need to rephrase. </think> Here is a paraphrased version: "), F.left("text", F.lit(300)))).when(k == 1, F.concat(F.lit("Okay, the user asks\n"), F.left("text", F.lit(100)), F.lit(" while ensuring clarity"))).when(k == 2, F.concat(F.lit("--- "), F.left("text", F.lit(200)), F.lit(" ---"))).otherwise(F.col("text"))
    return _docs(spark, sf_dir).select("doc_id", t.alias("t")).select("doc_id", F.md5(T.clean_rewrite(F.col("t"))).alias("clean_md5"), F.array_join(T.rewrite_dirt(F.col("t")), ",").alias("dirt"))


@query("rewrite_cleaning_whole", r"""with t as (select doc_id, case doc_id % 4 when 0 then 'I need to rephrase. </think> Here is a paraphrased version: ' || text when 1 then 'Okay, the user asks' || chr(10) || text || ' while ensuring clarity' when 2 then '--- ' || text || ' ---' else text end as t from documents),
c as (select doc_id, t, case doc_id % 4 when 0 then ltrim(text, E' \n') when 2 then text || ' ---' else t end as b from t join documents using (doc_id))
select doc_id, md5(array_to_string(list_filter(list_transform(string_split(b, chr(10)), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> ''), chr(10))) as clean_md5,
array_to_string(list_filter([case when regexp_matches(t, '(?i)</?think>') then 'think_tag' end, case when regexp_matches(t, '(?i)your task is to read and paraphrase|delete clearly irrelevant content') then 'prompt_echo' end,
case when regexp_matches(t, '(?i)here is a paraphrased version') then 'answer_preamble' end, case when regexp_matches(t, '(?i)\bthis (paraphrased version|paraphrase) (retains|maintains|keeps|preserves)') then 'self_commentary' end,
case when regexp_matches(t, '(?i)\b(retains all relevant details|while ensuring clarity|adherence to the instructions)\b') then 'instr_compliance' end,
case when regexp_matches(t, '(?im)^\s*(?:(?:okay|alright)[,.]? the user\b|let me (?:reorganize|rephrase|paraphrase|rewrite) )') then 'narration_strict' end,
case when regexp_matches(t, '(?i)\b(the user wants|i need to (?:make sure|rephrase|paraphrase))\b') then 'needs_to' end], lambda x: x is not null), ',') as dirt from c""")
def rewrite_cleaning_whole(spark, sf_dir):
    """`rewrite_cleaning` with whole texts in the simulated preambles."""
    k = F.col("doc_id") % 4
    t = F.when(k == 0, F.concat(F.lit("I need to rephrase. </think> Here is a paraphrased version: "), "text")).when(k == 1, F.concat(F.lit("Okay, the user asks\n"), "text", F.lit(" while ensuring clarity"))).when(k == 2, F.concat(F.lit("--- "), "text", F.lit(" ---"))).otherwise(F.col("text"))
    return _docs(spark, sf_dir).select("doc_id", t.alias("t")).select("doc_id", F.md5(T.clean_rewrite(F.col("t"))).alias("clean_md5"), F.array_join(T.rewrite_dirt(F.col("t")), ",").alias("dirt"))


@query("word8_repetition", r"""with w as (select doc_id, list_filter(string_split_regex(lower(text), '\s+'), lambda x: x <> '') as w from documents), g as (select doc_id, len(w) as n, case when len(w) >= 40 then list_transform(range(1, len(w) - 6), lambda i: array_to_string(w[i:i + 7], ' ')) end as g from w)
select doc_id, 1 - len(list_distinct(g)) / len(g) as repetition, coalesce(1 - len(list_distinct(g)) / len(g) > 0.3, false) as looping from g""")
def word8_repetition(spark, sf_dir):
    d = T.with_repetition(_docs(spark, sf_dir).select("doc_id", "text"), "repetition", "text").drop("text")
    return d.withColumn("looping", F.coalesce(F.col("repetition") > 0.3, F.lit(False)))


@query("page_sites", r"select regexp_replace(regexp_extract(lower(url), '^[a-z]+://([^/:?#]+)', 1), '^www\.', '') as site, count(*) as n, sum(strlen(html))::bigint as bytes from pages group by 1")
def page_sites(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select(T.site(F.col("url")).alias("site"), F.octet_length("html").alias("b"))
    return p.groupBy("site").agg(F.count("*").alias("n"), F.sum("b").alias("bytes"))


@query("judge_parse", r"""with o as (select doc_id, 'noise {"value": ' || (doc_id % 6) || ', "verdict": "' || case when doc_id % 2 = 0 then 'keep' else 'remove' end || '"} assistantfinal {"value": ' || (doc_id % 5) || ', "verdict": "' || case when doc_id % 3 = 0 then 'keep' when doc_id % 3 = 1 then 'remove' else 'maybe' end || '"}' || case when doc_id % 7 = 0 then ' {broken' else '' end as o from documents)
select doc_id, case when doc_id % 3 < 2 and doc_id % 5 <= 3 then doc_id % 5 end as value, case when doc_id % 3 < 2 and doc_id % 5 <= 3 then case when doc_id % 3 = 0 then 'keep' else 'remove' end end as verdict from o""")
def judge_parse(spark, sf_dir):
    """The last valid JSON object of a judge's output, checked: value 0 to 3 and one of two verdicts."""
    k = F.col("doc_id")
    out = F.concat(F.lit('noise {"value": '), (k % 6).cast("string"), F.lit(', "verdict": "'), F.when(k % 2 == 0, F.lit("keep")).otherwise(F.lit("remove")), F.lit('"} assistantfinal {"value": '), (k % 5).cast("string"), F.lit(', "verdict": "'), F.when(k % 3 == 0, F.lit("keep")).when(k % 3 == 1, F.lit("remove")).otherwise(F.lit("maybe")), F.lit('"}'), F.when(k % 7 == 0, F.lit(" {broken")).otherwise(F.lit("")))
    d = _docs(spark, sf_dir).select("doc_id", F.element_at(F.split(out, "assistantfinal"), -1).alias("o"))
    objects = F.filter(F.regexp_extract_all("o", F.lit(r"(\{[^{}]*\})"), 1), lambda x: F.call_function("try_parse_json", x).isNotNull())
    j = d.withColumn("j", F.from_json(F.call_function("try_element_at", objects, F.lit(-1)), "value bigint, verdict string"))
    ok = F.col("j.value").between(0, 3) & F.col("j.verdict").isin("keep", "remove")
    return j.select("doc_id", F.when(ok, F.col("j.value")).alias("value"), F.when(ok, F.col("j.verdict")).alias("verdict"))


@query("universal_line_strip", r"select doc_id, md5(array_to_string(list_filter(string_split_regex(text, '\r\n|[\n\r\v\f]'), lambda x: trim(x, E' \t') <> ''), chr(10))) as text_md5 from documents")
def universal_line_strip(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.md5(T.strip_blank_lines(F.col("text"))).alias("text_md5"))


@query("chat_serialise", r"""with t as (select conv_id, turn, role, '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) as s from conversations)
select conv_id, md5(string_agg(s, '' order by turn, s)) as chat_md5, sum(case when role = 'assistant' then length(s) else 0 end)::bigint as supervised_chars, sum(case when role = 'assistant' then 0 else length(s) end)::bigint as masked_chars from t group by conv_id""")
def chat_serialise(spark, sf_dir):
    """Chat markup of each conversation, with the characters that a loss mask leaves and hides."""
    line = F.concat(F.lit("<|im_start|>"), "role", F.lit("\n"), "text", F.lit("<|im_end|>\n"))
    t = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", line.alias("s"))
    own = F.col("role") == "assistant"
    return t.groupBy("conv_id").agg(F.md5(F.array_join(F.array_sort(F.collect_list(F.struct("turn", "s"))).getField("s"), "")).alias("chat_md5"), F.sum(F.when(own, F.length("s")).otherwise(0)).alias("supervised_chars"), F.sum(F.when(own, 0).otherwise(F.length("s"))).alias("masked_chars"))
