"""The registered query of each operator, over whole tables, with DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return add


SQL_QUALITY = r"""
with w as (
  select doc_id, coalesce(text, '') as text,
         list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines
  from documents
),
g as (select doc_id, unnest(range(1, len(words) - 1)) as i, words from w where len(words) >= 3),
t as (select doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] as gram from g),
r as (select doc_id, i, count(*) over (partition by doc_id, gram) as n from t),
c as (select doc_id, count(distinct i + d) as n from r, (values (0), (1), (2)) v(d) where r.n > 1 group by doc_id),
m as (
  select w.doc_id, cast(len(words) as bigint) as n_words,
         cast(length(array_to_string(words, '')) as bigint) as word_chars,
         cast(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) as bigint) as n_symbols,
         cast(len(lines) as bigint) as n_lines,
         cast(len(lines) - len(list_distinct(lines)) as bigint) as n_dup_lines,
         cast(coalesce(c.n, 0) as bigint) as n_repeat_words
  from w left join c on w.doc_id = c.doc_id
),
b as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       not (base_failed or word_chars < 2 * n_words or word_chars > 20 * n_words or 2 * n_symbols > n_words
            or (2 * n_dup_lines > n_lines and n_lines >= 4)) as kept
from b
"""


@_query("op9_quality_rules", SQL_QUALITY)
def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm import quality

    judged = quality.apply_policy(quality.ledger(_table(spark, sf_dir, "documents")), "v1")
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@_query("op1_token_store")
def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm import token_store

    return token_store.encode_and_read(spark, _table(spark, sf_dir, "documents"))


@_query("op2_trie_bpe")
def op2_trie_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm import trie_bpe

    return trie_bpe.encode_decode(_table(spark, sf_dir, "documents"), full=False)


SQL_WARC = r"""
with p as (select page_id, coalesce(html, '') as t, sha1(coalesce(html, '')) as h from pages),
f as (select h, min(page_id) as first_id from p group by h)
select page_id, strlen(t)::bigint as payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    (((((strpos('0123456789abcdef', substr(h, (5 * i) // 4 + 1, 1)) - 1) * 16 + strpos('0123456789abcdef', substr(h, (5 * i) // 4 + 2, 1)) - 1) >> (3 - (5 * i) % 4)) & 31) + 1)::bigint, 1)), '') as payload_digest,
  case when page_id = first_id then 'response' else 'revisit' end as record_type,
  case when page_id = first_id then null else first_id end as refers_to
from p join f using (h)
"""


@_query("op3_warc", SQL_WARC)
def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm import warc

    return warc.archive_and_read(spark, _table(spark, sf_dir, "pages"))


@_query("op8_packing")
def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm import packing

    return packing.pack(packing.pieces(_table(spark, sf_dir, "documents")))


SQL_NEAR = r"""
with recursive w as (
  select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as words
  from documents
),
s as (
  select doc_id, unnest(case when len(words) = 0 then [] when len(words) < 5 then [array_to_string(words, ' ')]
    else list_distinct(list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' '))) end) as g
  from w
),
n as (select doc_id, count(*) as n from s group by doc_id),
p as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
e as (select p.a, p.b from p join n x on p.a = x.doc_id join n y on p.b = y.doc_id where 100 * c >= 75 * (x.n + y.n - c)),
u as (select a, b from e union all select b, a from e),
r(id, low) as (select doc_id, doc_id from w union select u.a, r.low from r join u on u.b = r.id),
m as (select id, min(low) as low from r group by id)
select w.doc_id, cast(coalesce(n.n, 0) as bigint) as n_shingles, m.low as component_id, w.doc_id = m.low as kept
from w join m on w.doc_id = m.id left join n on w.doc_id = n.doc_id
"""


@_query("op4_minhash", SQL_NEAR)
def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm import minhash

    return minhash.near_duplicates(_table(spark, sf_dir, "documents"))


SQL_CHAT = r"""
with p as (select *, row_number() over (partition by conv_id order by turn nulls first, role nulls first, text nulls first) as pos from conversations),
k as (select conv_id, pos, string_agg(md5(coalesce('r' || role, 'n') || chr(0) || coalesce('t' || text, 'n')), '' order by pos)
      over (partition by conv_id order by pos rows between unbounded preceding and current row) as h from p),
n as (select conv_id, max(pos) as n from p group by conv_id),
w as (select h, k.pos as n, min(k.conv_id) as conv_id, count(*) as n_copies from k join n on k.conv_id is not distinct from n.conv_id and k.pos = n.n group by 1, 2),
l as (select distinct h from k join n on k.conv_id is not distinct from n.conv_id and k.pos < n.n),
m as (select * from w where h not in (select h from l))
select m.conv_id, cast(m.n as bigint) as n_turns, m.n_copies,
       string_agg('<|im_start|>' || coalesce(role, 'unknown') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10), '' order by p.pos) as rendered
from m join p on p.conv_id is not distinct from m.conv_id group by m.conv_id, m.n, m.n_copies
"""


@_query("op6_chat_snapshots", SQL_CHAT)
def op6_chat_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm import chat

    return chat.rendered(_table(spark, sf_dir, "conversations"))


@_query("op5_ann")
def op5_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm import ann

    return ann.search(_table(spark, sf_dir, "embeddings"))


SQL_PHRASES = r"""
with w as (select doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as words from documents),
s as (select doc_id, unnest(range(1, len(words) - 18)) as p, words from w where len(words) >= 20),
k as (select doc_id, p, md5(array_to_string(words[p:p + 19], ' ')) as h from s),
r as (select doc_id, p from (select doc_id, p, row_number() over (partition by h order by doc_id, p) as n from k) where n > 1),
c as (select distinct doc_id, p + d as p from r, range(20) t(d)),
o as (select w.doc_id, len(words) as n_words, unnest(words) as word, unnest(range(1, len(words) + 1)) as p from w),
f as (select o.doc_id, string_agg(word, ' ' order by o.p) as kept, count(*) as n from o left join c on o.doc_id = c.doc_id and o.p = c.p where c.p is null group by 1)
select w.doc_id, cast(len(words) as bigint) as n_words, cast(len(words) - coalesce(f.n, 0) as bigint) as n_removed, sha256(coalesce(f.kept, '')) as kept_sha256
from w left join f on w.doc_id = f.doc_id
"""


@_query("op7_phrases", SQL_PHRASES)
def op7_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm import phrases

    return phrases.without_repeats(_table(spark, sf_dir, "documents"))


SQL_STRINGS = r"""
with b as (select doc_id, hex(encode(coalesce(text, ''))) as h, strlen(coalesce(text, '')) as n from documents),
w as (select doc_id, unnest(range(0, n - 49)) as p, h from b where n >= 50),
k as (select doc_id, p, md5(substr(h, 2 * p + 1, 100)) as g from w),
f as (select g, min(doc_id) as first_id from k group by g having count(*) > 1),
r as (select k.doc_id, k.p from k join f on k.g = f.g where k.doc_id > f.first_id),
l as (select *, lag(p) over (partition by doc_id order by p) as prev from r),
i as (select *, sum(case when prev is null or p > prev + 50 then 1 else 0 end) over (partition by doc_id order by p rows unbounded preceding) as span from l),
s as (select doc_id, min(p) as a, max(p) + 50 as e from i group by doc_id, span),
t as (select doc_id, a, e, coalesce(lag(e) over (partition by doc_id order by a), 0) as from_e from s),
c as (select t.doc_id, count(*) as n_spans, sum(e - a) as n_removed, string_agg(substr(h, 2 * from_e + 1, 2 * (a - from_e)), '' order by a) || substr(any_value(h), 2 * max(e) + 1) as kept from t join b on t.doc_id = b.doc_id group by t.doc_id)
select b.doc_id, b.n::bigint as n_bytes, coalesce(c.n_removed, 0)::bigint as n_removed, coalesce(c.n_spans, 0)::bigint as n_spans, sha256(unhex(coalesce(c.kept, b.h))) as kept_sha256
from b left join c on b.doc_id = c.doc_id
"""


@_query("op10_suffix_array", SQL_STRINGS)
def op10_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm import suffix

    return suffix.without_repeats(_table(spark, sf_dir, "documents"))
