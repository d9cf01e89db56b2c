"""Edit programs: reading them and applying them to numbered pages, as Column expressions.

A program is a decision (keep, edit, delete, rewrite), an <extract> block of line removals, the decision again and a
payload. Lines are numbered by position. `rm a[-b]` removes lines, `sub n: "s"` removes the first occurrence of s in
line n; ranges that are reversed or reach past the page do nothing there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import collapse, lines_of, settled, strip, text_of

OP = r"^(rm \d+(-\d+)?|sub \d+: [^\n]*)$"
TAGS = {"<keep>": "<extract>", "<edit>": "<refine>", "<delete>": "<delete>", "<rewrite>": "<rewrite>"}
_JSON_STRING = r'^"([^"\\\x00-\x1f]|\\(["\\/bfnrt]|u[0-9a-fA-F]{4}))*"$'


def op_lines(block: Column) -> Column:
    return F.filter(F.transform(block, strip), lambda x: x.rlike(OP))


def _ranges(ops: Column) -> Column:
    rm = F.filter(ops, lambda x: x.startswith("rm "))

    def one(x):
        a = F.regexp_extract(x, r"^rm (\d+)", 1).try_cast("bigint")
        b = F.regexp_extract(x, r"^rm \d+-(\d+)$", 1)
        return F.struct(a.alias("a"), F.when(b == "", a).otherwise(b.try_cast("bigint")).alias("b"))

    return F.transform(rm, one)


def _literal(x: Column) -> Column:
    """The string a sub names: a JSON string, or the text without quotes at its ends. Null for other JSON values."""
    lit = strip(x)
    decoded = F.from_json(F.concat(F.lit('{"v":'), lit, F.lit("}")), "v string").getField("v")
    other = F.call_function("try_parse_json", lit).isNotNull()
    return F.when(lit.rlike(_JSON_STRING), decoded).when(other & ~lit.startswith('"'), F.lit(None).cast("string")).otherwise(F.regexp_replace(x, r'^"+|"+$', ""))


def _subs(ops: Column) -> Column:
    sub = F.filter(ops, lambda x: x.startswith("sub "))
    return F.transform(sub, lambda x: F.struct(F.regexp_extract(x, r"^sub (\d+): ", 1).try_cast("bigint").alias("line"), _literal(F.regexp_extract(x, r"^sub \d+: ([^\n]*)$", 1)).alias("s")))


def _drop_first(line: Column, s: Column) -> Column:
    at = F.call_function("locate", s, line)
    return F.when((s == "") | (at == 0), line).otherwise(F.concat(F.substring(line, F.lit(1), at - 1), F.substring(line, at + F.length(s), F.length(line))))


def apply_ops(src: Column, ranges: Column, subs: Column, plain: Column) -> Column:
    """Lines of `src` after the operations, joined by line feeds; empty lines go. `plain` has the lines collapsed: what
    those that lose no string become."""

    def edited(x, i):
        mine = F.filter(subs, lambda s: s.getField("line") == i + 1)
        cut = F.aggregate(mine, x, lambda acc, s: _drop_first(acc, s.getField("s")))
        gone = F.exists(ranges, lambda r: (i + 1 >= r.getField("a")) & (i + 1 <= r.getField("b")))
        return F.when(gone, F.lit("")).when(F.size(mine) == 0, F.get(plain, i)).otherwise(collapse(cut))

    return F.array_join(F.filter(F.transform(src, edited), lambda x: x != ""), "\n")


def read(df: DataFrame, program: str = "program", decision_first: bool = True) -> DataFrame:
    """Adds _decision (null if the first line is none), _ops1, _tag2 and _rest (arrays of lines). Without
    `decision_first` the first line is never taken for the decision."""
    tags = [F.lit(t) for t in TAGS]
    d = df.withColumn("_lines", F.split(strip(text_of(program)), "\n"))
    d = d.withColumn("_lead", strip(F.get("_lines", F.lit(0))))
    d = d.withColumn("_decision", F.when(F.lit(decision_first) & F.col("_lead").isin(*TAGS), F.col("_lead")))
    d = d.withColumn("_staged", F.when(F.col("_decision").isNull(), F.col("_lines")).otherwise(F.split(strip(F.array_join(F.slice("_lines", F.lit(2), F.size("_lines")), "\n")), "\n")))
    start = F.when(strip(F.get("_staged", F.lit(0))) == "<extract>", F.lit(1)).otherwise(F.lit(0))
    stop = F.filter(F.sequence(F.lit(0), F.size("_staged")), lambda i: (i >= start) & ((i >= F.size("_staged")) | (start == 0) | ~((strip(F.get("_staged", i)) == "") | strip(F.get("_staged", i)).rlike(OP))))
    d = d.withColumn("_i", F.get(stop, F.lit(0)))
    d = d.withColumn("_ops1", F.when(F.col("_i") > 1, op_lines(F.slice("_staged", F.lit(2), F.col("_i") - 1))).otherwise(F.array().cast("array<string>")))
    d = d.withColumn("_tag2", F.when(F.col("_i") >= F.size("_staged"), F.lit("<keep>")).otherwise(strip(F.get("_staged", "_i"))))
    d = d.withColumn("_rest", F.when(F.col("_i") >= F.size("_staged"), F.array().cast("array<string>")).otherwise(F.slice("_staged", F.col("_i") + 2, F.size("_staged"))))
    known = F.array_contains(F.array(*tags), F.col("_tag2"))
    # a second tag that is missing belongs to the payload
    return d.withColumn("_rest", F.when(F.col("_decision").isNotNull() & ~known & (F.col("_tag2") != ""), F.concat(F.array("_tag2"), "_rest")).otherwise(F.col("_rest")))


def execute(df: DataFrame, page: str = "page", program: str = "program", decision_first: bool = True, drop_extract: bool = False) -> DataFrame:
    """Adds tag, final, extracted, op_class and parse_fail to rows with a numbered page and its program. With
    `drop_extract` the extract block does nothing; parse_fail is still that of the program as it is."""
    d = read(df, program, decision_first).withColumn("_src", F.transform(lines_of(text_of(page)), lambda x: F.regexp_replace(x, r"^<lid:\d+> ?", "")))
    d = d.withColumn("_act", F.coalesce("_decision", "_tag2"))
    d = d.withColumn("_body", F.filter(F.transform("_rest", strip), lambda x: x != ""))
    d = d.withColumn("_is_ops", (F.size("_body") > 0) & F.forall("_body", lambda x: x.rlike(OP)))
    d = d.withColumn("_r1", _ranges(F.col("_ops1"))).withColumn("_s1", _subs(F.col("_ops1")))
    d = d.withColumn("_r2", F.when(F.col("_is_ops"), _ranges(F.col("_body"))).otherwise(F.array().cast("array<struct<a:bigint,b:bigint>>")))
    d = d.withColumn("_s2", F.when(F.col("_is_ops"), _subs(F.col("_body"))).otherwise(F.array().cast("array<struct<line:bigint,s:string>>")))
    r1, s1 = (F.array().cast("array<struct<a:bigint,b:bigint>>"), F.array().cast("array<struct<line:bigint,s:string>>")) if drop_extract else (F.col("_r1"), F.col("_s1"))
    d = d.withColumn("_plain", F.transform("_src", collapse))
    d = d.withColumn("extracted", apply_ops(F.col("_src"), r1, s1, F.col("_plain")))
    edited = F.when(F.size("_r2") + F.size("_s2") == 0, F.col("extracted")).otherwise(apply_ops(F.col("_src"), F.concat(r1, "_r2"), F.concat(s1, "_s2"), F.col("_plain")))
    d = d.withColumn("_edited", edited)
    literal = strip(F.array_join("_rest", "\n"))
    act = F.col("_act")
    d = d.withColumn("tag", F.when(act == "<keep>", F.lit("<extract>")).when(act == "<edit>", F.lit("<refine>")).otherwise(act))
    d = d.withColumn("final", F.when(act == "<delete>", F.lit("")).when(act == "<keep>", F.col("extracted")).when((act == "<edit>") & F.col("_is_ops"), F.col("_edited")).otherwise(literal))
    live = F.exists(F.concat("_s1", F.when(act == "<edit>", F.col("_s2")).otherwise(F.array().cast("array<struct<line:bigint,s:string>>"))), lambda s: s.getField("s").isNull() & (s.getField("line") >= 1) & (s.getField("line") <= F.size("_src")))
    d = d.withColumn("parse_fail", live)
    n_sub = F.size(F.filter("_body", lambda x: x.startswith("sub ")))
    kind = F.when(F.size("_body") == 0, F.lit("edit: empty payload")).when(~F.col("_is_ops"), F.lit("edit: full-text fallback")).when(n_sub == 0, F.lit("edit: lines only")).when(n_sub == F.size("_body"), F.lit("edit: strings only")).otherwise(F.lit("edit: lines + strings"))
    kind = F.when((F.size("_body") > 0) & (collapse(F.col("final")) == collapse(F.col("extracted"))), F.lit("edit, no effective change")).otherwise(kind)
    d = d.withColumn("op_class", F.when(F.col("_decision").isNull(), F.lit("omitted")).when(act == "<edit>", kind).otherwise(F.regexp_replace(act, "[<>]", "")))
    made = {"tag", "final", "extracted", "op_class", "parse_fail"}
    return d.select(*[settled(F.col(c)).alias(c) if c in made else c for c in d.columns if not c.startswith("_")])


def emitted(tag: Column, final: Column) -> Column:
    return (tag != "<delete>") & (strip(final) != "")


#: Post-filter (fixed patterns and tags).
OP_LINE = r"(?m)^(rm \d+(-\d+)?(:\d+)?|sub \d+: )"
BAD_STARTS = ["<extract>", "<edit>", "<delete>", "<keep>"]
EMITTED_TAGS = ["<extract>", "<refine>", "<rewrite>"]
BARE_TAGS = ["<extract>", "<refine>", "<rewrite>", "<delete>", "<edit>"]


def postfilter(text: Column, tag: Column) -> Column:
    """The names of the post-filter rules that a document breaks: A2 leaked operations, A3 tag, A5 a bare tag line."""
    lead = F.lit(False)
    for t in BAD_STARTS:
        lead = lead | strip(text).startswith(t)
    a2 = (F.regexp_count(text, F.lit(OP_LINE)) >= 2) | (lead & (F.length(text) < 200))
    a3 = ~F.coalesce(tag.isin(*EMITTED_TAGS), F.lit(False))
    a5 = F.exists(F.split(text, "\n"), lambda x: strip(x).isin(*BARE_TAGS))
    return F.filter(F.array(F.when(a2, F.lit("A2")), F.when(a3, F.lit("A3")), F.when(a5, F.lit("A5"))), lambda x: x.isNotNull())


def merged_ranges(ids: Column) -> Column:
    """`rm a[-b]` lines for ascending line numbers, consecutive ones merged."""
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(None).cast("bigint").alias("a"), F.lit(None).cast("bigint").alias("b"))
    line = lambda s: F.when(s.getField("a") == s.getField("b"), F.concat(F.lit("rm "), s.getField("a").cast("string"))).otherwise(F.concat(F.lit("rm "), s.getField("a").cast("string"), F.lit("-"), s.getField("b").cast("string")))

    def step(s, x):
        x = x.cast("bigint")
        grow = s.getField("b") + 1 == x
        return F.when(grow, F.struct(s.getField("out").alias("out"), s.getField("a").alias("a"), x.alias("b"))).otherwise(F.struct(F.when(s.getField("a").isNull(), s.getField("out")).otherwise(F.concat(s.getField("out"), F.array(line(s)))).alias("out"), x.alias("a"), x.alias("b")))

    return F.aggregate(F.array_sort(ids), start, step, lambda s: F.when(s.getField("a").isNull(), s.getField("out")).otherwise(F.concat(s.getField("out"), F.array(line(s)))))


def without_clean_head(program: Column) -> Column:
    """A three-way head's <clean> defers to the program behind it."""
    return F.regexp_replace(program, r"\A\s*<clean>[^\S\n]*\n", "")


def without_echo(program: Column) -> Column:
    """Drops the block of echoed text between the extract block and the decision."""
    return F.regexp_replace(program, r"(?s)\A(<extract>(?:\n(?:rm \d+(?:-\d+)?|sub \d+: [^\n]*|[^\S\n]*))*)\n<text>(?:\n.*?)??(?=\n(?:<keep>|<edit>|<delete>|<rewrite>)[^\S\n]*(?:\n|\z)|\z)", "$1")


def untagged(text: Column) -> Column:
    """Plain text of a tagged one: the leading tag goes; a deleted page is empty."""
    lead = F.lower(F.regexp_extract(text, r"(?i)\A\s*<(extract|refine|delete|rewrite)>", 1))
    return F.when(lead == "delete", F.lit("")).otherwise(strip(F.regexp_replace(text, r"(?i)\A\s*<(extract|refine|delete|rewrite)>", "")))


CALLS = ["keep_all", "remove_all", "remove_lines", "replace_str", "add_line"]


def call_counts(program: Column) -> Column:
    return F.struct(*[F.regexp_count(program, F.lit(rf"\b{c}\s*\(")).cast("long").alias(c) for c in CALLS])


def call_class(program: Column) -> Column:
    """delete, keep, the kinds of edit, or other, by the set of calls."""
    names = F.array_distinct(F.regexp_extract_all(program, F.lit(r"\b(keep_all|remove_all|remove_lines|replace_str|add_line)\s*\("), 1))
    has = lambda c: F.array_contains(names, c)
    kind = F.when(has("remove_lines") & has("replace_str"), F.lit("edit: lines + strings")).when(has("remove_lines"), F.lit("edit: lines only")).when(has("replace_str"), F.lit("edit: strings only"))
    return F.when(has("remove_all"), F.lit("delete")).when(kind.isNotNull(), kind).when(has("keep_all"), F.lit("keep")).otherwise(F.lit("other"))
