"""Heuristic page rules as Column expressions over a shared set of measurements, which are taken in Arrow batches.

Each rule is a name and a failing predicate; `reasons` evaluates all of them in one pass, so the first reason (early
stop) and all reasons come from the same array. Parameters are fixed values of the published rule sets.
"""

from __future__ import annotations

import re
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from millrace.functions import repetition
from millrace.functions import text as T

STOP_WORDS = frozenset(["the", "be", "to", "of", "and", "that", "have", "with"])
BULLETS = "•‣►-*"


def _dup_share(items: list[str], distinct: set[str]) -> float:
    return 1 - len(distinct) / len(items) if items else 0.0


def _dup_chars(items: list[str], distinct: set[str], n_chars: int) -> float:
    return (sum(map(len, items)) - sum(map(len, distinct))) / n_chars if n_chars else 0.0


def measures(t: str) -> tuple:
    """The measurements of a page, in the order of MEASURES."""
    counts = Counter(t.split())
    lines = [x for x in map(str.strip, t.split("\n")) if x]
    paras = [x for x in map(str.strip, re.split("\n{2,}", t)) if x]
    n, own_lines, own_paras = counts.total(), set(lines), set(paras)
    per_word = lambda x: x / n if n else 0.0
    per_line = lambda x: x / len(lines) if lines else 0.0
    return (
        n,
        per_word(sum(len(w) * k for w, k in counts.items())),
        per_word(t.count("#") + t.count("...") + t.count("…")),
        per_line(sum(x[0] in BULLETS for x in lines)),
        per_line(sum(x.endswith(("...", "…")) for x in lines)),
        per_word(sum(k for w, k in counts.items() if w[0].isalpha() or w.isalpha() or any(map(str.isalpha, w)))),
        sum(k for w, k in counts.items() if w.lower() in STOP_WORDS),
        sum(w in counts for w in STOP_WORDS),
        _dup_share(lines, own_lines),
        _dup_share(paras, own_paras),
        _dup_chars(lines, own_lines, len(t)),
        _dup_chars(paras, own_paras, len(t)),
        per_line(sum(x[-1] in '.!?"”' for x in lines)),
        per_line(sum(len(x) <= 30 for x in lines)),
        per_word(t.count("\n")),
    )


MEASURES = {
    "n_words": LongType(), "mean_word": DoubleType(), "symbol_ratio": DoubleType(), "bullet_ratio": DoubleType(), "ellipsis_ratio": DoubleType(), "alpha_ratio": DoubleType(),
    "stop_words": LongType(), "stop_distinct": LongType(), "dup_line": DoubleType(), "dup_para": DoubleType(), "dup_line_chars": DoubleType(), "dup_para_chars": DoubleType(),
    "punct_lines": DoubleType(), "short_lines": DoubleType(), "newline_ratio": DoubleType(),
}


def _measures(text: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([measures(t or "") for t in text], columns=list(MEASURES))


#: Not deterministic for the optimizer, which else copies the call into filters and into every rule that reads a field.
_measured = F.pandas_udf(_measures, StructType([StructField(n, kind) for n, kind in MEASURES.items()])).asNondeterministic()


def measured(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds m, a struct of page measurements, worked out once a page in Arrow batches: words are counted by kind, and a
    pattern over a whole text costs several times as much in Catalyst, as does every rule that asks for it again."""
    return df.withColumn("m", _measured(text))


REFINEDWEB = [
    ("page_length", "m.n_words < 50 or m.n_words > 100000"),
    ("word_length", "m.mean_word < 3 or m.mean_word > 10"),
    ("symbol_ratio", "m.symbol_ratio > 0.1"),
    ("bullet_count", "m.bullet_ratio > 0.9"),
    ("ellipsis_count", "m.ellipsis_ratio > 0.3"),
    ("alphabetic_ratio", "m.alpha_ratio < 0.8"),
    ("stop_words", "m.stop_words < 2"),
    ("repetition", "m.dup_line > 0.3 or m.dup_para > 0.3 or m.dup_line_chars > 0.2 or m.dup_para_chars > 0.2"),
]
FINEWEB = [
    ("gopher_rep_dup_para_frac", "m.dup_para > 0.3"),
    ("gopher_rep_dup_para_char_frac", "m.dup_para_chars > 0.2"),
    ("gopher_rep_dup_line_frac", "m.dup_line > 0.3"),
    ("gopher_rep_dup_line_char_frac", "m.dup_line_chars > 0.2"),
    ("gopher_qual_gopher_short_doc", "m.n_words < 50"),
    ("gopher_qual_gopher_long_doc", "m.n_words > 100000"),
    ("gopher_qual_mean_word", "m.mean_word < 3 or m.mean_word > 10"),
    ("gopher_qual_symbol_ratio", "m.symbol_ratio > 0.1"),
    ("gopher_qual_bullets", "m.bullet_ratio > 0.9"),
    ("gopher_qual_ellipses", "m.ellipsis_ratio > 0.3"),
    ("gopher_qual_gopher_below_alpha_threshold", "m.alpha_ratio < 0.8"),
    ("gopher_qual_stop_words", "m.stop_distinct < 2"),
    ("fineweb_line_punct_ratio", "m.punct_lines < 0.12"),
    ("fineweb_short_line_ratio", "m.short_lines > 0.67"),
    ("fineweb_char_dup_ratio", "m.dup_line_chars > 0.01"),
    ("fineweb_list_ratio", "m.newline_ratio > 0.3"),
]


#: The n-gram parts of the repetition rules, over a struct g of `repetition.shares`.
REPEATED_WORDS = " or ".join([f"g.top_{n} > {v}" for n, v in repetition.TOP.items()] + [f"g.cov_{n} > {v}" for n, v in repetition.DUPLICATED.items()])
GOPHER_GRAMS = [(f"gopher_rep_top_{n}_gram", f"g.top_{n} > {v}") for n, v in repetition.TOP.items()] + [(f"gopher_rep_duplicated_{n}_n_grams", f"g.dup_{n} > {v}") for n, v in repetition.DUPLICATED.items()]
#: The filters of the first stack with all parts of the repetition rule.
REFINEDWEB_WHOLE = [(n, f"{p} or {REPEATED_WORDS}" if n == "repetition" else p) for n, p in REFINEDWEB]


def reasons(rules: list[tuple[str, str]]) -> Column:
    """The names of the rules that fire, in the order of the stack. A rule that cannot be decided (null) is an error
    and counts as a drop, under its name and ERROR."""
    one = lambda n, p: F.when(F.expr(p).isNull(), F.lit(f"{n} ERROR")).when(F.expr(p), F.lit(n))
    return F.filter(F.array(*[one(n, p) for n, p in rules]), lambda x: x.isNotNull())


def stack(config: list[dict]) -> list[tuple[str, str]]:
    """A stack from a list of {func, kwargs} steps, as rule configurations are written: func names a rule of RULE_TEXTS,
    kwargs replace its limits."""
    out = []
    for step in config:
        text, limits = RULE_TEXTS[step["func"]]
        unknown = set(step.get("kwargs", {})) - set(limits)
        if unknown:
            raise ValueError(f"{step['func']} has no {', '.join(sorted(unknown))}")
        out.append((step["func"], text.format(**{**limits, **step.get("kwargs", {})})))
    return out


#: Rules by the name of their step: predicate and published limits (fixed values).
RULE_TEXTS = {
    "page_length_filter": ("m.n_words < {min} or m.n_words > {max}", {"min": 50, "max": 100000}),
    "word_length_filter": ("m.mean_word < {min} or m.mean_word > {max}", {"min": 3, "max": 10}),
    "symbol_ratio_filter": ("m.symbol_ratio > {max}", {"max": 0.1}),
    "bullet_count_filter": ("m.bullet_ratio > {max}", {"max": 0.9}),
    "ellipsis_count_filter": ("m.ellipsis_ratio > {max}", {"max": 0.3}),
    "alphabetic_word_ratio_filter": ("1 - m.alpha_ratio > {max}", {"max": 0.2}),
    "stop_word_filter": ("m.stop_words < {min}", {"min": 2}),
}


def cleaned(text: Column) -> Column:
    """Text modifiers: URLs go, runs of more than two line feeds become two."""
    return F.regexp_replace(F.regexp_replace(text, r"https?://\S+", ""), "\n{3,}", "\n\n")


def shortened(lines: Column) -> Column:
    """All line modifiers: those that drop lines, then the shop and navigation phrases; lines emptied by that go."""
    return F.filter(F.transform(modified_lines(lines), lambda x: T.strip(without_substrings(x))), lambda x: x != "")


#: Line modifiers of the RefinedWeb stack (fixed values).
COUNTER = r"(?i)^\W*\d+(?:[.,]\d+)?[kmb]?\s+(likes|shares|comments|retweets|reposts|quotes|bookmarks|upvotes|downvotes|downloads|views|followers)\W*$"


def modified_lines(lines: Column) -> Column:
    """Lines left by the uppercase, numeric, counter and length modifiers."""
    without = lambda x, pattern: F.length(x) - F.length(F.regexp_replace(x, pattern, ""))
    upper, digits = (lambda x: without(x, "[A-Z]+")), (lambda x: without(x, "[0-9]+"))
    letters = lambda x: F.length(F.regexp_replace(x, r"\s+", ""))
    # one other character is more than a millionth of a shorter line
    numeric = lambda x: ~(((F.length(x) <= 100_000) & x.rlike(r"[^\s0-9]")) | (digits(x) <= 0.999999 * letters(x)))
    return F.filter(lines, lambda x: (upper(x) <= 0.5 * F.length(x)) & ~numeric(x) & ~x.rlike(COUNTER) & T.has_words(x, 2))


#: C4 page and line rules (fixed values).
POLICY = ["terms of use", "privacy policy", "cookie policy", "uses cookies", "use of cookies", "use cookies"]


def c4_lines(lines: Column) -> Column:
    def ok(x):
        long_word = (F.length(x) > 1000) & x.rlike(f"{T.SOLID}{{1001}}")
        return T.has_words(x, 3) & ~long_word & ~T.has_any(x, ["javascript", *POLICY])

    return F.filter(lines, ok)


def c4_page(text: Column, kept: Column) -> Column:
    """Reason a page goes, or null: lorem ipsum, a brace, fewer than five sentences in what is kept."""
    sentences = F.regexp_count(F.array_join(kept, "\n"), F.lit(r"[.!?]+(\s|$)"))
    return F.when(F.contains(F.lower(text), F.lit("lorem ipsum")), F.lit("lorem_ipsum")).when(F.contains(text, F.lit("{")), F.lit("curly_bracket")).when(sentences < 5, F.lit("too_few_sentences"))


def url_reason(url: Column, domains: list[str], strict: list[str], hard: list[str], soft: list[str]) -> Column:
    """Why a URL is banned, or null: a listed domain, a listed substring once -._ go, a hard word, two soft words."""
    host, flat = T.site(url), F.regexp_replace(F.lower(url), r"[-._]", "")
    found = F.array_distinct(F.regexp_extract_all(F.lower(url), F.lit(r"([a-z]+)"), 1))
    sub = F.lit(False)
    for s in strict:
        sub = sub | F.contains(flat, F.lit(s))
    lit = lambda xs: F.array(*[F.lit(x) for x in xs]).cast("array<string>")
    return F.when(host.isin(domains), F.lit("url_domain")).when(sub, F.lit("url_strict")).when(F.arrays_overlap(found, lit(hard)), F.lit("url_hard")).when(F.size(F.array_intersect(found, lit(soft))) >= 2, F.lit("url_soft"))


def without_substrings(line: Column) -> Column:
    """Short lines (ten words at most) without the shop and navigation phrases (fixed values) inside, behind or before."""
    cut = F.regexp_replace(F.regexp_replace(F.regexp_replace(line, "(?i)items in cart", ""), r"(?i)Read more\.\.\.$", ""), "(?i)^Sign-in", "")
    return F.when(T.has_words(line, 11), line).otherwise(cut)
