"""Quality rules as a bitmask ledger.

Every rule is evaluated once for every document; the ledger keeps the measurements and one bit per failed rule.
A policy is a named mask over those bits, so changing the policy, or asking what one rule costs, is integer
arithmetic over the ledger and never reads a text again. All expressions are built-in SQL functions in one
map-only pass: no shuffle, no Python.

Defined results: a null or empty text has no words (it fails `too_few_words`); documents are independent of each
other, so ties and repeated rows each get their own row; rows with a null id are judged like all others; columns
other than the id and the text are ignored, whatever their names; an empty table gives an empty ledger.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes that separate words: space and 0x09 to 0x0D.
SPACE = r"[\\x20\\x09-\\x0D]+"
#: The hash that finds candidates for equal windows; their words decide.
HASH = "xxhash64({}, {}, {})"


@dataclass(frozen=True)
class Rule:
    """`fails` is a SQL predicate over the measurements, true where the document breaks the rule."""

    name: str
    fails: str


#: The position in this list is the bit. Rules are only ever appended, so that stored ledgers stay readable.
RULES = [
    Rule("too_few_words", "n_words < 50"),
    Rule("repeated_words", "100 * n_repeat_words > 50 * n_words"),
    Rule("too_many_words", "n_words > 100000"),
    Rule("short_mean_word", "word_chars < 2 * n_words"),
    Rule("long_mean_word", "word_chars > 20 * n_words"),
    Rule("symbol_heavy", "2 * n_symbols > n_words"),
    Rule("repeated_lines", "2 * n_dup_lines > n_lines and n_lines >= 4"),
]

#: Policies by version: the rules whose failure rejects a document.
POLICIES = {
    "base": ["too_few_words", "repeated_words"],
    "v1": ["too_few_words", "repeated_words", "short_mean_word", "long_mean_word", "symbol_heavy", "repeated_lines"],
    "strict": [r.name for r in RULES],
}


def mask(names: list[str]) -> int:
    """The bits of the named rules."""
    order = [r.name for r in RULES]
    return sum(1 << order.index(n) for n in names)


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: list[str] = ()) -> DataFrame:
    """The measurements of every document.

    n_repeat_words packs, for each 3-word window, the high bits of a 64-bit hash with the window's position into one
    long. Sorting those primitives puts equal windows side by side, which costs n log n however long the text and
    however often it repeats. The position takes only as many bits as the text needs. Neighbours
    with equal bits are compared by their words; if any differ, the text's candidates are sorted by words instead.
    """
    base = docs.select(*[F.col(c).alias(f"_k_{i}") for i, c in enumerate([id_col, *keep])], F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    keys = [f"_k_{i}" for i in range(1 + len(keep))]
    trimmed = base.selectExpr(*keys, "_text", r"btrim(_text, ' \t\n\u000B\f\r') _trim")
    words = trimmed.selectExpr(*keys, "_text", f"case when _trim = '' then cast(array() as array<string>) else split(_trim, '{SPACE}') end _words")
    counted = words.selectExpr(
        *keys, "_words", "size(_words) _n", "length(bin(size(_words))) _bits",
        "cast(length(array_join(_words, '')) as bigint) word_chars",
        r"cast(regexp_count(_text, '[#*$%&|<>]') as bigint) n_symbols",
        r"filter(split(_text, '\n'), x -> x rlike '[^\\x20\\x09-\\x0D]') _lines",
    )
    window = HASH.format("_words[i]", "_words[i + 1]", "_words[i + 2]")
    packed = counted.selectExpr(
        *keys, "_words", "_n", "_bits", "word_chars", "n_symbols", "size(_lines) _n_lines", "size(_lines) - size(array_distinct(_lines)) _dup",
        f"case when _n >= 3 then sort_array(transform(sequence(0, _n - 3), i -> shiftleft(shiftright({window}, _bits), _bits) | i)) else cast(array() as array<bigint>) end _grams",
    )
    same = "shiftright(x, _bits) = shiftright(_grams[{}], _bits)"
    twice = packed.selectExpr(
        *keys, "_words", "_n", "_bits", "word_chars", "n_symbols", "_n_lines", "_dup",
        f"filter(_grams, (x, i) -> (i > 0 and {same.format('i - 1')}) or (i < _n - 3 and {same.format('i + 1')})) _twice",
    )
    at = "({} & (shiftleft(1L, _bits) - 1L))"
    word = "_words[cast({} as int) + {}]"
    differ = " or ".join(f"{word.format(at.format('x'), d)} <> {word.format(at.format('_twice[i - 1]'), d)}" for d in range(3))
    mixed = twice.selectExpr("*", f"size(filter(_twice, (x, i) -> i > 0 and shiftright(x, _bits) = shiftright(_twice[i - 1], _bits) and ({differ}))) > 0 _mixed")
    triple = ", ".join(word.format(at.format("x"), d) for d in range(3))
    ranked = mixed.selectExpr("*", f"case when _mixed then sort_array(transform(_twice, x -> struct(struct({triple}) as w, {at.format('x')} as p))) end _ranked")
    verified = ranked.selectExpr(
        *keys, "_n", "word_chars", "n_symbols", "_n_lines", "_dup",
        f"case when _mixed then transform(filter(_ranked, (x, i) -> (i > 0 and x.w = _ranked[i - 1].w) or (i < size(_ranked) - 1 and x.w = _ranked[i + 1].w)), x -> x.p) else transform(_twice, x -> {at.format('x')}) end _at",
    )
    return verified.selectExpr(
        *[f"{k} as `{c}`" for k, c in zip(keys, [id_col, *keep])],
        "cast(_n as bigint) n_words", "word_chars", "n_symbols", "cast(_n_lines as bigint) n_lines", "cast(_dup as bigint) n_dup_lines",
        "cast(size(array_distinct(flatten(transform(_at, x -> array(x, x + 1, x + 2))))) as bigint) n_repeat_words",
    )


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: list[str] = ()) -> DataFrame:
    """Measurements and `failures`, a long with bit i set where RULES[i] fails."""
    bits = " | ".join(f"(case when {r.fails} then {1 << i}L else 0L end)" for i, r in enumerate(RULES))
    return measure(docs, id_col, text_col, keep).selectExpr("*", f"{bits} as failures")


def apply_policy(ledger_df: DataFrame, policy: str = "v1") -> DataFrame:
    """Adds `base_failed`, the policy's verdict `kept`, and the policy's name."""
    base, own = mask(POLICIES["base"]), mask(POLICIES[policy])
    return ledger_df.selectExpr("*", f"(failures & {base}L) <> 0 as base_failed", f"(failures & {base | own}L) = 0 as kept", f"'{policy}' as policy")


def passing(docs: DataFrame, policy: str = "v1", id_col: str = "doc_id", text_col: str = "text", keep: list[str] = ()) -> DataFrame:
    """The rows that a policy keeps, with the id and the `keep` columns, in the same single pass.

    The row number is only there to keep the optimizer from moving the filter below the projections, where it would
    copy each measurement's expression into the condition many times over."""
    numbered = ledger(docs, id_col, text_col, keep).withColumn("_row", F.monotonically_increasing_id())
    return apply_policy(numbered, policy).where("kept and _row >= 0").select(id_col, *keep)


def ablations(ledger_df: DataFrame, policy: str = "v1") -> DataFrame:
    """What each rule of a policy costs: documents failing it, failing nothing else, and kept once it is left out.

    One partial aggregate over the ledger per rule, all in one pass; the result has one row per rule of the policy.
    """
    own = mask(POLICIES[policy])
    order = [r.name for r in RULES]
    aggs = [F.expr("count(*) as n_docs"), F.expr(f"count_if((failures & {own}L) = 0) as n_kept")]
    for name in POLICIES[policy]:
        bit = 1 << order.index(name)
        aggs += [F.expr(f"count_if((failures & {bit}L) <> 0) as fail_{name}"), F.expr(f"count_if((failures & {own}L) = {bit}L) as sole_{name}")]
    one = ledger_df.agg(*aggs)
    rows = ", ".join(f"named_struct('rule', '{n}', 'n_failed', fail_{n}, 'n_sole', sole_{n}, 'n_docs', n_docs, 'n_kept', n_kept, 'n_kept_without', n_kept + sole_{n})" for n in POLICIES[policy])
    return one.selectExpr(f"inline(array({rows}))")
