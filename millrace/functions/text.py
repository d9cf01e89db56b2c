"""Text functions as Column expressions. White space is Unicode white space and the separators 0x1C to 0x1F. Its patterns
ask first whether a character is a printable one of ASCII, so that one comparison settles most."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SPACES = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WS, SOLID = rf"[\x00-\x20\x7f-\uffff&&[{_SPACES}]]", f"[!-~[^{_SPACES}]]"
_SPACE_CHARS = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
#: Line ends of a universal line splitter.
LINE_END = r"\r\n|[\x00-\x1f\x7f-\uffff&&[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]]"
#: Residual markup in extracted text (fixed pattern).
MARKUP = r"(?i)</\w+>|<\\/\w+>|<(div|span|nav|ul|li|table|tr|td)\b[^>]*>"


def text_of(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(_SPACE_CHARS))


def collapse(c: Column) -> Column:
    """Runs of white space become one space; none is left at the ends."""
    return strip(F.regexp_replace(c, f"{WS}+", " "))


def settled(c: Column) -> Column:
    """The value as it is. The optimizer takes it for one that must not be worked out again, and so neither copies its
    expression into what reads it nor moves a filter on it below it."""
    return F.when(F.monotonically_increasing_id() >= 0, c)


def words(c: Column) -> Column:
    return F.when(strip(c) == "", F.array().cast("array<string>")).otherwise(F.split(strip(c), f"{WS}+"))


def n_words(c: Column) -> Column:
    return F.when(strip(c) == "", F.lit(0)).otherwise(F.size(F.split(strip(c), f"{WS}+")))


def has_words(c: Column, n: int) -> Column:
    """Whether there are n words or more; the rest of the text is not looked at."""
    return c.rlike(rf"\A{WS}*+(?:{SOLID}++{WS}++){{{n - 1}}}{SOLID}")


def has_any(c: Column, phrases: list[str]) -> Column:
    """Whether the lower-case text holds one of the phrases."""

    def found(low: Column) -> Column:
        out = F.lit(False)
        for p in phrases:
            out = out | F.contains(low, F.lit(p))
        return out

    return F.exists(F.array(F.lower(c)), found)


def lines_of(c: Column) -> Column:
    """Lines between line feeds, stripped, without empty ones."""
    return F.filter(F.transform(F.split(c, "\n"), strip), lambda x: x != "")


def number_lines(c: Column) -> Column:
    """`<lid:i> line` for each line, from 1."""
    return F.array_join(F.transform(lines_of(c), lambda x, i: F.concat(F.lit("<lid:"), (i + 1).cast("string"), F.lit("> "), x)), "\n")


def strip_ids(c: Column) -> Column:
    return F.regexp_replace(c, r"(?m)^<lid:\d+> ?", "")


def webkit_post(c: Column) -> Column:
    """Cleanup behind rendering: bars, rulers, Markdown escapes, white space and empty lines go."""
    t = F.regexp_replace(c, r"\|+", " ")
    t = F.regexp_replace(t, r"(?m)^[\s\-|]+$", "")
    t = F.regexp_replace(t, r"\\([$*\[\]_`#])", "$1")
    return F.array_join(F.filter(F.transform(F.split(t, "\n"), collapse), lambda x: x != ""), "\n")


def strip_blank_lines(c: Column) -> Column:
    """Lines of any line end that hold more than white space, joined by line feeds."""
    return F.array_join(F.filter(F.split(c, LINE_END), lambda x: strip(x) != ""), "\n")


def has_markup(c: Column) -> Column:
    return c.rlike(MARKUP)


def norm_line(c: Column) -> Column:
    return strip(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " "))


def tokens(c: Column) -> Column:
    """Runs of letters, digits and underscores of the lower-case text."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"([\p{L}\p{N}_]+)"), 1)


def dedup_key(c: Column) -> Column:
    return F.sha1(F.lower(F.substring(collapse(c), 1, 1500)))


def clip(c: Column, n: int) -> Column:
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("\n[... truncated for length]"))).otherwise(c)


def head_tail(c: Column, budget: int) -> Column:
    """The first and last half of a budget of characters."""
    half = budget // 2
    return F.when(F.length(c) > budget, F.concat(F.substring(c, 1, half), F.lit("... "), F.right(c, F.lit(half)))).otherwise(c)


def fit(c: Column, limit: int = 32768, reserve: int = 512 + 2048, least: int = 500) -> Column:
    """The longest of the cuts to 0.8, 0.64, ... of the text whose bytes and the reserve fit the limit."""
    n = F.length(c)
    sizes = F.transform(F.sequence(F.lit(0), F.lit(60)), lambda k: F.floor(n * F.pow(F.lit(0.8), k)).cast("int"))
    good = F.filter(sizes, lambda m: (F.octet_length(F.substring(c, F.lit(1), m)) + reserve <= limit) | (m < least))
    return F.when(F.octet_length(c) + reserve <= limit, c).otherwise(F.substring(c, F.lit(1), F.get(good, F.lit(0))))


def chunks(c: Column, size: int = 7000) -> Column:
    """Pieces of `size` characters."""
    return F.when(F.length(c) > 0, F.transform(F.sequence(F.lit(0), (F.ceil(F.length(c) / size) - 1).cast("int")), lambda i: F.substring(c, i * size + 1, F.lit(size)))).otherwise(F.array().cast("array<string>"))


def after_marker(c: Column, marker: str = "Here is a paraphrased version:") -> Column:
    return strip(F.regexp_extract(c, rf"(?s){marker}(.*)", 1))


def strip_rules(c: Column) -> Column:
    return strip(F.regexp_replace(F.regexp_replace(c, r"\A---", ""), r"---\z", ""))


def clean_rewrite(c: Column) -> Column:
    """What follows the last thought and the last preamble, without fences and rulers, white space collapsed by line."""
    t = F.regexp_replace(c, r"(?is)\A.*</think>", "")
    t = F.regexp_replace(t, r"(?is)\A.*here\s+is\s+a\s+paraphrased\s+version\s*:?\s*", "")
    t = F.regexp_replace(t, r"(?i)<think>", "")
    t = F.regexp_replace(t, r"\A\s*(-{3,}|`{3,}[a-zA-Z]*)\s*", "")
    t = F.regexp_replace(t, r"\s*(`{3,})\s*\z", "")
    return F.array_join(F.filter(F.transform(F.split(t, "\n"), collapse), lambda x: x != ""), "\n")


#: Signs of a paraphraser's own talk (fixed patterns).
REWRITE_DIRT = {
    "think_tag": r"(?i)</?think>",
    "prompt_echo": r"(?i)your task is to read and paraphrase|delete clearly irrelevant content",
    "answer_preamble": r"(?i)here is a paraphrased version",
    "self_commentary": r"(?i)\bthis (paraphrased version|paraphrase) (retains|maintains|keeps|preserves)",
    "instr_compliance": r"(?i)\b(retains all relevant details|while ensuring clarity|adherence to the instructions)\b",
    "narration_strict": r"(?im)^\s*(?:(?:okay|alright)[,.]? the user\b|let me (?:reorganize|rephrase|paraphrase|rewrite) )",
    "needs_to": r"(?i)\b(the user wants|i need to (?:make sure|rephrase|paraphrase))\b",
}
SIMPLE_DIRT = r"(?i)</?think>|the user wants|i need to (make sure|rephrase|paraphrase)|here is a paraphrased version"


def rewrite_dirt(c: Column) -> Column:
    """The names of the patterns that occur."""
    return F.filter(F.array(*[F.when(c.rlike(p), F.lit(n)) for n, p in REWRITE_DIRT.items()]), lambda x: x.isNotNull())


def head_in(text: Column, head: Column) -> Column:
    """Whether the first words (up to 6, of 3 or more letters and digits, from 200 characters) occur in order in `head`."""
    first = F.slice(F.regexp_extract_all(F.lower(F.substring(text, 1, 200)), F.lit(r"([a-z0-9]{3,})"), 1), 1, 6)
    step = lambda at, w: F.when(at == 0, F.lit(0)).otherwise(F.when(_locate(w, head, at) == 0, F.lit(0)).otherwise(_locate(w, head, at) + F.length(w)))
    return (F.size(first) > 0) & (F.aggregate(first, F.lit(1), step) > 0)


def with_repetition(df: DataFrame, name: str, text: str, n: int = 8, least: int = 40) -> DataFrame:
    """Adds 1 - distinct / all n-grams of lower-case words; null under `least` words. The words are a column of their
    own, so that they are split once and not once a position."""
    d = df.withColumn("_w", words(F.lower(text_of(text))))
    grams = F.transform(F.sequence(F.lit(0), F.size("_w") - n), lambda i: F.xxhash64(*[F.get(F.col("_w"), i + j) for j in range(n)]))
    d = d.withColumn("_g", F.when(F.size("_w") >= least, grams))
    return d.withColumn(name, 1 - F.size(F.array_distinct("_g")) / F.size("_g")).drop("_w", "_g")


def site(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.parse_url(c, F.lit("HOST"))), r"\Awww\.", "")


def _locate(w: Column, s: Column, at: Column) -> Column:
    return F.call_function("locate", w, s, at)
