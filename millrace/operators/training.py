"""Building supervised sets: serialising edits as programs, relabelling them, and the gates between steps."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from millrace.functions import text as T
from millrace.operators import diffs

_ROW = StructType([StructField("program", StringType()), StructField("kind", StringType())])


def _runs(numbers: list[int]) -> list[tuple[int, int]]:
    """(first, last) of the runs of consecutive ascending numbers."""
    starts = [i for i, n in enumerate(numbers) if i == 0 or n != numbers[i - 1] + 1]
    return [(numbers[i], numbers[j - 1]) for i, j in zip(starts, [*starts[1:], len(numbers)])]


class _Extraction:
    """A page's lines that an extraction keeps. `fault` says why it is no pure line removal (fixed names)."""

    def __init__(self, full: str, extracted: str):
        page, self.lines = diffs.split_lines(full), diffs.split_lines(extracted)
        self.removed = diffs.edits(page, self.lines)
        self.fault = None
        if self.removed is None:
            self.fault = "stage1_not_subset"
        elif any(e.text is not None for e in self.removed):
            self.fault = "stage1_has_sub"
        else:
            gone = {n for e in self.removed for n in range(e.first, e.last + 1)}
            self.kept = [n for n in range(1, len(page) + 1) if n not in gone]
            if len(self.kept) != len(self.lines):
                self.fault = "stage1_len_mismatch"

    def on_page(self, found: list[diffs.Edit]) -> list[diffs.Edit]:
        """Edits of the extraction as edits of the page; lines removed together may lie apart there."""
        out = []
        for e in found:
            numbers = self.kept[e.first - 1 : e.last]
            out += [diffs.Edit(a, b, e.text) for a, b in _runs(numbers)]
        return out


def staged(full: str, extracted: str, target: str) -> tuple[str | None, str]:
    """(program, kind): the extraction as line removals, then the target's decision with page line numbers."""
    x = _Extraction(full, extracted)
    if x.fault:
        return None, x.fault
    parts = ["<extract>", *map(str, x.removed)]
    head, _, body = target.lstrip().partition("\n")
    decided = {"<delete>": ("<delete>", "delete"), "<extract>": ("<keep>", "keep"), "<rewrite>": ("<rewrite>", "rewrite")}.get(head.strip())
    if decided is None:
        found = diffs.edits(x.lines, diffs.split_lines(body))
        decided = ("<edit>", "edit_fulltext_fallback" if found is None else "edit_ops") if found is None or found else ("<keep>", "refine_noop_to_keep")
        if found:
            body = "\n".join(map(str, x.on_page(found)))
    tag, kind = decided
    parts += [tag, body.strip()] if tag in ("<edit>", "<rewrite>") else [tag]
    return "\n".join(parts), kind


@F.pandas_udf(_ROW)
def staged_row(full: pd.Series, extracted: pd.Series, target: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([staged(a or "", b or "", c or "") for a, b, c in zip(full, extracted, target)], columns=["program", "kind"])


DECISION = r"(?m)^(<keep>|<edit>|<delete>|<rewrite>)$"


def decision_first(program: Column) -> Column:
    """The program behind its own decision; null if it has none."""
    d = F.regexp_extract(program, DECISION, 1)
    return F.when(d != "", F.concat(d, F.lit("\n"), program))


def fold_rewrite(program: Column) -> Column:
    """Rewrites become deletes, with their extract block."""
    block = F.regexp_extract(program, r"(?s)\A<rewrite>\n(.*?)\n?<rewrite>", 1)
    return F.when(program.startswith("<rewrite>"), F.concat(F.lit("<delete>\n"), block, F.lit("\n<delete>"))).otherwise(program)


def tag_rule(refined: Column, deleted: Column, extracted: Column) -> Column:
    """A teacher's label: deleted, unchanged but for white space, or refined."""
    return F.when(deleted, F.lit("<delete>")).when(T.collapse(refined) == T.collapse(extracted), F.lit("<extract>")).otherwise(F.concat(F.lit("<refine>\n"), refined))


def gate(df: DataFrame, program: str = "program") -> DataFrame:
    """Counts that must be zero: leading and trailing decisions that differ, missing extract blocks, rewrites."""
    p = F.col(program)
    lead = F.regexp_extract(p, r"\A(<keep>|<edit>|<delete>|<rewrite>)(\n|\z)", 1)
    second = F.regexp_extract(p, r"(?s)\A<[a-z]+>\n<extract>(?:\n(?:rm|sub) [^\n]*)*\n(<keep>|<edit>|<delete>|<rewrite>)(\n|\z)", 1)
    return df.agg(F.count("*").alias("n"), F.count_if(lead != second).alias("decision_mismatch"), F.count_if(~F.contains(p, F.lit("\n<extract>"))).alias("no_extract"), F.count_if(lead == "<rewrite>").alias("rewrites"))


SCHEMES = {"rescue": 1.0, "edu1": 1.0, "allrw": 0.5, "rw15": 1.5}


def relabelled(df: DataFrame, scheme: str, program: str = "program", edu: str = "edu", rewrite: str = "rewrite") -> DataFrame:
    """Delete programs with a score flip to keep (rescue, 1.5 and up) or, where a rewrite exists and the scheme's least
    score is met, to rewrite; `outcome` says what happened."""
    p, block = F.col(program), F.regexp_extract(program, r"(?s)\A<delete>(.*?)<delete>", 1)
    is_delete, scored = p.startswith("<delete>"), F.col(edu).isNotNull()
    keep = is_delete & scored & (F.col(edu) >= 1.5) & F.lit(scheme == "rescue")
    rw = is_delete & scored & F.col(rewrite).isNotNull() & (F.col(edu) >= SCHEMES[scheme])
    out = F.when(keep, F.concat(F.lit("<keep>"), block, F.lit("<keep>"))).when(rw, F.concat(F.lit("<rewrite>"), block, F.lit("<rewrite>\n"), F.col(rewrite))).otherwise(p)
    what = F.when(~is_delete, F.lit("other")).when(keep, F.lit("flip_keep")).when(rw, F.lit("flip_rewrite")).when(scored, F.lit("unchanged")).otherwise(F.lit("no_decision"))
    return df.withColumn("outcome", what).withColumn(program, out)


def rescue_action(edu: Column, prose_words: Column) -> Column:
    return F.when(edu >= 1.5, F.lit("keep")).when((edu >= 1.0) & (prose_words >= 150), F.lit("candidate")).otherwise(F.lit("drop"))


def rescue_gate(edu_rewrite: Column, edu: Column, ratio: Column, text: Column) -> Column:
    return (edu_rewrite >= edu) & (edu_rewrite >= 1.5) & ratio.between(0.7, 1.3) & ~text.rlike(T.SIMPLE_DIRT)


def int_edu(edu: Column) -> Column:
    return F.bround(F.least(F.greatest(edu, F.lit(0.0)), F.lit(5.0)), 0).cast("int")


def quality_scores(output: Column) -> Column:
    """Positional score lines of a quality model: a domain, then 14 scores, unparsable ones 0; valid if the overall score
    is between 1 and 5."""
    lines = T.lines_of(output)
    score = lambda i: F.coalesce(F.regexp_extract(F.get(lines, F.lit(i)), r"(\d+(?:\.\d+)?)\s*$", 1).try_cast("double"), F.lit(0.0))
    scores = F.array(*[score(i) for i in range(1, 15)])
    return F.struct(F.get(lines, F.lit(0)).alias("domain"), scores.alias("scores"), F.get(scores, F.lit(13)).between(1, 5).alias("valid"))
