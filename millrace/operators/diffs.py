"""Deriving edit programs from text pairs. Matching blocks are sequential by nature, so pairs go through Arrow batches."""

from __future__ import annotations

import difflib
import json
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def split_lines(t: str) -> list[str]:
    return [x.strip() for x in t.split("\n") if x.strip()]


@dataclass(frozen=True)
class Edit:
    """Removal of the lines first to last or, with `text`, of that string from line first. Lines count from 1."""

    first: int
    last: int
    text: str | None = None

    def __str__(self) -> str:
        if self.text is not None:
            return f"sub {self.first}: {json.dumps(self.text, ensure_ascii=False)}"
        return f"rm {self.first}" if self.first == self.last else f"rm {self.first}-{self.last}"


def gaps(a, b) -> list[tuple[range, range]]:
    """Where two sequences differ: what lies between their matching blocks, as places in each."""
    out, i, k = [], 0, 0
    for block in difflib.SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks():
        if (block.a, block.b) != (i, k):
            out.append((range(i, block.a), range(k, block.b)))
        i, k = block.a + block.size, block.b + block.size
    return out


def removals(line: str, left: str) -> list[str]:
    """The strings without which `line` is `left`; empty if there are none, or one is blank, or something is new."""
    found = [(line[old.start : old.stop], len(new)) for old, new in gaps(line, left)]
    return [] if any(n or not s.strip() for s, n in found) else [s for s, _ in found]


def edits(a: list[str], b: list[str]) -> list[Edit] | None:
    """What turns the lines a into b, by removals alone; None if those are not enough. Lines that have a counterpart lose
    strings, lines that have none go."""
    out: list[Edit] = []
    for old, new in gaps(a, b):
        if not new:
            out.append(Edit(old.start + 1, old.stop))
            continue
        strings = [(i + 1, removals(a[i], b[k])) for i, k in zip(old, new)]
        if len(old) != len(new) or not all(s for _, s in strings):
            return None
        out += [Edit(i, i, s) for i, found in strings for s in found]
    return out


def make_program(src: str, dst: str) -> str | None:
    """Operations that turn the lines of src into those of dst, or None if removals are not enough."""
    found = edits(split_lines(src), split_lines(dst))
    return None if found is None else "\n".join(map(str, found))


@F.pandas_udf(StringType())
def program_of(src: pd.Series, dst: pd.Series) -> pd.Series:
    return pd.Series([None if a is None or b is None else make_program(a, b) for a, b in zip(src, dst)], dtype=object)


@F.pandas_udf(StringType())
def effect_of(before: pd.Series, after: pd.Series) -> pd.Series:
    """unchanged, emptied, lines only, strings only or both: what an edit did."""

    def one(a, b):
        x, y = split_lines(a or ""), split_lines(b or "")
        if x == y:
            return "unchanged"
        if not y:
            return "emptied"
        found = gaps(x, y)
        if all(not new for _, new in found):
            return "lines only"
        return "strings only" if all(old and new for old, new in found) else "both"

    return pd.Series([one(a, b) for a, b in zip(before, after)], dtype=object)
