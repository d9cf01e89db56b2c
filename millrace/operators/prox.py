"""Executor of chunk programs: remove_lines(start, end) on 0-based lines and normalize(source, target) on strings.

Replacements are applied first, in order, to the whole text; then line ranges go. Calls that do not parse and ranges
outside the text are counted as errors. The order dependence of replacements makes this a batch function.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

_CALL = re.compile(r"^\s*(remove_lines|normalize|remove_all|keep_all|untouch_doc)\s*\((.*)\)\s*$", re.S)
_ARG = re.compile(r"""(\w+)\s*=\s*("(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*'|-?\d+|True|False|[\w]+)""", re.S)


def parse(line: str) -> tuple[str, dict] | None:
    m = _CALL.match(line)
    if not m:
        return None
    args = {}
    for name, raw in _ARG.findall(m[2]):
        if raw[0] in "\"'":
            args[name] = raw[1:-1].replace('\\"', '"').replace("\\'", "'").replace("\\n", "\n")
        else:
            args[name] = int(raw) if raw.lstrip("-").isdigit() else raw
    return m[1], args


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def run_program(text: str, program: str) -> tuple[str, int]:
    """(text, errors)."""
    errors, ranges, everything = 0, [], False
    for line in program.split("\n"):
        if not line.strip():
            continue
        call = parse(line)
        if call is None:
            errors += 1
            continue
        name, args = call
        if name == "remove_all" or args.get("all") == "True":
            everything = True
        elif name == "normalize":
            if "source" not in args:
                errors += 1
            elif args["source"]:
                text = text.replace(str(args["source"]), str(args.get("target", "")))
        elif name == "remove_lines":
            a, b = args.get("start"), args.get("end", args.get("start"))
            if isinstance(a, int) and isinstance(b, int) and 0 <= a <= b:
                ranges.append((a, b))
            else:
                errors += 1
    if everything:
        return "", errors
    lines = text.split("\n")
    drop: set[int] = set()
    for a, b in merged(ranges):
        if a >= len(lines):
            errors += 1
        drop.update(range(a, min(b, len(lines) - 1) + 1))
    return "\n".join(x for i, x in enumerate(lines) if i not in drop), errors


def accept(before: str, after: str, errors: int) -> str | None:
    """What is kept: nothing where under a twentieth of the words is left or ten words or fewer are; the new text if
    there were fewer than two errors; else the old one. A text without words fails (None)."""
    n = len(before.split())
    if not n:
        return None
    left = len(after.split())
    if errors < 2 and (left / n <= 0.05 or left <= 10):
        return ""
    return after if errors < 2 else before


@F.pandas_udf(StructType([StructField("text", StringType()), StructField("errors", IntegerType())]))
def executed(text: pd.Series, program: pd.Series) -> pd.DataFrame:
    rows = []
    for t, p in zip(text, program):
        new, errors = run_program(t or "", p or "")
        rows.append((accept(t or "", new, errors), errors))
    return pd.DataFrame(rows, columns=["text", "errors"])
