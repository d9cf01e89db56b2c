"""Shares of a text's characters in its most frequent and in its repeated word n-grams, for n from 2 to 10.

Equal n-grams are found by ranking pairs of (equal (n-1)-gram, next word), so no n-gram is ever spelt out and one pass
gives all sizes; it stops at the size from which nothing repeats. Two measures of repetition are in use: a scan from
left to right that jumps over what it has counted, and the characters of all words in repeated n-grams. The scan is
sequential, so texts go through Arrow batches.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructField, StructType

#: Published limits (fixed values).
TOP = {2: 0.20, 3: 0.18, 4: 0.16}
DUPLICATED = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
FIELDS = [*(f"top_{n}" for n in TOP), *(f"dup_{n}" for n in DUPLICATED), *(f"cov_{n}" for n in DUPLICATED)]


def _sizes(words: list[str]) -> dict[str, tuple[int, int]]:
    """Of each field above none, the characters that its share counts, and those of all words."""
    import numpy as np

    out: dict[str, tuple[int, int]] = {}
    if len(words) < 2:
        return out
    seen: dict[str, int] = {}
    w = np.array([seen.setdefault(x, len(seen)) for x in words])
    ends = np.concatenate([[0], np.cumsum([len(x) for x in words])])
    every = int(ends[-1])
    at, gram = np.arange(len(words)), w
    for n in range(2, 11):
        # only where the (n-1)-gram repeats can the n-gram
        fits = at + n <= len(words)
        at, gram = at[fits], gram[fits]
        if not len(at):
            break
        gram, count = np.unique(gram * len(seen) + w[at + n - 1], return_inverse=True, return_counts=True)[1:]
        count = count[gram]
        again = count > 1
        at, gram, count = at[again], gram[again], count[again]
        if not len(at):
            break
        size = ends[at + n] - ends[at]
        if n in TOP:
            most = count.max()
            out[f"top_{n}"] = int(most * (size[count == most].max() + n - 1)), every
            continue
        known, twice, free = set(), 0, 0
        for i, g, k in zip(at.tolist(), gram.tolist(), size.tolist()):
            if i >= free:
                if g in known:
                    twice += k
                    free = i + n
                known.add(g)
        out[f"dup_{n}"] = twice, every
        inside = np.zeros(len(words) + 1, np.int64)
        np.add.at(inside, at, 1)
        np.add.at(inside, at + n, -1)
        covered = np.cumsum(inside[:-1]) > 0
        out[f"cov_{n}"] = int(np.diff(ends)[covered].sum()), every
    return out


def _shares(sizes: dict[str, tuple[int, int]], n_chars: int) -> dict[str, float]:
    return dict.fromkeys(FIELDS, 0.0) | {f: k / (every if f.startswith("cov") else n_chars) for f, (k, every) in sizes.items()}


def shares(text: str) -> dict[str, float]:
    """top_n: the most frequent n-gram's characters, spaces included, times its count, of the text's; dup_n: characters
    that the jumping scan finds again, of the text's; cov_n: characters of words in repeated n-grams, of all words'."""
    return _shares(_sizes(text.split()), len(text))


def fired(text: str) -> list[str]:
    s = shares(text)
    return [f"gopher_rep_top_{n}_gram" for n, most in TOP.items() if s[f"top_{n}"] > most] + [f"gopher_rep_duplicated_{n}_n_grams" for n, most in DUPLICATED.items() if s[f"dup_{n}"] > most]


def _repetition_shares(text: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([shares(t or "") for t in text], columns=FIELDS)


def _repetition_pairs(text: pd.Series, other: pd.Series) -> pd.DataFrame:
    rows = []
    for t, n in zip(text, other):
        sizes = _sizes((t or "").split())
        rows.append([*_shares(sizes, len(t or "")).values(), *_shares(sizes, n).values()])
    return pd.DataFrame(rows, columns=[*FIELDS, *(f"other_{f}" for f in FIELDS)])


#: Not deterministic for the optimizer, which else copies the call into filters and into all that reads its fields.
repetition_shares = F.pandas_udf(_repetition_shares, StructType([StructField(f, DoubleType()) for f in FIELDS])).asNondeterministic()
#: The same, and as other_... the shares of a text of the same words and of so many characters.
repetition_pairs = F.pandas_udf(_repetition_pairs, StructType([StructField(p + f, DoubleType()) for p in ("", "other_") for f in FIELDS])).asNondeterministic()


@F.pandas_udf(ArrayType(StringType()))
def repetition_reasons(text: pd.Series) -> pd.Series:
    return text.map(lambda t: fired(t or ""))
