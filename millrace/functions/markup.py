"""HTML to lines of visible text, main content and block labels, with the standard parser, in Arrow batches."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

HIDDEN = frozenset("head style script noscript link meta iframe frame".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr frame".split())
BLOCKS = frozenset("p div li ul ol table tr td th h1 h2 h3 h4 h5 h6 br hr section article header footer nav aside main form pre blockquote dl dt dd figure figcaption option select title body".split())
BOILERPLATE = frozenset("nav header footer aside form".split())


class _Reader(HTMLParser):
    """Collects (block label, depth in boilerplate, text) runs; a block element starts a new line."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, str]] = []
        self.lines: list[list] = [["", False, []]]

    def _label(self, tag, attrs):
        a = dict(attrs)
        name = tag
        if a.get("class"):
            name += "".join("." + re.sub(r"[^\w-]", "", c) for c in a["class"].split()[:2])
        elif a.get("id"):
            name += "." + re.sub(r"[^\w-]", "", a["id"])
        return name[:24]

    def _line(self):
        label = next((n for t, n in reversed(self.stack) if t in BLOCKS), "")
        self.lines.append([label, any(t in BOILERPLATE for t, _ in self.stack), []])

    def handle_starttag(self, tag, attrs):
        if tag not in VOID:
            self.stack.append((tag, self._label(tag, attrs)))
        if tag in BLOCKS:
            self._line()

    def handle_endtag(self, tag):
        if any(t == tag for t, _ in self.stack):
            while self.stack.pop()[0] != tag:
                pass
        if tag in BLOCKS:
            self._line()

    def handle_data(self, data):
        if not any(t in HIDDEN for t, _ in self.stack):
            self.lines[-1][2].append(data)


def read_lines(html: str) -> list[tuple[str, bool, str]]:
    """(block label, in boilerplate, text) of each line of visible text."""
    r = _Reader()
    r.feed(html)
    r.close()
    out = []
    for label, boiler, parts in r.lines:
        text = " ".join(re.sub(r"\\([$*\[\]_`#])", r"\1", re.sub(r"\|+", " ", "".join(parts))).split())
        if text and not re.fullmatch(r"[\s\-|]+", text):
            out.append((label, boiler, text))
    return out


class _Elements(HTMLParser):
    """(characters, words, label) of the text of every block element, inner ones too."""

    MOST, LONGEST = 4000, 6000

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, str, list[str]]] = []
        self.found: list[tuple[int, str, str]] = []
        self.started = 0

    def handle_starttag(self, tag, attrs):
        if tag in VOID:
            return
        self.open.append((tag, _Reader._label(self, tag, attrs), []))

    def handle_endtag(self, tag):
        if any(t == tag for t, _, _ in self.open):
            while self._closed() != tag:
                pass

    def handle_data(self, data):
        for _, _, parts in self.open:
            parts.append(data)

    def _closed(self) -> str:
        tag, label, parts = self.open.pop()
        text = " ".join(" ".join(parts).split()).lower()
        if tag in BLOCKS and 0 < len(text) <= self.LONGEST and len(self.found) < self.MOST:
            self.found.append((len(text), text, label))
        return tag

    def all(self) -> list[tuple[int, str, str]]:
        while self.open:
            self._closed()
        return sorted(self.found)


def attributed(html: str, lines: list[str]) -> list[str]:
    """For each line the label of the smallest block that contains it or, if none does, of the block of 12 characters or
    more that has most of its words, 0.6 of them at least; empty if there is none either."""
    e = _Elements()
    e.feed(html)
    e.close()
    blocks = e.all()
    words = [(frozenset(t.split()), label) for n, t, label in blocks if n >= 12]
    out = []
    for line in lines:
        low = " ".join(line.split()).lower()
        label = next((label for n, t, label in blocks if n >= len(low) and low in t), "") if low else ""
        own = set(low.split())
        if own and not label:
            share, _, label = max(((len(own & w) / len(own), -k, x) for k, (w, x) in enumerate(words)), default=(0.0, 0, ""))
            label = label if share >= 0.6 else ""
        out.append(label)
    return out


def annotated_lines(html: str, text: str) -> str:
    lines = [x.strip() for x in text.split("\n") if x.strip()]
    return "\n".join(f"<lid:{i}{'|' + n if n else ''}> {x}" for i, (n, x) in enumerate(zip(attributed(html, lines), lines), 1))


@F.pandas_udf(StringType())
def annotated(html: pd.Series, text: pd.Series) -> pd.Series:
    """Numbered lines of a text with the labels of the blocks that they come from."""
    return pd.Series([None if t is None else annotated_lines(h or "", t) for h, t in zip(html, text)], dtype=object)


def _each(f):
    def run(s: pd.Series) -> pd.Series:
        out = []
        for html in s:
            try:
                out.append(None if html is None else f(read_lines(html)))
            except Exception:  # a page that cannot be parsed is a page without text, as a failed render is
                out.append(None)
        return pd.Series(out, dtype=object)

    return run


render = F.pandas_udf(_each(lambda lines: "\n".join(t for _, _, t in lines)), StringType())
main_content = F.pandas_udf(_each(lambda lines: "\n".join(t for _, b, t in lines if not b and (len(t) >= 25 or t.endswith((".", "!", "?"))))), StringType())
labelled = F.pandas_udf(_each(lambda lines: "\n".join(f"<lid:{i}|{n}> {t}" for i, (n, _, t) in enumerate(lines, 1))), StringType())


@F.pandas_udf(StringType())
def unescape(s: pd.Series) -> pd.Series:
    import html

    return s.map(lambda x: None if x is None else html.unescape(x))


def norm_head(c, n: int = 600):
    """The start of a page as lower-case words: 20,000 characters, tags as spaces, entities resolved."""
    from millrace.functions.text import collapse

    return F.substring(F.lower(collapse(unescape(F.regexp_replace(F.substring(c, 1, 20000), "<[^>]+>", " ")))), 1, n)
