"""Exact token ids of whole texts through the tokenizers library, at several times the speed of encoding texts whole.

The byte-level pre-tokenizer never lets a token cross certain places, so texts are cut there, each distinct piece of some
MB of text is looked up once and encoded by the library if it is new, and the ids are dealt out by the pieces' numbers:
- before white space that follows another character: a single space there starts the next token, and of a longer run
  all but its last character is a token of its own, the last one starts the next token only if it is a space;
- between letters and the ASCII punctuation that ends a piece.
Words of Latin letters are one pre-token each, so they go to the library's model many at a time, already in byte
letters; all other pieces go through the whole library.

The caches are bounded by bytes, long pieces are not kept, and long texts are worked off in blocks, so the memory that
a worker takes does not grow with the corpus, whatever its texts are.
"""

from __future__ import annotations

import re

#: A piece that needs only the model: letters of Latin-1, then ASCII punctuation; behind a line break or, unmarked, a space.
_PLAIN = re.compile(r"(\n?)([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-/:-@\[-`{-~]*)")
#: Between letters and punctuation.
_CLOSING = re.compile(r"(?<=[^ !-/:-@\[-`{-~])(?=[!-/:-@\[-`{-~])")
#: Runs of common white space, and what is between them.
_RUNS = re.compile(r"[ \t\n\r]+|[^ \t\n\r]+")
#: White space, in the widest sense, beside the common kinds.
_RARE = re.compile(r"[^\S \t\n\r]")
_CUT = re.compile(r"(?<=\S)(?=\s)")
#: Bytes of one generation of a worker's cache. A full generation becomes the old one, whose pieces are taken over when
#: they are met again.
CACHE = 112 << 20
ENTRY = 170  #: bytes that an entry takes beside its characters, about
LONG = 64  #: characters of a piece that is not kept
BLOCK = 1 << 20  #: characters of a text that are worked off at once
TOGETHER = 4 * BLOCK  #: characters of texts whose distinct pieces are looked up together
MARK = "\x01"
_BEFORE = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") | {chr(c) for c in range(0xC0, 0x100) if c not in (0xD7, 0xF7)}
_LOADED: dict = {}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def blocks(text: str, most: int = BLOCK):
    """Cuts a text before white space that follows another character, into parts of about `most` characters."""
    at = 0
    while len(text) - at > most:
        cut = _CUT.search(text, at + most)
        if cut is None:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:] if at else text


def _apart(text: str) -> str:
    """Sets a comma or full stop behind a letter or digit apart from its word, before a space: what then begins with
    MARK stands for itself without a space. Few words differ only by that, so fewer pieces are distinct."""
    s = text.replace(", ", f" {MARK}, ").replace(". ", f" {MARK}. ")
    parts = s.split(" " + MARK)
    if len(parts) == 1:
        return text
    unsure = [i for i, p in enumerate(parts[:-1]) if p[-1:] not in _BEFORE]
    for i in reversed(unsure):
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return (" " + MARK).join(parts) if unsure else s


class Pieces:
    """Encodes texts to little-endian unsigned 32-bit ids, as bytes, from the ids of their pieces.

    A subclass gives `special`, the special tokens, `_whole`, the ids of any text, and `_words`, those of many words of Latin letters with closing
    punctuation, all with one space before them or all with none.
    """

    def __init__(self):
        self.cache: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.size = 0
        self.tails: dict[str, bytes] = {"": b""}
        self.line = self._whole("\n")

    @classmethod
    def of(cls, path: str):
        """One encoder a worker process, kept from task to task."""
        if (cls, path) not in _LOADED:
            _LOADED.clear()
            _LOADED[cls, path] = cls(path)
        return _LOADED[cls, path]

    def _tail(self, marks: str) -> bytes:
        known = self.tails.get(marks)
        if known is None:
            known = self._whole(marks)
            if len(marks) <= 8 and len(self.tails) < 50_000:
                self.tails[marks] = known
        return known

    def _learn(self, found: list[str]) -> dict[str, bytes]:
        """Ids of all of `found` but those with white space inside: a piece stands for itself behind a space, or behind
        a line break that it then begins with. Only short ones go into the cache."""
        if self.size > CACHE:
            self.cache, self.old, self.size = {}, self.cache, 0
        match, line = _PLAIN.fullmatch, self.line
        keys, values, plain, heads, closed = [], [], [], [], []
        if self.old:
            before = list(map(self.old.get, found))
            keys, values = [p for p, known in zip(found, before) if known is not None], [known for known in before if known is not None]
            found = [p for p, known in zip(found, before) if known is None]
        for p in found:
            if p.isascii() and p.isalpha():
                plain.append(p)
            elif (m := match(p)):
                (heads if p[0] == "\n" else closed if m[3] else plain).append(p)
            elif p[:1] == MARK and len(p) == 2:
                keys.append(p)
                values.append(self._whole(p[1]))
            else:
                body = p[1:] if p[:1] == "\n" else p
                if body.split() == [body]:
                    keys.append(p)
                    values.append(line + self._whole(body) if p[0] == "\n" else self._whole(" " + p))
        keys += heads
        values += [line + x for x in self._words([p[1:] for p in heads], "")]
        plain += closed
        keys += plain
        values += self._words(plain, " ")
        learned = dict(zip(keys, values))
        self.cache.update(learned)
        for p in [p for p in keys if len(p) > LONG]:
            del self.cache[p]
            self.size -= len(p) + len(learned[p]) + ENTRY
        self.size += sum(map(len, keys)) + sum(map(len, values)) + ENTRY * len(keys)
        return learned

    def _looked_up(self, distinct: list[str]) -> list[bytes | None]:
        out = list(map(self.cache.get, distinct))
        if None in out:
            learned = self._learn([p for p, known in zip(distinct, out) if known is None])
            out = [learned.get(p) if known is None else known for p, known in zip(distinct, out)]
        return out

    def _odd_text(self, text: str) -> bytes:
        """A text with runs of white space, or with white space other than spaces and line breaks. A run is not told
        apart from its last character before a special token, so texts with one are cut at white space only."""
        if _RARE.search(text) or MARK in text or any(t in text for t in self.special):
            return b"".join(map(self._whole, _CUT.split(text)))
        runs = _RUNS.findall(text)
        first = 0 if runs[0][0] not in " \t\n\r" else 1
        out: list = [None] * len(runs)
        keys, places = [], []
        for i in range(first, len(runs), 2):
            before = runs[i - 1] if i else "\n"
            keys.append(runs[i] if before[-1] == " " else "\n" + runs[i])
            places.append(i)
        distinct = list(dict.fromkeys(keys))
        known = dict(zip(distinct, self._looked_up(distinct)))
        for i, k in zip(places, keys):
            out[i] = known[k] if k[0] != "\n" else known[k][len(self.line) :]
        for i in range(1 - first, len(runs), 2):
            space = runs[i]
            if i + 1 == len(runs):
                out[i] = self._tail(space)
            elif space[-1] == " ":
                out[i] = self._tail(space[:-1])
            else:
                out[i] = self._tail(space[:-1]) + self._tail(space[-1])
        return b"".join(out)

    def encode(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = []
        some, owner, size = [], [], 0
        parts: list[list[bytes]] = [[] for _ in texts]
        for k, text in enumerate(texts):
            for part in blocks(text) if len(text) > BLOCK else (text,):
                if size and size + len(part) > TOGETHER:
                    self._encoded(some, owner, parts)
                    some, owner, size = [], [], 0
                some.append(part)
                owner.append(k)
                size += len(part)
        if some:
            self._encoded(some, owner, parts)
        for own in parts:
            out.append(own[0] if len(own) == 1 else b"".join(own))
        return out

    def _encoded(self, some: list[str], owner: list[int], parts: list[list[bytes]]) -> None:
        """Puts the ids of parts of texts to their owners. A part that goes on with a text begins with white space; one
        that begins a text is put behind a line break, whose ids are taken off again."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        marked, counts, last = [], [], None
        for part, k in zip(some, owner):
            starts = k != last and not parts[k]
            last = k
            if MARK in part:
                counts.append((0, starts))
                continue
            s = _apart(part.replace("\n", " \n"))
            if starts:
                s = " \n" + s
            elif s[0] != " ":
                s = " " + s
            marked.append(s)
            counts.append((s.count(" "), starts))
        flat = pc.split_pattern(pa.array(["".join(marked)[1:]], pa.large_string()), " ").flatten().dictionary_encode()
        known = self._looked_up(flat.dictionary.to_numpy(zero_copy_only=False).tolist())
        ids = pa.array(known, pa.large_binary()).take(flat.indices)
        _, ends, data = ids.buffers()
        ends, data = np.frombuffer(ends, dtype=np.int64), memoryview(data or b"")
        odd = np.flatnonzero(ids.is_null().to_numpy(zero_copy_only=False)) if ids.null_count else ()
        at, skip = 0, len(self.line)
        for part, k, (n, starts) in zip(some, owner, counts):
            first, at = at, at + n
            if not part:
                parts[k].append(b"")
            elif not n or len(odd) and np.searchsorted(odd, first) < np.searchsorted(odd, at):
                parts[k].append(self._odd_text(part))
            else:
                parts[k].append(bytes(data[ends[first] + skip * starts : ends[at]]))


class Encoder(Pieces):
    """Asks the tokenizers library."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = t = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
        self.model = Tokenizer(t.model)
        self.special = {x.content: i for i, x in t.get_added_tokens_decoder().items()}
        self.letters = {b: c for c, b in byte_letters().items()}
        vocab = t.get_vocab(with_added_tokens=False)
        merged = {c for token in vocab if len(token) > 1 for c in token}
        alone = [c for b, c in self.letters.items() if b < 32 and c in vocab and c not in merged]
        self.marks = [] if getattr(t.model, "ignore_merges", True) else [(c, vocab[c]) for c in sorted(alone)[:2]]
        self.spaced = self.letters | {32: " "}
        super().__init__()

    def _whole(self, text: str) -> bytes:
        import numpy as np

        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _words(self, new: list[str], before: str) -> list[bytes]:
        """Ids of the words, some dozens as one text in byte letters that goes to the model unsplit. Between words, and
        before their closing punctuation, stand two control characters of which no token but their own has any, so no
        merge crosses them."""
        import numpy as np

        if len(self.marks) < 2:
            return [self._whole(before + p) for p in new]
        out: list[bytes] = []
        lead = before and self.letters[32]
        (end, end_id), (inner, inner_id) = self.marks
        for k in range(0, len(new), 16_384):
            some = new[k : k + 16_384]
            texts = [" ".join(some[i : i + 64]) for i in range(0, len(some), 64)]
            closing = [not t.replace(" ", "").isalpha() for t in texts]
            texts = [t if t.isascii() else t.encode().decode("latin-1").translate(self.spaced) for t in texts]
            texts = [_CLOSING.sub(inner, t) if some_close else t for t, some_close in zip(texts, closing)]
            texts = [lead + t.replace(" ", end + lead) + end for t in texts]
            found = self.model.encode_batch_fast(texts, add_special_tokens=False)
            ids = np.concatenate([np.array(x.ids, dtype="<u4") for x in found])
            ended = ids == end_id
            kept = ~ended & (ids != inner_id)
            data, at = ids[kept].tobytes(), 0
            for e in (4 * np.cumsum(kept)[ended]).tolist():
                out.append(data[at:e])
                at = e
        return out
