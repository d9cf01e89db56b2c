"""Byte-level BPE through a trie of distinct words.

The encoding of a byte string by ranked merges has a last token, and cutting that token off leaves exactly the
encoding of the rest. So one token id per prefix describes the encodings of all prefixes. Distinct words go into a trie
that a worker keeps from batch to batch; walking it depth first gives every node the last token of its path, found from
the states of its ancestors alone, and a prefix that many words share is worked out once. A word's encoding is read off
by stepping back from its node. All steps look at as many bytes as the longest token has, so the time is linear in the
length of a word.

A token t may follow the encoding of a prefix that ends in token s exactly when merging the bytes of s and t gives
[s, t] back. That is decided by running the merges on those few bytes, and remembered for the pair.

The work is one map over the documents: nothing is shuffled and nothing grows with the corpus but the caches, which
are bounded and start anew when full.

Defined results: a null or empty text has no ids and decodes to the empty string; rows with a null id, repeated rows
and ties each keep their own row; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import store, tokens

WORDS = 64 << 20  #: bytes of the words that are remembered, about
PAIRS = 1_500_000  #: pairs of tokens that are remembered
NODES = 400_000  #: nodes of the trie that is kept from batch to batch
LONG = 128  #: bytes of a word that is not kept
#: How the byte-level scheme splits text into words, as its public definition has it; white space by Unicode property.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"


class Codec(tokens.Pieces):
    """Encodes and decodes with the vocabulary and merges of a tokenizers file."""

    def __init__(self, path: str):
        import regex

        spec = json.load(open(path, encoding="utf-8"))
        letters = tokens.byte_letters()
        raw = lambda t: bytes(letters[c] for c in t)
        vocab = {raw(t): i for t, i in spec["model"]["vocab"].items() if all(c in letters for c in t)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.merge = {}
        for rank, m in enumerate(spec["model"]["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            self.merge[vocab[raw(a)], vocab[raw(b)]] = (rank, vocab[raw(a) + raw(b)])
        self.byte = [vocab[bytes([b])] for b in range(256)]
        self.bytes_of = {i: t for t, i in vocab.items()} | {i: t.encode() for t, i in self.special.items()}
        self.vocab = vocab
        self.longest: dict[bytes, int] = {}  # of the tokens that end in given bytes, three or fewer
        for t in vocab:
            if len(t) >= 3:
                self.longest[t[-3:]] = max(self.longest.get(t[-3:], 3), len(t))
        self.split = regex.compile(PATTERN).findall
        self.pairs: dict[int, bool] = {}
        self.words: dict[str, bytes] = {}
        self.held = 0
        self.edges: dict[int, int] = {}  # node << 8 | byte: the next node
        self.state = [-1]  # of each node: the last token of its path
        super().__init__()

    def merged(self, data: bytes) -> list[int]:
        """The defining procedure: the pair of least rank is merged first, the leftmost of equals."""
        ids = [self.byte[b] for b in data]
        while len(ids) > 1:
            best = min(((self.merge[p][0], i) for i, p in enumerate(zip(ids, ids[1:])) if p in self.merge), default=None)
            if best is None:
                break
            i = best[1]
            ids[i : i + 2] = [self.merge[ids[i], ids[i + 1]][1]]
        return ids

    def follows(self, s: int, t: int) -> bool:
        """Whether t can come right after s; s = -1 stands for the start of the word."""
        key = s << 20 | t if s >= 0 else -1 - t
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            if s < 0:
                known = self.merged(self.bytes_of[t]) == [t]
            else:
                known = (s, t) not in self.merge and self.merged(self.bytes_of[s] + self.bytes_of[t]) == [s, t]
            self.pairs[key] = known
        return known

    def learn(self, new: list[str]) -> None:
        """Puts the encodings of new words into the cache.

        The words are taken in order of their bytes, which walks their trie depth first: each goes down the nodes that
        it shares with words met before, in this batch or an earlier one, and reads their states; only the nodes that
        it adds are worked out. A word of more than LONG bytes adds none, as hardly another one would pass them."""
        import array

        if len(self.state) > NODES:
            self.edges.clear()
            del self.state[1:]
        edges, state, words, bytes_of = self.edges, self.state, self.words, self.bytes_of
        vocab, longest, follows = self.vocab, self.longest.get, self.follows
        for own, w in sorted((w.encode("utf-8", "surrogatepass"), w) for w in new):
            node, depth, n = 0, 0, len(own)
            last = array.array("i", [-1])  # the last token of each prefix
            if n <= LONG:
                for b in own:
                    nxt = edges.get(node << 8 | b)
                    if nxt is None:
                        break
                    node = nxt
                    last.append(state[node])
                depth = len(last) - 1
            while depth < n:
                depth += 1
                for size in range(min(depth, longest(own[max(0, depth - 3) : depth], 2)), 0, -1):
                    t = vocab.get(own[depth - size : depth])
                    if t is not None and follows(last[depth - size], t):
                        break
                last.append(t)
                if n <= LONG:
                    nxt = edges[node << 8 | own[depth - 1]] = len(state)
                    state.append(t)
                    node = nxt
            out = array.array("I")
            while n:
                out.append(last[n])
                n -= len(bytes_of[last[n]])
            out.reverse()
            words[w] = out.tobytes()

    def _spelt(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, word by word."""
        if self.held > WORDS:
            self.words.clear()
            self.held = 0
        plan = []
        for text in texts:
            at, own = 0, []
            if any(t in text for t in self.special):
                for i, t in self._specials(text):
                    own += [*self.split(text[at:i]), self.special[t]]
                    at = i + len(t)
            plan.append(own + self.split(text[at:]))
        new = list({w for own in plan for w in own if w.__class__ is str and w not in self.words})
        self.learn(new)
        word = self.words
        out = [b"".join([word[w] if w.__class__ is str else w.to_bytes(4, "little") for w in own]) for own in plan]
        for w in new:
            if len(w) > LONG:
                del word[w]
            else:
                self.held += len(w) + tokens.ENTRY
        return out

    def _whole(self, text: str) -> bytes:
        return self._spelt([text])[0]

    def _words(self, new: list[str], before: str) -> list[bytes]:
        return self._spelt([" " + p for p in new] if before else new)

    def _specials(self, text: str) -> list[tuple[int, str]]:
        """Places of special tokens, the leftmost first and the longest of equals."""
        out, at = [], 0
        while True:
            found = [(i, -len(s), s) for s in self.special if (i := text.find(s, at)) >= 0]
            if not found:
                return out
            i, _, s = min(found)
            out.append((i, s))
            at = i + len(s)

    def decode(self, ids: bytes) -> str:
        import numpy as np

        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, dtype="<u4").tolist())).decode("utf-8", "replace")


def encode_decode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, full: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256; with `full` also ids (binary) and decoded (the text again).

    Batches are small, as one text can be very long.
    """
    path = tokenizer or tokens.default_path()
    store.arrow_rows(docs.sparkSession, 512)

    def run(batches):
        import pyarrow as pa

        codec = Codec.of(path)
        for batch in batches:
            ids = codec.encode([t or "" for t in batch.column(1).to_pylist()])
            decoded = [codec.decode(x) for x in ids]
            cols = [batch.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()), pa.array([hashlib.sha256(x.encode()).hexdigest() for x in decoded], pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if full:
                cols += [pa.array(ids, pa.binary()), pa.array(decoded, pa.string())]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary, decoded string" * full
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)
