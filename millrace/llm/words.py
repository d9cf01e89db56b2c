"""Words of many texts at once, as arrays: words are maximal runs of bytes other than space and 0x09 to 0x0D."""

from __future__ import annotations

SLICE = 2 << 20  #: bytes of text handled at once; a longer text is handled alone


def mix(x):
    """A bijection of 64-bit integers whose output bits all depend on all input bits."""
    import numpy as np

    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def slices(texts: list[bytes]):
    """(first, end) index ranges of texts that together hold about SLICE bytes."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > SLICE:
            yield first, i
            first, size = i, 0
        size += len(t)
    if first < len(texts):
        yield first, len(texts)


def scan(texts: list[bytes]):
    """(hashes, bounds, starts, ends, joined): 64-bit word hashes, the range of each text's words in them, the words'
    byte positions in `joined`, which is all texts with a line break behind each.

    A word's hash is a polynomial of its bytes in an odd base modulo 2**64, mixed with its length.
    """
    import numpy as np

    joined = b"\n".join(texts) + b"\n"
    data = np.frombuffer(joined, dtype=np.uint8)
    solid = ~((data == 32) | ((data >= 9) & (data <= 13)))
    edge = np.flatnonzero(np.diff(solid.view(np.int8), prepend=0))
    starts, ends = edge[0::2], edge[1::2]
    lens = ends - starts
    at = np.cumsum([0] + [len(t) + 1 for t in texts])
    bounds = np.searchsorted(starts, at)
    if not len(starts):
        return np.zeros(0, np.uint64), bounds, starts, ends, joined
    table = np.cumprod(np.full(int(lens.max()), 0x9E3779B97F4A7C15, dtype=np.uint64))
    first = np.cumsum(lens) - lens
    rel = np.arange(int(lens.sum())) - np.repeat(first, lens)
    h = np.add.reduceat((data[solid].astype(np.uint64) + np.uint64(1)) * table[rel], first)
    return mix(h + lens.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), bounds, starts, ends, joined


def grams(h, n: int):
    """Hashes of all runs of n consecutive words of the array, in order: order-sensitive and mixed."""
    import numpy as np

    m = max(0, len(h) - n + 1)
    out = np.zeros(m, dtype=np.uint64)
    factor = np.uint64(0x9E3779B97F4A7C15)
    for j in range(n):
        out = (out + h[j : j + m]) * factor
    return mix(out)
