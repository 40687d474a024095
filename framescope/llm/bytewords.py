"""Words of many texts at once: their places in the joined bytes, their owners and 64-bit hashes, without a loop over words."""

from __future__ import annotations

import numpy as np

FACTOR = 0x9E3779B97F4A7C15
INVERSE = pow(FACTOR, -1, 1 << 64)
GROUP_BYTES = 1 << 19  # working memory is about 50 times as much


def white_space() -> np.ndarray:
    """Bytes that are part of a word if only ASCII white space separates words."""
    t = np.ones(256, bool)
    t[[9, 10, 11, 12, 13, 32]] = False
    return t


def letters(digits: bool = False) -> np.ndarray:
    """Bytes of lower-case ASCII letters and of everything beyond ASCII, with digits if wanted."""
    t = np.zeros(256, bool)
    t[97:123] = t[128:] = True
    t[48:58] = digits
    return t


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words:
    """begin, end (byte positions), owner (number of the text) of every word, in order of reading."""

    def __init__(self, texts: list[bytes], part_of_word: np.ndarray, separator: bytes = b"\n"):
        self.n_texts = len(texts)
        self.data = np.frombuffer(separator.join([*texts, b""]) or separator, np.uint8)
        inside = part_of_word[self.data]
        edge = np.flatnonzero(np.diff(inside, prepend=False, append=False))
        self.begin, self.end = edge[0::2], edge[1::2]
        ends = np.cumsum([len(t) + 1 for t in texts], dtype=np.int64)
        self.owner = np.searchsorted(ends, self.begin, side="right")
        n = len(self.data)
        self.back = np.full(n + 1, INVERSE, np.uint64)
        self.back[0] = 1
        power = np.full(n, FACTOR, np.uint64)
        power[0] = 1
        np.cumprod(self.back, out=self.back)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * np.cumprod(power), out=self.sums[1:])

    def hashes(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of byte ranges; equal bytes have equal hashes wherever they stand."""
        return mixed((self.sums[end] - self.sums[begin]) * self.back[begin])

    def word_hashes(self) -> np.ndarray:
        return self.hashes(self.begin, self.end)


def groups(texts: list[bytes]):
    """(first, end) of runs of texts of about GROUP_BYTES bytes, so that working memory doesn't depend on batch sizes."""
    first = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= GROUP_BYTES:
            yield first, i + 1
            first, size = i + 1, 0
    if first < len(texts):
        yield first, len(texts)
