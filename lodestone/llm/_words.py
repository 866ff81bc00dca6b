"""Vectorised words of texts: spans, 64-bit hashes, phrase hashes and winnowing, all in numpy.

A word is a maximal run of letters and digits (Unicode, folded to lower case one code point
at a time); each ideograph is a word by itself. Spans are code-point offsets in the original
text, so they index a Python string and Spark's ``substring`` alike.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np

#: Code points handled at once: small enough for the working arrays to stay in cache.
CHUNK = 1 << 19
_MULT, _PHRASE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95)


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64: a bijection whose bits all depend on all bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _tables() -> tuple[np.ndarray, np.ndarray]:
    kind, fold = np.zeros(0x10000, np.uint8), np.arange(0x10000, dtype=np.uint32)
    for c in range(0x10000):
        s = chr(c)
        if s.isalnum():
            kind[c] = 1
            if len(low := s.lower()) == 1 and ord(low) < 0x10000:
                fold[c] = ord(low)
    for a, b in ((0x2E80, 0xA000), (0xAC00, 0xD7A4), (0xF900, 0xFB00)):
        kind[a:b][kind[a:b] == 1] = 2
    return kind, fold


KIND, FOLD = _tables()
_LETTER = mix(FOLD.astype(np.uint64) + np.uint64(1) << np.uint64(17))


def _inverse(x: int) -> int:
    return pow(x, -1, 1 << 64)


class _Powers:
    """Powers of an odd number and of its inverse, modulo 2**64, grown on demand."""

    def __init__(self, base: np.uint64):
        self.base, self.inv, self.up, self.down = base, np.uint64(_inverse(int(base))), None, None

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if self.up is None or len(self.up) < n:
            size = max(n, CHUNK + 1)
            for name, b in (("up", self.base), ("down", self.inv)):
                x = np.full(size, b, np.uint64)
                x[0] = 1
                setattr(self, name, np.cumprod(x))
        return self.up[:n], self.down[:n]


_CHARS, _WORDS = _Powers(_MULT), _Powers(_PHRASE)


def codes(texts: Sequence[str]) -> np.ndarray:
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")


@dataclass
class Words:
    """Words of some documents: those of document i are ptr[i]:ptr[i + 1]."""

    ptr: np.ndarray
    start: np.ndarray  # code-point offset in the document
    end: np.ndarray
    hash: np.ndarray
    offset: np.ndarray  # where each document starts in ``codes``
    codes: np.ndarray

    def __len__(self) -> int:
        return len(self.ptr) - 1

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self)), np.diff(self.ptr))


def words(texts: Sequence[str | None]) -> Words:
    """Words of documents; a null text has none."""
    texts = [t or "" for t in texts]
    lens = np.fromiter(map(len, texts), np.int64, len(texts))
    offset = np.concatenate(([0], np.cumsum(lens)))
    c = codes(texts)
    n = len(c)
    if n and c.max() >= 0x10000:
        low = np.where(c < 0x10000, c, 0)
        big = c >= 0x10000
        kind = np.where(big, np.where(c >= 0x20000, 2, 1), KIND[low]).astype(np.uint8)
        kind[(c >= 0x1F000) & (c < 0x20000)] = 0  # pictographs
        letter = np.where(big, mix(c.astype(np.uint64) + np.uint64(1) << np.uint64(17)), _LETTER[low])
    else:
        kind, letter = KIND[c], _LETTER[c]
    up, down = _CHARS(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(np.where(kind > 0, letter, np.uint64(0)) * up[:n], out=total[1:])
    inside = kind > 0
    starts, ends = inside.copy(), inside.copy()
    starts[1:] &= ~inside[:-1] | (kind[1:] == 2) | (kind[:-1] == 2)
    ends[:-1] &= ~inside[1:] | (kind[1:] == 2) | (kind[:-1] == 2)
    cut = offset[1:-1]
    cut = cut[(cut > 0) & (cut < n)]
    starts[cut] = inside[cut]
    ends[cut - 1] = inside[cut - 1]
    s, e = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    h = mix((total[e] - total[s]) * down[s])
    ptr = np.searchsorted(s, offset)
    base = np.repeat(offset[:-1], np.diff(ptr))
    return Words(ptr, s - base, e - base, h, offset, c)


def chunks(texts: Sequence[str | None], most: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about ``most`` code points; a longer document stands alone."""
    begin = total = 0
    for i, t in enumerate(texts):
        n = len(t or "")
        if total and total + n > most:
            yield begin, i
            begin, total = i, 0
        total += n
    if begin < len(texts):
        yield begin, len(texts)


def phrases(w: Words, k: int) -> np.ndarray:
    """Hash of the k words from each word on; where the document ends earlier the value means nothing."""
    n = len(w.hash)
    up, down = _WORDS(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(w.hash * up[:n], out=total[1:])
    out = np.zeros(n, np.uint64)
    if n >= k:
        out[: n - k + 1] = mix((total[k:] - total[: n - k + 1]) * down[: n - k + 1] + np.uint64(k))
    return out


def left(w: Words) -> np.ndarray:
    """How many words the document has from each word on, itself included."""
    return np.repeat(w.ptr[1:], np.diff(w.ptr)) - np.arange(len(w.hash))


def _slide(x: np.ndarray, w: int, op: np.ufunc) -> np.ndarray:
    """op over x[i : i + w], for all i that have w values, by doubling."""
    span, out = 1, x
    while span * 2 <= w:
        out = op(out[:-span], out[span:])
        span *= 2
    if span < w:
        out = op(out[: len(out) - (w - span)], out[w - span :])
    return out


def winnow(w: Words, k: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Chosen word positions and phrase hashes: the minima of every ``window`` adjacent k-word phrases.

    Any k + window - 1 words that two documents share hold a phrase chosen in both, at the
    same place. A document of fewer words has none chosen. Equal minima are all chosen. The
    choice within a document depends on nothing outside it.
    """
    n = len(w.hash)
    if n < k + window - 1:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = phrases(w, k)
    whole = left(w)[: n - window + 1] >= k + window - 1
    low = np.where(whole, _slide(h, window, np.minimum), np.uint64(0))
    pad = np.zeros(window - 1, np.uint64)
    high = _slide(np.concatenate((pad, low, pad)), window, np.maximum)
    at = np.flatnonzero((high == h) & (left(w) >= k) & (high > 0))
    return at, h[at]
