"""Words of many texts as flat numpy arrays: boundaries, 64-bit hashes, n-grams and winnowing, without a loop over words."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Texts are worked on in slices of about so many bytes; one longer text is a slice of its own.
SLICE = 1 << 20
_ODD = np.uint64(0x9E3779B97F4A7C15)
_BYTE = np.random.default_rng(20240607).integers(1, 1 << 63, 256, np.uint64) | np.uint64(1)

#: Words are runs of bytes outside these separators.
SPACED = np.ones(256, bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False
#: Words are runs of ASCII letters, digits and everything beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
#: Lower case for A-Z alone.
FOLD = np.arange(256, dtype=np.uint8)
FOLD[0x41:0x5B] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values (the finaliser of SplitMix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def powers(n: int) -> np.ndarray:
    """The first n powers of an odd constant, modulo 2**64."""
    out = np.full(max(n, 1), _ODD)
    out[0] = 1
    return np.multiply.accumulate(out)


@dataclass
class Words:
    """starts, ends: byte positions in buf; doc: each word's text; first[i]:first[i+1]: the words of text i; h: hashes."""

    buf: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    doc: np.ndarray
    first: np.ndarray
    h: np.ndarray

    def valid(self, n: int) -> np.ndarray:
        """For each position that n words can start at: do they belong to one text?"""
        return self.doc[: len(self.doc) - n + 1] == self.doc[n - 1 :] if len(self.doc) >= n else np.zeros(0, bool)

    def ngrams(self, n: int, salt: int = 0) -> np.ndarray:
        """Hashes of n consecutive words from each position; those for which valid(n) is false mean nothing."""
        size = len(self.h) - n + 1
        if size <= 0:
            return np.zeros(0, np.uint64)
        by = np.uint64((0xD1342543DE82EF95 + 2 * salt * 0x5851F42D4C957F2D) % (1 << 64) | 1)
        out = np.full(size, np.uint64(n + 1000 * salt))
        for j in range(n):
            out *= by
            out += self.h[j : j + size]
        return mix(out)


def slices(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(lo, hi, bytes, offsets) for runs of rows of a string column; a null counts as an empty text."""
    column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + SLICE, "right")) - 1)
        yield lo, hi, buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi


def words(buf: np.ndarray, off: np.ndarray, keep: np.ndarray, fold: bool = False) -> Words:
    """The words of a slice: maximal runs of bytes that `keep` allows; fold lower-cases A-Z first."""
    b = FOLD[buf] if fold else buf
    w = keep[b]
    st, en = w.copy(), w.copy()
    st[1:] &= ~w[:-1]
    en[:-1] &= ~w[1:]
    o = off[:-1][off[:-1] < len(b)]
    st[o] = w[o]
    o = off[1:][off[1:] > 0] - 1
    en[o] = w[o]
    starts, ends = np.flatnonzero(st), np.flatnonzero(en) + 1
    first = np.searchsorted(starts, off)
    doc = np.repeat(np.arange(len(off) - 1), np.diff(first))
    if not len(starts):
        return Words(b, starts, ends, doc, first, np.zeros(0, np.uint64))
    val = np.where(keep, _BYTE, np.uint64(0))[b[starts[0] :]]
    run = np.diff(np.append(starts, len(b)))
    pos = np.arange(len(val)) - np.repeat(starts - starts[0], run)
    val *= powers(int(run.max()))[pos]
    return Words(b, starts, ends, doc, first, mix(np.add.reduceat(val, starts - starts[0])))


def winnow(g: np.ndarray, w: int) -> np.ndarray:
    """For each window of w hashes, the index of its leftmost minimum."""
    size = len(g) - w + 1
    if size <= 0:
        return np.zeros(0, np.int64)
    best, arg = g[:size].copy(), np.zeros(size, np.int64)
    for j in range(1, w):
        less = g[j : j + size] < best
        best[less] = g[j : j + size][less]
        arg[less] = j
    return arg + np.arange(size)


def anchors(x: Words, span: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Winnowing: for each window of `span` words within one text (its start), the position and hash of its smallest k-gram.

    Equal windows have equal anchors at equal places, so a shared passage of `span` words always shares one.
    """
    at = np.flatnonzero(x.valid(span))
    g = x.ngrams(k)
    if not len(at):
        return at, at, np.zeros(0, np.uint64)
    a = winnow(g, span - k + 1)[at]
    return at, a, g[a]
