"""Whole batches of texts as arrays of code points: tables, spans and rolling hashes shared by the text operators."""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np

SPACE, LETTER, NUMBER, OTHER = range(4)
# The characters with Unicode's property White_Space.
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64
BASE_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))


def slices(lengths: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of texts of at most `most` characters together; a longer text makes a range of its own."""
    start, total = 0, 0
    for k, n in enumerate(lengths.tolist()):
        if total and total + n > most:
            yield start, k
            start, total = k, 0
        total += n
    if start < len(lengths):
        yield start, len(lengths)


def decode(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all texts in a row, and where each text starts, with the end as the last entry."""
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)), out=starts[1:])
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), starts


@lru_cache(1)
def classes() -> np.ndarray:
    """SPACE, LETTER, NUMBER or OTHER for each code point, by its general category."""
    first = {"L": LETTER, "N": NUMBER}
    table = np.fromiter((first.get(unicodedata.category(chr(c))[0], OTHER) for c in range(sys.maxunicode + 1)), np.uint8, sys.maxunicode + 1)
    table[WHITE_SPACE] = SPACE
    return table


@lru_cache(1)
def folds() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Skip-and-fold tables: the case-folded code point of each letter or number, 0 for what is skipped; and, for the
    few characters that fold to several, their second and third one."""
    n = sys.maxunicode + 1
    one, two, three = np.zeros(n, np.uint32), np.zeros(n, np.uint32), np.zeros(n, np.uint32)
    kept = np.flatnonzero((classes() == LETTER) | (classes() == NUMBER))
    one[kept] = kept
    for c in kept.tolist():
        f = chr(c).casefold()
        if len(f) > 1 or ord(f) != c:
            solid = [ord(x) for x in f if unicodedata.category(x)[0] in "LN"] or [c]
            one[c] = solid[0]
            two[c] = solid[1] if len(solid) > 1 else 0
            three[c] = solid[2] if len(solid) > 2 else 0
    return one, two, three


@lru_cache(4)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(size, BASE, np.uint64), np.full(size, BASE_INVERSE, np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i up to at least n."""
    return _powers(1 << max(16, int(n).bit_length()))


def mix(h: np.ndarray) -> np.ndarray:
    """A finalizer that spreads all bits."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def prefix_hash(symbols: np.ndarray) -> np.ndarray:
    """Prefix sums from which span_hash() makes the polynomial hash of any span."""
    sums = np.zeros(len(symbols) + 1, np.uint64)
    np.cumsum((symbols.astype(np.uint64) + np.uint64(1)) * powers(len(symbols) + 1)[0][: len(symbols)], out=sums[1:])
    return sums


def span_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The hash of each span; equal spans have equal hashes wherever they are."""
    return mix((sums[ends] - sums[starts]) * powers(len(sums))[1][starts] + (ends - starts).astype(np.uint64))


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All indices of all spans, one span after the other."""
    total = int(lengths.sum())
    if not total:
        return np.empty(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)


def equal_spans(a: np.ndarray, a_starts: np.ndarray, b: np.ndarray, b_starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Whether a[a_starts:+lengths] equals b[b_starts:+lengths], for each pair of spans of equal length."""
    same = np.ones(len(lengths), bool)
    some = np.flatnonzero(lengths > 0)
    if len(some):
        n = lengths[some]
        equal = a[spread(a_starts[some], n)] == b[spread(b_starts[some], n)]
        same[some] = np.logical_and.reduceat(equal, np.cumsum(n) - n)
    return same
