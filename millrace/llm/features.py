"""Hashed features of words: the word itself, affixes and character n-grams, with numpy over whole batches.

Words are maximal runs of letters (a-z after lower-casing, and any byte of a non-ASCII character). An n-gram that
touches the blank before or after its word is an affix.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from millrace.llm.words import mix

LETTER = np.zeros(256, bool)
LETTER[list(b"abcdefghijklmnopqrstuvwxyz")] = True
LETTER[128:] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_PRIME = np.uint64(0x9E3779B97F4A7C15)


def letters(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts' bytes lower-cased (A-Z and the capitals of Latin-1), each text between blanks; the new offsets."""
    out = np.insert(_FOLD[data], offsets, 32)
    second = out[1:]
    second[(out[:-1] == 0xC3) & (second >= 0x80) & (second <= 0x9E) & (second != 0x97)] += 32
    return out, offsets + np.arange(len(offsets))


def words(out: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in bytes from letters()."""
    inside = LETTER[out]
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    return edge[::2], edge[1::2]


def grams(out: np.ndarray, starts: np.ndarray, ends: np.ndarray, sizes: tuple[int, ...], bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(feature ids below 2**bits, index of their word): first of the words themselves, then of the n-grams of each size."""
    if not len(starts):
        return
    inside = LETTER[out]
    shift = np.uint64(64 - bits)
    code = np.where(inside, out, 32).astype(np.uint64) + np.uint64(1)
    word = np.cumsum(np.bincount(starts, minlength=len(out))) - 1
    body = np.where(inside, mix(code * _PRIME + (np.arange(len(out)) - starts[np.maximum(word, 0)]).astype(np.uint64)), np.uint64(0))
    yield (mix(np.add.reduceat(body, starts)) >> shift).astype(np.int64), np.arange(len(starts))
    blanks = np.cumsum(~inside)
    for n in sizes:  # at least 3
        if len(out) < n:
            continue
        rolled = np.full(len(out) - n + 1, np.uint64(n))
        for j in range(n):
            rolled = rolled * _PRIME + code[j : len(out) - n + 1 + j]
        good = np.flatnonzero((blanks[n - 2 : len(out) - 1] == blanks[: len(out) - n + 1]) & inside[1 : len(out) - n + 2])
        yield (mix(rolled[good]) >> shift).astype(np.int64), word[good + 1]  # between its ends an n-gram has letters only


def sums(out: np.ndarray, starts: np.ndarray, ends: np.ndarray, sizes: tuple[int, ...], table: np.ndarray, room: int = 1 << 20) -> np.ndarray:
    """For each word the sum of its features' rows of `table`; so many bytes at a time that `room` numbers hold their rows."""
    total = np.zeros((len(starts), *table.shape[1:]), table.dtype)
    bits, step = len(table).bit_length() - 1, max(1, room // (table[0].size if len(table) else 1))
    a = 0
    while a < len(starts):
        b = max(a + 1, int(np.searchsorted(ends, starts[a] + step, "right")))
        low = starts[a] - 1  # a word stands between bytes that are no letters
        for ids, of in grams(out[low : ends[b - 1] + 1], starts[a:b] - low, ends[a:b] - low, sizes, bits):
            if len(ids):
                first = np.flatnonzero(np.diff(of, prepend=-1))
                total[a + of[first]] += np.add.reduceat(table[ids], first)
        a = b
    return total
