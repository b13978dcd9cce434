"""Word and shingle hashes of whole texts, a batch at a time in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_ODD = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the input moves every bit of the output."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _ODD)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True
_INVERSE = np.uint64(pow(int(_ODD), -1, 1 << 64))
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the odd base and of its inverse modulo 2^64."""
    if len(_powers[0]) < n:
        for i, base in enumerate((_ODD, _INVERSE)):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _powers[i] = np.cumprod(steps)
    return _powers[0][:n], _powers[1][:n]


def forget_powers() -> None:
    """Free the powers kept for the longest input so far: the worker lives on."""
    _powers[:] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the words of all texts, number of words of each text).

    Words are runs of anything but blanks, with A-Z in lower case.  The hash of a word is a
    polynomial over its bytes, read off running sums, and finalised.  NULL has no words.
    """
    texts = texts.cast(pa.large_binary())
    sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(texts), 0), np.int64)
    if not sizes.sum():
        return np.zeros(0, np.uint64), np.zeros(len(sizes), np.int64)
    data = np.frombuffer(b"".join(v for v in texts.to_pylist() if v), np.uint8)
    blank = _BLANK[data]
    word = ~blank
    starts, ends = word.copy(), word.copy()
    starts[1:] &= blank[:-1]
    ends[:-1] &= blank[1:]
    at = np.cumsum(sizes)
    edges = at[:-1][(at[:-1] < len(data)) & (at[:-1] > 0)]
    starts[edges] = word[edges]
    ends[edges - 1] = word[edges - 1]
    first, last = np.flatnonzero(starts), np.flatnonzero(ends)
    power, inverse = _power(len(data))
    running = _BYTE[_LOWER[data]]
    running *= power
    np.cumsum(running, out=running)
    hashes = running[last]
    hashes[first > 0] -= running[first[first > 0] - 1]
    hashes = mix(hashes * inverse[first] + (last - first).astype(np.uint64))
    return hashes, np.diff(np.searchsorted(first, np.concatenate([[0], at])))


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the runs of ``n`` neighbouring words, in order."""
    total = np.full(len(words) - n + 1, n, np.uint64)
    for i in range(n):
        total = mix(total * _ODD + words[i : len(words) - n + 1 + i])
    return total


def longer_hashes(hashes: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Hashes of runs that are one word longer: of ``hashes[i]`` and then ``words[i]``."""
    return mix(hashes[: len(words)] * _ODD + words)


def shingle_sets(texts: pa.Array, n: int) -> Iterator[np.ndarray]:
    """Each text's distinct shingles of ``n`` words, sorted; fewer words are one shingle."""
    words, counts = word_hashes(texts)
    grams = gram_hashes(words, n) if len(words) >= n else words[:0]
    at = 0
    for count in counts:
        if count >= n:
            yield np.unique(grams[at : at + count - n + 1])
        elif count:
            yield gram_hashes(words[at : at + count], int(count))
        else:
            yield words[:0]
        at += count
