"""Distinct word shingles and MinHash signatures of whole texts, a block of documents at a time.

Words are runs of bytes other than ASCII white space, A-Z in lower case.  A word's hash is
a random polynomial over its bytes, a shingle's hash a polynomial over its words' hashes,
both 64 bits wide; sets are compared by these hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[ord("A") : ord("Z") + 1] = _BYTE[ord("a") : ord("z") + 1]
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _power(which: str, base: np.uint64, n: int) -> np.ndarray:
    if len(_powers[which]) < n:
        _powers[which] = np.concatenate((np.ones(1, np.uint64), np.cumprod(np.full(n - 1, base, np.uint64))))
    return _powers[which][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and where each text's words start (one more than texts)."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    buffers = texts.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(buffers[2], np.uint8)[offsets[0] : offsets[-1]] if buffers[2] is not None else np.zeros(0, np.uint8)
    at = offsets - offsets[0]
    if not len(raw):
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    word = ~_SPACE[raw]
    first = word.copy()
    first[1:] &= ~word[:-1]
    heads = at[:-1][at[:-1] < at[1:]]  # a text begins a word even where the one before ended in one
    first[heads] = word[heads]
    last = word.copy()
    last[:-1] &= ~word[1:] | first[1:]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE[raw] * _power("up", _BASE, len(raw)))))
    hashes = mix((total[ends] - total[starts]) * _power("down", _INVERSE, len(raw))[starts])
    return hashes, np.searchsorted(starts, at)


def shingle_sets(texts: pa.Array, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, in one array, and where each text's begin.

    A text with fewer than ``width`` words, but some, has its whole sequence as its only shingle.
    """
    words, at = word_hashes(texts)
    factor = np.uint64(0xD6E8FEB86659FD93)
    rolled = np.zeros(max(len(words) - width + 1, 0), np.uint64)
    for i in range(width):
        rolled = rolled * factor + words[i : len(words) - width + 1 + i]
    rolled = mix(rolled)
    sets = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= width:
            sets.append(np.unique(rolled[a : b - width + 1]))
        elif b > a:
            h = np.uint64(b - a)
            with np.errstate(over="ignore"):
                for w in words[a:b]:
                    h = h * factor + w
            sets.append(mix(np.array([h ^ np.uint64(0xA5A5A5A5A5A5A5A5)], np.uint64)))
        else:
            sets.append(np.zeros(0, np.uint64))
    return (np.concatenate(sets) if sets else np.zeros(0, np.uint64)), np.concatenate(([0], np.cumsum([len(s) for s in sets], dtype=np.int64)))


def signatures(flat: np.ndarray, at: np.ndarray, coordinates: int, seed: int = 7) -> np.ndarray:
    """MinHash: a row of ``coordinates`` 32-bit minima for each set; rows of empty sets are zero."""
    rng = np.random.default_rng(seed)
    factors = rng.integers(0, 1 << 63, coordinates, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    out = np.zeros((len(at) - 1, coordinates), np.uint64)
    live = np.flatnonzero(np.diff(at) > 0)
    if len(live):
        for c, f in enumerate(factors):
            h = flat * f
            h ^= h >> np.uint64(29)
            h *= np.uint64(0xBF58476D1CE4E5B9)
            out[live, c] = np.minimum.reduceat(h >> np.uint64(32), at[live])
    return out


def fingerprints(flat: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums over each set: equal sets have equal ones."""
    a = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(flat + np.uint64(0x1234567)))))
    b = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(flat ^ np.uint64(0x9E3779B97F4A7C15)))))
    return (a[at[1:]] - a[at[:-1]]), (b[at[1:]] - b[at[:-1]])
