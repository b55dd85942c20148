"""Hashed word shingles of texts, made a column at a time."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from gridloom.llm.common import text_bytes

WORDS = 5
_P = 0x9E3779B97F4A7C15
_INVERSE = pow(_P, -1, 1 << 64)


def mix(h: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads them evenly."""
    h = h ^ np.uint64(salt)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def powers(p: int, n: int) -> np.ndarray:
    out = np.full(n, p, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words, and the rows' bounds in them."""
    data, ends = text_bytes(texts)
    if not len(data):
        return np.empty(0, np.uint64), np.zeros(len(ends), np.int64)
    word = ~((data == 32) | ((data >= 9) & (data <= 13)))
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    inner = ends[(ends > 0) & (ends < len(data))]
    first[inner] = word[inner]
    last[inner - 1] = word[inner - 1]
    start, stop = np.flatnonzero(first), np.flatnonzero(last) + 1
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(_P, len(data)), out=total[1:])
    h = (total[stop] - total[start]) * powers(_INVERSE, len(data))[start]
    return mix(h), np.searchsorted(start, ends)


def shingle_sets(texts: pa.Array, n: int = WORDS) -> list[np.ndarray]:
    """Per row its distinct shingle hashes, sorted; a text of fewer than ``n`` words has
    one shingle of them all, a text without words none."""
    words, ends = word_hashes(texts)
    run = np.zeros(max(len(words) - n + 1, 0), np.uint64)
    for k in range(n):
        run = run * np.uint64(0xD6E8FEB86659FD93) + words[k : k + len(run)]
    run = mix(run, 5)
    out = []
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        if b - a >= n:
            out.append(np.unique(run[a : b - n + 1]))
        elif b > a:
            h = np.zeros(1, np.uint64)
            for w in words[a:b]:
                h = h * np.uint64(0xD6E8FEB86659FD93) + w
            out.append(mix(h, b - a))
        else:
            out.append(np.empty(0, np.uint64))
    return out
