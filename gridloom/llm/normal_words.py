"""Normal words of texts: runs of ASCII digits, lower-cased ASCII letters and all that is
not ASCII, found in the UTF-8 bytes of a whole column at once.

Only A-Z are lower-cased. A null text has no words. What is made beside the bytes is a few
bytes for each of them and some 40 for each word, so a caller cuts its batches with ``pieces``.
"""

from __future__ import annotations

import zlib
from functools import cache

import numpy as np
import pyarrow as pa

from gridloom.llm.common import text_bytes
from gridloom.llm.shingles import mix, powers

#: The same words for a regular expression over lower-cased text.
PATTERN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_IN_WORD = np.zeros(256, bool)
_IN_WORD[[*b"0123456789abcdefghijklmnopqrstuvwxyz"]] = True
_IN_WORD[128:] = True
#: Words of up to so many bytes are hashed together, longer ones each.
LONG = 255
_BASE = 0x9E3779B97F4A7C15


def word_spans(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The lower-cased bytes and the rows' bounds in them, the words' starts and stops, and
    the rows' bounds among the words."""
    data, ends = text_bytes(texts)
    data = _LOWER[data]
    if not len(data):
        none = np.empty(0, np.int64)
        return data, ends, none, none, np.zeros(len(ends), np.int64)
    word = _IN_WORD[data]
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    # a row's edge parts words that touch it
    inner = ends[(ends > 0) & (ends < len(data))]
    first[inner] = word[inner]
    last[inner - 1] = word[inner - 1]
    start, stop = np.flatnonzero(first), np.flatnonzero(last) + 1
    return data, ends, start, stop, np.searchsorted(start, ends)


def word_hashes(data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word; equal words of any column have equal ones."""
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(_BASE, len(data)), out=total[1:])
    return mix((total[stop] - total[start]) * powers(pow(_BASE, -1, 1 << 64), len(data))[start] ^ (stop - start).astype(np.uint64))


@cache
def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1).astype(np.uint32)
    return t


def _append(crc: np.ndarray, byte: np.ndarray | int) -> np.ndarray:
    return _crc_table()[(crc ^ byte) & 255] ^ (crc >> np.uint32(8))


@cache
def _shifts() -> np.ndarray:
    """``[n, j, b]``: what n zero bytes make of the byte b of a checksum's place j."""
    at = (np.arange(256, dtype=np.uint32)[None, :] << np.array([[0], [8], [16], [24]], np.uint32)).astype(np.uint32)
    out = [at]
    for _ in range(LONG):
        out.append(_append(out[-1], 0))
    return np.stack(out)


def crc32(data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """The CRC-32 of the bytes of each word: a step takes the next byte of all words that have
    one."""
    size = np.minimum(stop - start, LONG + 1).astype(np.uint16)
    order = np.argsort(size, kind="stable")[::-1]
    at = start[order]
    left = len(size) - np.cumsum(np.bincount(size, minlength=LONG + 2))  # words longer than each size
    crc = np.full(len(size), 0xFFFFFFFF, np.uint32)
    for k in range(int(min(size.max(initial=0), LONG))):
        m = left[k]
        crc[:m] = _append(crc[:m], data[at[:m] + k])
    out = np.empty(len(size), np.uint32)
    out[order] = ~crc
    for i in np.flatnonzero(size > LONG).tolist():
        out[i] = zlib.crc32(data[start[i] : stop[i]])
    return out


def crc32_pairs(data: np.ndarray, start: np.ndarray, stop: np.ndarray, crc: np.ndarray) -> np.ndarray:
    """The CRC-32 of each word, a space and the word after it, put together from the words'."""
    lead = ~_append(~crc[:-1], ord(" "))
    size = stop[1:] - start[1:]
    n, shifts = np.minimum(size, LONG), _shifts()
    out = crc[1:].copy()
    for j in range(4):
        out ^= shifts[n, j, (lead >> np.uint32(8 * j)) & 255]
    for i in np.flatnonzero(size > LONG).tolist():
        out[i] = zlib.crc32(data[start[i + 1] : stop[i + 1]], int(lead[i]))
    return out
