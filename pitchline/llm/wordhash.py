"""Vectorised word and shingle hashing over Arrow string arrays.

Words are the runs of bytes other than space and ``\\t\\n\\v\\f\\r``, with A-Z
lower-cased.  Every word gets a 64-bit hash without any per-word Python: a random
value per byte times the power of its position, prefix-summed over the chunk, so
that a word's hash is one difference times the inverse power of its start.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(0, 2**64, 256, dtype=U)
_BYTE[ord("A") : ord("Z") + 1] = _BYTE[ord("a") : ord("z") + 1]
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BASE = int(_RNG.integers(0, 2**63, dtype=np.int64)) * 2 + 1
_UNBASE = pow(_BASE, -1, 2**64)
_STEP = _RNG.integers(0, 2**63, 64, dtype=U) * U(2) + U(1)
#: Text bytes hashed at a time; a longer text makes a chunk of its own.
CHUNK_BYTES = 1 << 18
_powers = [np.ones(1, U), np.ones(1, U)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose output bits depend on all input bits."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _UNBASE)):
            p = np.ones(max(n, CHUNK_BYTES + 1), U)
            done = 1
            while done < len(p):  # p[done:2*done] = p[:done] * base**done
                m = min(done, len(p) - done)
                p[done : done + m] = p[:m] * U(pow(base, done, 2**64))
                done += m
            _powers[k] = p
    return _powers[0][:n], _powers[1][:n]


def ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Concatenation of start[i] .. start[i] + size[i] - 1."""
    ends = np.cumsum(size)
    return np.repeat(start - ends + size, size) + np.arange(int(ends[-1]) if len(ends) else 0)


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a string array; null counts as empty."""
    texts = texts.fill_null("").cast(pa.large_string())
    n = len(texts)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def chunks(texts: pa.Array, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of whole texts of about ``size`` bytes."""
    data, off = buffers(texts)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(off, off[at] + size, "right")) - 1)
        yield at, to, data[off[at] : off[to]], off[at : to + 1] - off[at]
        at = to


def word_bounds(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and for every text the index of its first word (with an end)."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    space = _SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    before = np.empty(n, bool)
    before[0] = True
    before[1:] = space[:-1]
    after = np.empty(n, bool)
    after[-1] = True
    after[:-1] = space[1:]
    starts = np.flatnonzero(~space & (before | edge[:-1]))
    ends = np.flatnonzero(~space & (after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, off)


def range_hashes(data: np.ndarray):
    """A function of start and end arrays that gives the hash of each byte range."""
    power, inverse = _power(len(data) + 1)
    sums = np.zeros(len(data) + 1, U)
    np.cumsum(_BYTE[data] * power[: len(data)], out=sums[1:])
    return lambda start, end: (sums[end] - sums[start]) * inverse[start]


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words, and for every text the index of its first word (with an end)."""
    starts, ends, first = word_bounds(data, off)
    h = range_hashes(data)(starts, ends)
    return mix(h + (ends - starts).astype(U) * U(0x9E3779B97F4A7C15)), first


def shingles(h: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of each text's k-word shingles, with offsets.

    A text of fewer words has its whole sequence as its one shingle; one without words has none.
    """
    n = np.diff(first)
    count = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    off = np.concatenate([[0], np.cumsum(count)])
    total = int(off[-1])
    if not total:
        return np.zeros(0, U), off
    row = np.repeat(np.arange(len(n)), count)
    at = first[row] + np.arange(total) - off[row]
    size = np.minimum(n[row], k)
    padded = np.concatenate([h, np.zeros(k, U)])
    s = size.astype(U) * U(0xD6E8FEB86659FD93)
    for j in range(k):
        part = padded[at + j] * _STEP[j]
        s += part if (size > j).all() else np.where(size > j, part, U(0))
    s = mix(s)
    for a, b in zip(off[:-1], off[1:], strict=True):
        s[a:b].sort()
    new = np.ones(total, bool)
    new[1:] = s[1:] != s[:-1]
    new[off[:-1][count > 0]] = True
    kept = np.concatenate([[0], np.cumsum(new)])
    return s[new], kept[off]
