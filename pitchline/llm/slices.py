"""Distinct byte slices of a chunk, each looked up once: what repeats in a text is worked out once."""

from __future__ import annotations

from collections.abc import Callable
from itertools import chain

import numpy as np

from .wordhash import U, mix, ranges

_RNG = np.random.default_rng(20240713)
_VALUE = _RNG.integers(0, 2**64, 256, dtype=U)
_STEP = int(_RNG.integers(0, 2**62)) * 2 + 1
_UNSTEP = pow(_STEP, -1, 2**64)
#: Answers that a worker remembers; beyond that it starts anew.
REMEMBERED = 150_000
_power_cache = [np.ones(1, U), np.ones(1, U)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the step and of its inverse, remembered up to a few chunks' length."""
    if len(_power_cache[0]) >= n:
        return _power_cache[0][:n], _power_cache[1][:n]
    made = []
    for base in (_STEP, _UNSTEP):
        p, done = np.ones(n, U), 1
        while done < n:
            m = min(done, n - done)
            p[done : done + m] = p[:m] * U(pow(base, done, 2**64))
            done += m
        made.append(p)
    if n <= 1 << 23:
        _power_cache[:] = made
    return made[0], made[1]


def slice_hashes(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte slice, by differences of prefix sums."""
    power, inverse = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, U)
    np.cumsum(_VALUE[data] * power[: len(data)], out=sums[1:])
    return mix((sums[start + size] - sums[start]) * inverse[start] + size.astype(U) * U(0x9E3779B97F4A7C15))


def distinct(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first slice of each kind, kind of each slice).

    Slices of one hash are compared byte by byte with the first of them; one that differs is a kind of its own.
    """
    _, pick, kind = np.unique(slice_hashes(data, start, size), return_index=True, return_inverse=True)
    own = pick[kind]
    same = size == size[own]
    check = np.flatnonzero(same & (own != np.arange(len(own))))
    differs = data[ranges(start[check], size[check])] != data[ranges(start[own[check]], size[check])]
    if differs.any():
        row = np.repeat(np.arange(len(check)), size[check])
        same[check[np.unique(row[differs])]] = False
    odd = np.flatnonzero(~same)
    kind = kind.copy()
    kind[odd] = len(pick) + np.arange(len(odd))
    return np.concatenate([pick, odd]), kind


class Lookup:
    """Ids of every slice of a chunk: ``answers(slices)`` (a tuple of ids each) is asked once for what isn't remembered."""

    def __init__(self, answers: Callable[[list[bytes]], list[tuple[int, ...]]]) -> None:
        self.answers, self.known = answers, {}

    def ids(self, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all slices, one after the other, and the number of each slice's ids."""
        found, kind = self.found(data, start, size)
        many = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter(chain.from_iterable(found), np.int32, int(many.sum()))
        first = np.cumsum(many) - many
        return flat[ranges(first[kind], many[kind])], many[kind]

    def found(self, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[list[tuple[int, ...]], np.ndarray]:
        """The answers of the distinct slices, and the kind of each slice."""
        pick, kind = distinct(data, start, size)
        if len(self.known) > REMEMBERED:
            self.known = {}
        raw, known = data.tobytes(), self.known
        slices = [raw[a : a + n] for a, n in zip(start[pick].tolist(), size[pick].tolist(), strict=True)]
        new = [x for x in dict.fromkeys(slices) if x not in known]
        known.update(zip(new, self.answers(new), strict=True))
        return [known[x] for x in slices], kind
