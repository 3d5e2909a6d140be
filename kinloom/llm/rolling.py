"""Hashes of every stretch of a byte array, from running sums.

A byte's random 64-bit value times the power of an odd number for its place is summed with
wrap-around; a stretch's hash is the difference of two sums, brought back to place zero by the
inverse power. Equal stretches have equal hashes wherever they stand. Two such functions together
give 128 bits.
"""

from __future__ import annotations

import numpy as np

#: Bytes that one pair of sums covers: tables of powers reach so far.
REACH = 1 << 19


class Roller:
    """One of the hash functions, by its seed."""

    def __init__(self, seed: int):
        rng = np.random.default_rng(seed)
        self.values = rng.integers(0, 1 << 64, 256, dtype=np.uint64)
        base = int(rng.integers(0, 1 << 62, dtype=np.uint64)) * 8 + 5
        self.powers = self._powers(base)
        self.inverses = self._powers(pow(base, -1, 1 << 64))

    @staticmethod
    def _powers(base: int) -> np.ndarray:
        out = np.full(REACH + 1, base, np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)

    def sums(self, data: np.ndarray) -> np.ndarray:
        """Sums before each byte of data, and after the last; data has at most REACH bytes."""
        out = np.zeros(len(data) + 1, np.uint64)
        values = self.values[data]
        values *= self.powers[: len(data)]
        np.cumsum(values, out=out[1:])
        return out

    def hashes(self, sums: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of the stretches from begin to before end."""
        return (sums[end] - sums[begin]) * self.inverses[begin]


def mixed(x: np.ndarray) -> np.ndarray:
    """x with its bits spread, so that any part of them can serve as a hash."""
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The least of x[i : i + width] for every i, by doubling."""
    out, have = x, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
