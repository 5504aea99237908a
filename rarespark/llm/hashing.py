"""Vectorised hashing of byte ranges.

A range's hash is a polynomial in its bytes, read from prefix sums, so every range of a buffer costs
two look-ups whatever its length; a final mixing step spreads the bits. ``Ranges`` computes modulo
2**64: quick, but texts can be made whose hashes meet, so it only serves where equality is decided
elsewhere. ``Fields`` computes modulo the prime 2**31 - 1 in two or three bases, where no
arrangement of bytes helps: 62 bits, and 31 more as a check.
"""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C17
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_POWERS: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


def _powers(name: str, base: int, n: int) -> np.ndarray:
    got = _POWERS.get(name)
    if got is None or len(got) < n:
        p = np.full(max(n, 1 << 16), base, np.uint64)
        p[0] = 1
        got = np.multiply.accumulate(p)
        if len(got) <= 1 << 21:
            _POWERS[name] = got
    return got[:n]


class Ranges:
    """Hashes of ranges of one buffer."""

    def __init__(self, buf: np.ndarray):
        n = len(buf)
        self.sums = np.zeros(n + 1, np.uint64)
        terms = buf.astype(np.uint64)
        terms += np.uint64(1)
        terms *= _powers("up", _BASE, n + 1)[:n]
        np.cumsum(terms, out=self.sums[1:])
        self.down = _powers("down", pow(_BASE, -1, 1 << 64), n + 1)

    def raw(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return (self.sums[ends] - self.sums[starts]) * self.down[starts]

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix(self.raw(starts, ends) + (ends - starts).astype(np.uint64) * _M2)

    def grams(self, size: int) -> np.ndarray:
        """The hash of every range of ``size`` bytes, by its start."""
        n = len(self.sums) - 1
        if n < size:
            return np.empty(0, np.uint64)
        return mix((self.sums[size:] - self.sums[: n - size + 1]) * self.down[: n - size + 1] + np.uint64(size * int(_M2) % (1 << 64)))


_P = np.uint64((1 << 31) - 1)
_31 = np.uint64(31)
_BASES = (1_381_592_653, 774_213_519, 1_907_440_121)


def _folded(x: np.ndarray) -> np.ndarray:
    """``x`` modulo 2**31 - 1, up to a small excess."""
    x = (x & _P) + (x >> _31)
    return (x & _P) + (x >> _31)


def _field_powers(name: str, base: int, n: int) -> np.ndarray:
    got = _POWERS.get(name)
    if got is None or len(got) < n:
        got = np.ones(max(n, 1 << 16), np.uint32)
        done = 1
        while done < len(got):
            step = min(done, len(got) - done)
            got[done : done + step] = got[:step].astype(np.uint64) * np.uint64(pow(base, done, int(_P))) % _P
            done += step
        if len(got) <= 1 << 21:
            _POWERS[name] = got
    return got[:n]


class Fields:
    """Hashes of ranges of one buffer that stand for their bytes."""

    def __init__(self, buf: np.ndarray):
        self.buf, self.held = buf, {}

    def _of(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        if k not in self.held:
            n, base = len(self.buf), _BASES[k]
            terms = self.buf.astype(np.uint64)
            terms += np.uint64(1)
            terms *= _field_powers(f"{k}", base, n + 1)[:n]
            if n > 1 << 23:  # sums of more would pass 64 bits
                terms = _folded(terms)
            sums = np.zeros(n + 1, np.uint64)
            np.cumsum(terms, out=sums[1:])
            self.held[k] = sums, _field_powers(f"-{k}", pow(base, -1, int(_P)), n + 1)
        return self.held[k]

    def _one(self, k: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        sums, down = self._of(k)
        x = _folded(_folded(sums[ends] - sums[starts]) * down[starts])
        x -= _P * (x >= _P)
        return x

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """62 bits of each range, and its length, mixed."""
        if not len(starts):
            return np.empty(0, np.uint64)
        return mix((self._one(0, starts, ends) << _31 | self._one(1, starts, ends)) + (ends - starts).astype(np.uint64) * _M2)

    def check(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """31 bits more."""
        if not len(starts):
            return np.empty(0, np.uint32)
        return self._one(2, starts, ends).astype(np.uint32)


def chain(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """An order-keeping hash of two hashes."""
    return mix(a * np.uint64(0xD6E8FEB86659FD93) + b)
