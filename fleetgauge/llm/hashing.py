"""Vectorised 64-bit hashing of runs of units (bytes, or the words of a text), for use inside tasks.

A run's hash is a polynomial over its units modulo 2**64 with an odd base, finished by a mixer. Prefix sums make the hash of any
run two look-ups, so all windows of a text cost the same whatever their length.
"""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15
_powers = np.ones(1, np.uint64)
_inverses = np.ones(1, np.uint64)

#: Byte values that end a word: space and the controls tab to carriage return.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the entropy of 64-bit values over all their bits (a bijection)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


#: One random-looking value per byte.
BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, at least ``n`` of each; kept between calls."""
    global _powers, _inverses
    if len(_powers) < n:
        size = 1 << (n - 1).bit_length()
        for name, base in (("_powers", _BASE), ("_inverses", pow(_BASE, -1, 1 << 64))):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            globals()[name] = np.cumprod(table)
    return _powers, _inverses


def prefix(values: np.ndarray) -> np.ndarray:
    """Prefix sums of a sequence of 64-bit units, from which :func:`runs` reads hashes."""
    powers, _ = _tables(len(values) + 1)
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers[: len(values)], out=out[1:])
    return out


def runs(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the runs ``[start, end)``."""
    _, inverses = _tables(len(sums))
    return mix((sums[ends] - sums[starts]) * inverses[starts])


#: Sums modulo a power of two cancel in regular texts (Thue-Morse patterns of any two letters), sums modulo a prime do not.
_PRIME = np.uint64((1 << 61) - 1)
_PRIME_BASE = 0x1B8735939E3779B9
_STEP = 1 << 16
_prime_powers = np.ones(1, np.uint64)
_prime_inverses = np.ones(1, np.uint64)


def _reduced(x: np.ndarray) -> np.ndarray:
    x = (x & _PRIME) + (x >> np.uint64(61))
    return np.where(x >= _PRIME, x - _PRIME, x)


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products modulo the prime, of numbers below it."""
    half, low = np.uint64(31), np.uint64((1 << 31) - 1)
    a_high, a_low, b_high, b_low = a >> half, a & low, b >> half, b & low
    middle = a_high * b_low + a_low * b_high
    carried = (middle >> np.uint64(30)) + ((middle & np.uint64((1 << 30) - 1)) << half)
    return _reduced((a_high * b_high << np.uint64(1)) + carried + a_low * b_low)


def _prime_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """As :func:`_tables`, modulo the prime; grown in short steps, which keeps what a task holds meanwhile small."""
    global _prime_powers, _prime_inverses
    if len(_prime_powers) < n:
        for name, base in (("_prime_powers", _PRIME_BASE), ("_prime_inverses", pow(_PRIME_BASE, -1, int(_PRIME)))):
            known = globals()[name]
            done, table = len(known), np.empty(-(-n // _STEP) * _STEP, np.uint64)
            table[:done] = known
            while done < len(table):
                step = min(done, len(table) - done, _STEP)
                table[done : done + step] = _times(table[:step], np.uint64(pow(base, done, int(_PRIME))))
                done += step
            globals()[name] = table
    return _prime_powers, _prime_inverses


class ByteRuns:
    """Hashes of the runs ``[start, end)`` of a byte sequence, none empty: sums modulo a prime, spread to 64 bits by a run's first eight bytes."""

    def __init__(self, buffer: np.ndarray):
        n, shift = len(buffer), np.uint64(32)
        powers, self.inverses = _prime_tables(n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        self.padded = np.concatenate([buffer, np.zeros(8, np.uint8)])
        for a in range(0, n, _STEP):
            values, weights = buffer[a : a + _STEP].astype(np.uint64), powers[a : min(a + _STEP, n)]
            low = np.cumsum(values * (weights & np.uint64((1 << 32) - 1)))
            high = np.cumsum(values * (weights >> shift))
            self.sums[a + 1 : a + 1 + len(values)] = _reduced(((high << shift) & _PRIME) + (high >> np.uint64(29)) + low + self.sums[a])

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        out = np.empty(len(starts), np.uint64)
        leading = np.ndarray(len(self.sums), "<u8", self.padded, strides=(1,))
        for a in range(0, len(starts), _STEP):
            at, end = starts[a : a + _STEP], ends[a : a + _STEP]
            sums = _reduced(self.sums[end] + (_PRIME - self.sums[at]))
            beyond = (64 - 8 * np.minimum(end - at, 8)).astype(np.uint64)
            out[a : a + _STEP] = mix(_times(sums, self.inverses[at]) + mix(leading[at] << beyond))
        return out


def word_bounds(buffer: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of concatenated texts; ``ends`` closes each text."""
    if not len(buffer):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    space = IS_SPACE[buffer]
    first = np.concatenate([[True], space[:-1]])
    first[ends[ends < len(buffer)]] = True
    last = np.concatenate([space[1:], [True]])
    last[ends[ends > 0] - 1] = True
    return np.flatnonzero(first & ~space), np.flatnonzero(last & ~space) + 1


def words(buffer: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of all words; the length is part of a word's hash."""
    starts, stops = word_bounds(buffer, ends)
    hashes = ByteRuns(buffer).hashes(starts, stops)
    return starts, stops, mix(hashes + (stops - starts).astype(np.uint64))
