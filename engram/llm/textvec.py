"""Word and n-gram hashes of many texts at once, in numpy, over UTF-8 bytes."""

from __future__ import annotations

import numpy as np

_SEED = 20240611
_RNG = np.random.default_rng(_SEED)
BYTE_VALUE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_MULT = np.uint64(0x9E3779B97F4A7C15)
_MULT_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Byte classes: 0 parts words. By space alone, or by space with letters, digits and marks apart.
SPACED = np.ones(256, np.uint8)
SPACED[[0x20, *range(0x09, 0x0E)]] = 0
KINDS = np.full(256, 3, np.uint8)
KINDS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
KINDS[48:58] = 2
KINDS[[0x20, *range(0x09, 0x0E)]] = 0

_powers: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The multiplier's powers up to n, and its inverse's, modulo 2^64."""
    if len(_powers["up"]) < n:
        size = 1 << int(n - 1).bit_length()
        with np.errstate(over="ignore"):
            for name, m in (("up", _MULT), ("down", _MULT_INV)):
                p = np.full(size, m, np.uint64)
                p[0] = 1
                _powers[name] = np.multiply.accumulate(p)
    return _powers["up"][:n], _powers["down"][:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """A finaliser whose every output bit hangs on every input bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def word_hashes(data: np.ndarray, offsets: np.ndarray, classes: np.ndarray = SPACED, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words in order, and each text's offsets among them. Words never cross texts."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    kind = classes[data]
    start, end = kind != 0, kind != 0
    turn = kind[1:] != kind[:-1]
    edge = np.unique(offsets[(offsets > 0) & (offsets < n)])
    turn[edge - 1] = True
    start[1:] &= turn
    end[:-1] &= turn
    first, last = np.flatnonzero(start), np.flatnonzero(end)
    up, down = powers(n + 1)
    values = BYTE_VALUE[LOWER[data]] if lower else BYTE_VALUE[data]
    with np.errstate(over="ignore"):
        values *= up[:n]
        np.cumsum(values, out=values)
        total = values[last].copy()
        inner = first > 0
        total[inner] -= values[first[inner] - 1]
        total *= down[first]
        total += (last - first).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    return mixed(total), np.searchsorted(first, offsets)


def shingles(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n words; of the whole sequence if there are fewer; none of nothing."""
    k = min(n, len(words))
    if k == 0:
        return words[:0]
    count = len(words) - k + 1
    with np.errstate(over="ignore"):
        out = np.full(count, k, np.uint64)
        for i in range(k):
            out = out * np.uint64(0xFF51AFD7ED558CCD) + words[i : i + count]
    return mixed(out)
