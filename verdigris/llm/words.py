"""Words of many texts at once, as hashes in numpy arrays."""

from __future__ import annotations

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _power(which: str, n: int) -> np.ndarray:
    """The first n powers of the base, or of its inverse modulo 2**64."""
    if len(_powers[which]) < n:
        size = 1 << max(12, (n - 1).bit_length())
        full = np.full(size, _BASE if which == "up" else _INVERSE, np.uint64)
        full[0] = 1
        _powers[which] = np.multiply.accumulate(full)
    return _powers[which][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def table_of(is_word, lower: bool = True) -> bytes:
    """A byte table for bytes.translate: word bytes stay (A-Z lower-cased), all others become a space."""
    return bytes((c + 32 if lower and 65 <= c <= 90 else c) if is_word(c) else 32 for c in range(256))


def spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes that aren't a space."""
    word = np.zeros(len(data) + 2, np.int8)
    word[1:-1] = data != 32
    edge = np.diff(word)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each data[start:end]; not 0."""
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power("up", len(data)), out=total[1:])
    h = (total[ends] - total[starts]) * _power("down", len(data) + 1)[starts]
    return np.maximum(mix(h + (ends - starts).astype(np.uint64)), np.uint64(1))


def grams(words: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n consecutive values; as many as there are whole runs."""
    count = max(0, len(words) - n + 1)
    h = np.zeros(count, np.uint64)
    for j in range(n):
        h = (h + words[j : j + count]) * _BASE
        h ^= h >> np.uint64(29)
    return mix(h)
