"""Vectorised 64-bit hashing of byte ranges, words and shingles over a chunk of texts."""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15
_STATE: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply), a bijection."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def byte_values() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))


def powers(n: int, state: dict) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, kept in ``state`` and grown."""
    if "power" not in state or len(state["power"]) < n:
        size = max(n, 1 << 21)
        for name, base in (("power", _BASE), ("inverse", pow(_BASE, -1, 1 << 64))):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            state[name] = np.cumprod(table, dtype=np.uint64)
    return state["power"], state["inverse"]


class Ranges:
    """Hashes of any byte ranges of one buffer in constant time each (prefix sums)."""

    def __init__(self, data: np.ndarray, state: dict):
        power, self.inverse = powers(len(data) + 1, state)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(byte_values()[data] * power[: len(data)], out=self.sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        raw = (self.sums[end] - self.sums[start]) * self.inverse[start]
        return mix(raw + mix((end - start).astype(np.uint64)))


def word_hashes(texts: list[bytes], state: dict) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words ``[^\\x20\\x09-\\x0D]+`` of all texts, and where each text's begin.

    The second array has one more entry than there are texts.
    """
    data = np.frombuffer(b"".join(x for t in texts for x in (t, b" ")), np.uint8)
    space = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.diff(space.view(np.int8), prepend=np.int8(1))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    begin = np.cumsum([0, *(len(t) + 1 for t in texts)])
    return Ranges(data, state)(starts, ends), np.searchsorted(starts, begin)


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` words; of fewer words, the whole run as one."""
    if len(words) == 0:
        return words
    size = min(size, len(words))
    out = words[: len(words) - size + 1].copy()
    for i in range(1, size):
        out = mix(out * np.uint64(_BASE)) + words[i : len(words) - size + 1 + i]
    return mix(out + np.uint64(size))
