"""Hashes of words and of word shingles, with numpy inside a task."""

from __future__ import annotations

import numpy as np

#: An odd factor, and its inverse modulo 2**64.
STEP = 0x9E3779B97F4A7C15
BACK = pow(STEP, -1, 1 << 64)
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """STEP**i and STEP**-i modulo 2**64, for i below n."""
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, base in enumerate((STEP, BACK)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0][:n], _powers[1][:n]


def word_hashes(text: str | None) -> np.ndarray:
    """A 64-bit hash of each word (a run of characters other than ASCII white space, lower-cased), in order."""
    raw = np.frombuffer((text or "").lower().encode("utf-8", "replace"), np.uint8)
    if not len(raw):
        return np.zeros(0, np.uint64)
    inside = ~SPACE[raw]
    edges = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).view(np.int8)))
    start, end = edges[::2], edges[1::2]
    up, down = powers(len(raw) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)])])
    return mix((sums[end] - sums[start]) * down[start])


def shingle_hashes(words: np.ndarray, size: int = 5) -> np.ndarray:
    """A hash of each run of ``size`` words; a shorter text that has words is one run."""
    size = min(size, len(words))
    if not size:
        return words
    n = len(words) - size + 1
    found = np.zeros(n, np.uint64)
    for j in range(size):
        found = (found + words[j : j + n]) * np.uint64(0xD6E8FEB86659FD93)
    return mix(found)


def run_means(values: np.ndarray, size: int = 5) -> np.ndarray:
    """The mean of each run that ``shingle_hashes`` hashes."""
    size = min(size, len(values))
    if not size:
        return values
    n = len(values) - size + 1
    return sum(values[j : j + n] for j in range(size)) / size
