"""Word shingles of whole texts as sorted sets of 64-bit hashes, by array work on the bytes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from albumforge.llm.encode import raw

_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: An odd base has an inverse modulo 2^64, so a word's hash is a difference of running sums, shifted back to the word's start.
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BACK = np.uint64(pow(int(_BASE), -1, 1 << 64))
_SHIFTS: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_SHIFTS["up"]) < n:
        for name, base in (("up", _BASE), ("down", _BACK)):
            steps = np.full(max(n, 1 << 16), base, np.uint64)
            steps[0] = 1
            _SHIFTS[name] = np.cumprod(steps)
    return _SHIFTS["up"][:n], _SHIFTS["down"][:n]


def mixed(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads them; another one for each salt."""
    x = x ^ np.uint64(salt * 0xD6E8FEB86659FD93 & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (lower-cased A to Z, parted by the six white-space bytes), and where each text's words start."""
    data, starts = raw(texts)
    if not len(data):
        return np.empty(0, np.uint64), np.zeros(len(starts), np.int64)
    space = _SPACE[data]
    head = np.zeros(len(data) + 1, bool)
    head[starts] = True
    begin = ~space
    begin[1:] &= space[:-1] | head[1:-1]
    end = ~space
    end[:-1] &= space[1:] | head[1:-1]
    begins, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    up, down = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((_LOWER[data].astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
    words = (sums[ends] - sums[begins]) * down[begins] + (ends - begins).astype(np.uint64) * np.uint64(0xA0761D6478BD642F)
    return mixed(words), np.searchsorted(begins, starts, "left")


def shingle_sets(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """All texts' distinct shingles, each text's ascending, and how many each has.

    With fewer words than ``size`` the whole sequence is one shingle; without words there is none.
    """
    words, first = word_hashes(texts)
    weights = mixed(np.arange(1, size + 1, dtype=np.uint64)) | np.uint64(1)
    n = max(0, len(words) - size + 1)
    sums = np.zeros(n, np.uint64)
    for k in range(size):
        sums += words[k:k + n] * weights[k]
    windows, sets = mixed(sums), []
    for lo, hi in zip(first[:-1], first[1:], strict=True):
        if hi - lo >= size:
            own = np.sort(windows[lo:hi - size + 1])
            sets.append(own[np.append(True, own[1:] != own[:-1])])
        elif hi > lo:
            short = (words[lo:hi] * weights[:hi - lo]).sum(dtype=np.uint64)
            sets.append(mixed(np.array([short + np.uint64(hi - lo)]), 5))
        else:
            sets.append(words[:0])
    return (np.concatenate(sets) if sets else words[:0]), np.array([len(x) for x in sets], np.int64)


def digests(shingles: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """One signed 64-bit number for each set."""
    sums = np.concatenate([[np.uint64(0)], np.cumsum(mixed(shingles, 9))])
    ends = np.cumsum(counts)
    return mixed(sums[ends] - sums[ends - counts] + counts.astype(np.uint64), 11).view(np.int64)
