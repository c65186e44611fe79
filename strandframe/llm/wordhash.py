"""Hashes of all words of many texts at once, over one byte buffer."""

from __future__ import annotations

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))
_VALUES = np.random.default_rng(20).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_FOLD = np.arange(256)
_FOLD[65:91] += 32
_VALUES = _VALUES[_FOLD]  # A-Z count as a-z


def mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class Powers:
    """Powers of the base and its inverse, grown as longer buffers come."""

    up = np.ones(1, np.uint64)
    down = np.ones(1, np.uint64)

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = max(n, 1 << 20)
            with np.errstate(over="ignore"):
                for name, base in (("up", _BASE), ("down", _INVERSE)):
                    x = np.full(size, base, np.uint64)
                    x[0] = 1
                    setattr(cls, name, np.multiply.accumulate(x))
        return cls.up[:n], cls.down[:n]


def words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, hashes) of the words of a byte buffer: runs without ASCII white space, A-Z folded.

    A word's hash is its polynomial over a table of random byte values, from differences of one prefix
    sum, then mixed; it doesn't depend on where the word stands.
    """
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(0, np.uint64)
    solid = np.zeros(n + 2, bool)
    np.logical_not(_SPACE[data], out=solid[1:-1])
    edge = np.flatnonzero(solid[1:] != solid[:-1])
    starts, ends = edge[::2], edge[1::2]
    up, down = Powers.of(n)
    with np.errstate(over="ignore"):
        prefix = np.zeros(n + 1, np.uint64)
        np.cumsum(_VALUES[data] * up, out=prefix[1:])
        h = (prefix[ends] - prefix[starts]) * down[starts]
    return starts, ends, mix(h + (ends - starts).astype(np.uint64))


def xxhash_long(x: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of 8-byte integers, as Spark's xxhash64() of a long column has it."""
    p1, p2, p3, p4, p5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    turn = lambda v, r: (v << np.uint64(r)) | (v >> np.uint64(64 - r))
    with np.errstate(over="ignore"):
        h = np.uint64(seed) + p5 + np.uint64(8)
        h = h ^ (turn(x.view(np.uint64) * p2, 31) * p1)
        h = turn(h, 27) * p1 + p4
        h = (h ^ (h >> np.uint64(33))) * p2
        h = (h ^ (h >> np.uint64(29))) * p3
        return (h ^ (h >> np.uint64(32))).view(np.int64)
