"""Hashed n-gram features of texts, in numpy."""

from __future__ import annotations

import numpy as np
import xxhash

U32 = np.uint32
#: Odd multipliers of the hashes of character n-grams, one row per length.
CHAR_MULTIPLIERS = np.array([[0x9E3779B1, 0, 0, 0], [0x85EBCA77, 0xC2B2AE3D, 0, 0], [0x27D4EB2F, 0x165667B1, 0x9E3779B9, 0], [0xD3A2646D, 0xFD7046C5, 0xB55A4F09, 0x8DA6B343]], U32)
_rng = np.random.Generator(np.random.PCG64(20240229))
BYTE_VALUES = _rng.integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
BASE = 0xD1342543DE82EF95
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Bytes that are hashed at once.
BLOCK = 1 << 19
_powers = np.ones(1, np.uint64)
_inverse = np.ones(1, np.uint64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE^i and BASE^-i modulo 2^64 for i < n."""
    global _powers, _inverse
    if len(_powers) < n:
        size = 1 << max(16, int(n).bit_length())
        inv = pow(BASE, -1, 1 << 64)
        a, b = np.full(size, BASE, np.uint64), np.full(size, inv, np.uint64)
        a[0] = b[0] = 1
        _powers, _inverse = np.multiply.accumulate(a), np.multiply.accumulate(b)
    return _powers[:n], _inverse[:n]


def word_bounds(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words ``[^\\x20\\x09-\\x0D]+`` in an array of bytes."""
    inside = np.empty(len(raw) + 2, np.int8)
    inside[0] = inside[-1] = 0
    np.logical_not(IS_SPACE[raw], out=inside[1:-1].view(bool))
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    return edge[::2], edge[1::2]


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every word, equal for equal bytes."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    if len(raw) > BLOCK:  # long texts in blocks of words, very long words on their own
        out, long = np.zeros(len(starts), np.uint64), ends - starts > BLOCK
        for i in np.flatnonzero(long):
            out[i] = xxhash.xxh64_intdigest(raw[starts[i] : ends[i]].tobytes(), 1)
        for k in np.unique(starts // BLOCK):
            at = np.flatnonzero((starts // BLOCK == k) & ~long)
            if len(at):
                x = starts[at[0]]
                out[at] = block_hashes(raw[x : ends[at[-1]]], starts[at] - x, ends[at] - x)
        return out
    return block_hashes(raw, starts, ends)


def block_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    up, down = powers(len(raw) + 1)
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(BYTE_VALUES[raw] * up[:-1], out=total[1:])
    h = (total[ends] - total[starts]) * down[starts]
    h ^= (ends - starts).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return h


def char_grams(text: str, sizes: tuple[int, ...], bits: int) -> np.ndarray:
    """Hashes of all character n-grams of the given sizes (1 to 4), below 2^bits, with repeats."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), U32)
    out = []
    for n in sizes:
        m = len(codes) - n + 1
        if m <= 0:
            continue
        h = codes[:m] * CHAR_MULTIPLIERS[n - 1][0]
        for j in range(1, n):
            h += codes[j : j + m] * CHAR_MULTIPLIERS[n - 1][j]
        h ^= h >> U32(15)
        h *= U32(0x2C1B3C6D)
        out.append(h >> U32(32 - bits))
    return np.concatenate(out) if out else np.zeros(0, U32)


def counted(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct features and their counts."""
    if len(hashes) * 16 < 1 << bits:
        return np.unique(hashes, return_counts=True)
    n = np.bincount(hashes, minlength=1 << bits)
    at = np.flatnonzero(n)
    return at, n[at]
