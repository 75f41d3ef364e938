"""Polynomial prefix hashes of byte strings modulo 2**64, in NumPy.

H(i, n) = sum of c[i + t] * B**t for t < n, from two lookups in a table of prefix sums. Equal
strings have equal hashes; the reverse is checked on the bytes where it matters.
"""

from __future__ import annotations

import numpy as np

BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(BASE, -1, 1 << 64)
_power = np.ones(1, dtype=np.uint64)
_unpower = np.ones(1, dtype=np.uint64)
# A value per byte, from a fixed rule.
VALUE = np.random.Generator(np.random.PCG64(2024)).integers(1, 1 << 63, 256, dtype=np.uint64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """B**0 .. B**(n-1) and their inverses; grown as needed, at most to the longest text."""
    global _power, _unpower
    if len(_power) < n:
        size = max(n, 2 * len(_power), 4096)
        steps = np.full(size, BASE, dtype=np.uint64)
        steps[0] = 1
        _power = np.cumprod(steps)
        steps[1:] = _INVERSE
        _unpower = np.cumprod(steps)
    return _power[:n], _unpower[:n]


def prefixes(values: np.ndarray) -> np.ndarray:
    """Prefix sums along the last axis, one longer than ``values`` (uint64)."""
    p, _ = powers(values.shape[-1])
    out = np.zeros((*values.shape[:-1], values.shape[-1] + 1), dtype=np.uint64)
    np.cumsum(values * p, axis=-1, out=out[..., 1:])
    return out


def spans(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of [start, end) for each pair."""
    _, u = powers(len(prefix))
    return (prefix[end] - prefix[start]) * u[start]


def windows(prefix: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all spans of length ``n``."""
    _, u = powers(len(prefix))
    return (prefix[n:] - prefix[:-n]) * u[: len(prefix) - n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of hashes, so that their order tells nothing about the strings."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def window_minima(hashes: np.ndarray, width: int, bits: int = 28) -> np.ndarray:
    """For each run of ``width`` neighbours the index of the smallest hash, the leftmost of equals.

    The low ``bits`` give way to the index, so equal runs choose alike wherever they stand; more
    hashes than that are taken in stretches that overlap by a run.
    """
    n, most = len(hashes), max(1 << bits, 2 * width)
    if n <= most:
        return _minima(hashes, width, max(bits, most.bit_length() - 1))
    step = most - width + 1
    return np.concatenate([_minima(hashes[k : k + most], width, max(bits, most.bit_length() - 1)) + k for k in range(0, n - width + 1, step)])


def _minima(hashes: np.ndarray, width: int, bits: int) -> np.ndarray:
    n = len(hashes)
    if n < width:
        return np.zeros(0, dtype=np.int64)
    mask = np.uint64((1 << bits) - 1)
    key = (hashes & ~mask) | np.arange(n, dtype=np.uint64)
    fill = -n % width
    blocks = np.concatenate([key, np.full(fill, 0xFFFFFFFFFFFFFFFF, dtype=np.uint64)]).reshape(-1, width)
    down = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    up = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    best = np.minimum(up[: n - width + 1], down[width - 1 : n])
    return (best & mask).astype(np.int64)
