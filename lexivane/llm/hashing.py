"""64-bit mixing on numpy arrays."""

from __future__ import annotations

import numpy as np


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64: a bijection of 64-bit numbers whose output bits depend on all input bits."""
    x = x.astype(np.uint64, copy=True)
    x += np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def family(n: int, seed: int) -> np.ndarray:
    """n odd multipliers."""
    return mix(np.arange(n, dtype=np.uint64) + np.uint64(seed * 1_000_003)) | np.uint64(1)
