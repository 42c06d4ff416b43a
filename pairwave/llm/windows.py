"""Windows of words for decontamination: shingle hashes, SimHash and similarity of multisets, as both of its forms use them."""

from __future__ import annotations

import math
import re
from itertools import combinations

import numpy as np

WIDTH, RADIUS = 5, 15
BLOCKS = 4
WORDS = re.compile(r"[^\W_]+")
MIX = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit mix of whole numbers: the finishing step of SplitMix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(ids: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the runs of k word numbers."""
    n = len(ids) - k + 1
    h = np.zeros(max(n, 0), np.uint64)
    for i in range(k):
        h = h * MIX + ids[i : i + n] if n > 0 else h
    return mixed(h)


def bits(h: np.ndarray) -> np.ndarray:
    """(n, 64) of -1 and 1."""
    return np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.int32) * 2 - 1


def packed(signs: np.ndarray) -> np.ndarray:
    return np.packbits(signs > 0, axis=1, bitorder="little").view(np.uint64).ravel()


def flips(most: int) -> np.ndarray:
    """All patterns of 16 bits with at most so many set."""
    return np.array([sum(1 << b for b in some) for n in range(most + 1) for some in combinations(range(16), n)], np.uint16)


def similarity(a: tuple[np.ndarray, np.ndarray], window: np.ndarray) -> float:
    """Weighted Jaccard similarity of a multiset of shingles, as values and how often each is there, and those of a window."""
    values, n = np.unique(window, return_counts=True)
    at = np.minimum(np.searchsorted(a[0], values), len(a[0]) - 1)
    shared = int(np.minimum(a[1][at], n)[a[0][at] == values].sum())
    return shared / (int(a[1].sum()) + len(window) - shared)


def needed(a: int, b: int, least: float) -> int:
    """Shared shingles without which sets of a and b shingles can't be that similar."""
    return math.ceil((a + b) * least / (1 + least) - 1e-9)
