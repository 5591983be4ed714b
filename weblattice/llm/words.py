"""Hashes of words and of runs of words, shared by the operators on word sequences."""

from __future__ import annotations

from hashlib import blake2b

import numpy as np

from weblattice.functions.words import WORD, plain, words

__all__ = ["WORD", "WordHashes", "plain", "shingle_hashes", "words"]


class WordHashes(dict):
    """Word to 64-bit hash; emptied when it has limit words, so that its memory is bounded."""

    def __init__(self, limit: int = 400_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, w: str) -> int:
        if len(self) >= self.limit:
            self.clear()
        h = self[w] = int.from_bytes(blake2b(w.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
        return h


def shingle_hashes(h: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of size words, given the words' hashes (uint64, in order)."""
    n = len(h) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(size):
        out = (out ^ h[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out
