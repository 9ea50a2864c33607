"""Hashed word shingles of texts, with numpy."""

from __future__ import annotations

import numpy as np
import xxhash

from foldstone.llm.common import mixed64

WIDTH = 5
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def word_hashes(words: list[str]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def shingles(words: list[str]) -> np.ndarray:
    """Hash of the WIDTH words from each position on; a shorter text is one shingle, a text without words none."""
    h = word_hashes(words)
    n = len(h) - WIDTH + 1
    if n < 1:
        return mixed64((h * _ODD[: len(h)]).sum(keepdims=True, dtype=np.uint64) + np.uint64(len(h))) if len(h) else h
    out = h[:n] * _ODD[0]
    for j in range(1, WIDTH):
        out += h[j : j + n] * _ODD[j]
    return mixed64(out + np.uint64(WIDTH))
