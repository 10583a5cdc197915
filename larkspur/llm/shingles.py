"""Sets of hashed word 5-grams."""

from __future__ import annotations

import numpy as np
import xxhash

WORDS = 5
MEMORY = 300_000
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
_known: dict[bytes, int] = {}


def forget() -> None:
    _known.clear()


def hashed_words(text: str) -> np.ndarray:
    """64-bit hashes of the words between white space, A-Z lower-cased."""
    words = text.encode("utf-8", "replace").lower().split()
    fresh = set(words).difference(_known)
    if len(_known) + len(fresh) > MEMORY:
        _known.clear()
        fresh = set(words)
    _known.update(zip(fresh, map(xxhash.xxh3_64_intdigest, fresh)))
    return np.fromiter(map(_known.__getitem__, words), np.uint64, len(words))


def shingle_set(text: str, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's runs of so many words; a shorter text is one run; no word, none."""
    h = hashed_words(text)
    if not len(h):
        return h
    size = min(words, len(h))
    with np.errstate(over="ignore"):
        n = len(h) - size + 1
        out = np.full(n, size, np.uint64)
        for j in range(size):
            out += h[j : j + n] * _FACTORS[j % 5] ^ np.uint64(j * 0x1F)
        out ^= out >> np.uint64(32)
        out *= _FACTORS[1]
        out ^= out >> np.uint64(29)
    return np.unique(out)
