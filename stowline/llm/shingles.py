"""Word shingles of a text as 64-bit hashes, in numpy, for use inside tasks."""

from __future__ import annotations

import numpy as np
import xxhash

_MULT = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93,
                  0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], dtype=np.uint64)


class WordHashes(dict):
    """Hash of a word, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 400_000:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingle_set(text: str | None, size: int, words: WordHashes) -> np.ndarray:
    """Sorted distinct shingles of ``size`` words, A-Z lower-cased; fewer words are one shingle, none give none."""
    if not text:
        return np.empty(0, np.uint64)
    parts = text.encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(words.__getitem__, parts), np.uint64, len(parts))
    width = min(size, len(parts))
    n = len(parts) - width + 1
    total = np.full(n, width, np.uint64)
    for i in range(width):
        total += hashes[i:i + n] * _MULT[i % 8] * np.uint64(2 * (i // 8) + 1)
    return np.unique(mixed(total))
