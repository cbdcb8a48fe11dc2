"""Words, shingles and their hashes, as the text operators of this package count them.

A word is a run of bytes other than space and the controls tab to carriage return, with ASCII capitals
made small; ``bytes.lower().split()`` is exactly that rule. Hashes are 64 bits of xxh3 and do not depend
on the process.
"""

from __future__ import annotations

import numpy as np
import xxhash

#: Words whose hash a Python worker remembers; the memory is emptied beyond it, results do not change.
REMEMBERED = 300_000

_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


class WordHashes(dict):
    """Word -> 64-bit hash, remembered."""

    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > REMEMBERED:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def words(text: bytes | None) -> list[bytes]:
    return text.lower().split() if text else []


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    h = (h ^ (h >> np.uint64(30))) * _MIX1
    h = (h ^ (h >> np.uint64(27))) * _MIX2
    return h ^ (h >> np.uint64(31))


def shingles(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of ``width`` words; a shorter text is one run, no words give none."""
    n = len(hashes)
    if n == 0:
        return np.empty(0, np.uint64)
    width = min(width, n)
    m = n - width + 1
    out = np.full(m, width, np.uint64)
    for j in range(width):
        out = mixed(out * _ODD + hashes[j : j + m])
    return out
