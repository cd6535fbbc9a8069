"""Words ``[^\\x20\\x09-\\x0D]+`` of UTF-8 texts as 64-bit numbers, in NumPy arrays."""

from __future__ import annotations

import numpy as np
import xxhash

#: Entries after which a worker's table of word numbers starts again, so that its memory stays bounded.
WORDS_HELD = 400_000


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        number = self[word] = xxhash.xxh3_64_intdigest(word)
        return number


_numbers = _Numbers()


def word_numbers(words: list[bytes]) -> np.ndarray:
    """The 64-bit hash of each word. ``bytes.split()`` cuts at exactly the six ASCII white-space bytes."""
    if len(_numbers) > WORDS_HELD:
        _numbers.clear()
    return np.fromiter(map(_numbers.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """One number for each ordered pair."""
    return mix(left * np.uint64(0xD6E8FEB86659FD93) + mix(right + np.uint64(0x2545F4914F6CDD1D)))
