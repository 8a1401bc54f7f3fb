"""Words, lines and word windows of many texts at once, as 64-bit hashes in NumPy arrays.

Words are runs of bytes other than blank and \\x09-\\x0D, as in `[^\\x20\\x09-\\x0D]+`. Equal words
and windows have equal hashes; different ones are told apart but for a chance of 2**-64 a pair.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

from gridmark.llm import worker_memory

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_VALUES = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * 2 + 1
_BASE = np.uint64(0x9E3779B97F4A7C15)
_WEIGHTS = np.random.default_rng(7).integers(1, 2**63, 5, dtype=np.uint64) * 2 + 1


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values; one to one."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=2)
def _powers(size: int) -> np.ndarray:
    steps = np.full(size, _BASE, np.uint64)
    steps[:1] = 1
    return np.multiply.accumulate(steps)


worker_memory.forgets(_powers.cache_clear)


def powers(n: int) -> np.ndarray:
    return _powers(1 << max(10, int(n).bit_length()))


def run_hashes(raw: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Hashes of consecutive runs of bytes of these lengths (each at least 1) that fill `raw`."""
    if not len(lengths):
        return np.zeros(0, np.uint64)
    firsts = np.cumsum(lengths) - lengths
    within = np.arange(len(raw)) - np.repeat(firsts, lengths)
    parts = _VALUES[raw] * powers(int(lengths.max()))[within]
    return mix(np.add.reduceat(parts, firsts) + lengths.astype(np.uint64))


class TextWords:
    """The words of a batch of texts given as bytes and offsets."""

    def __init__(self, raw: np.ndarray, bounds: np.ndarray, lower: bool = False):
        self.raw, self.bounds, self.n_texts = LOWER[raw] if lower else raw, bounds, len(bounds) - 1
        self.inside = ~SPACE[raw]
        begins = self.inside.copy()
        begins[1:] &= ~self.inside[:-1]
        edges = bounds[:-1][bounds[:-1] < len(raw)]
        begins[edges] = self.inside[edges]
        starts = np.flatnonzero(begins)
        word_bytes = np.flatnonzero(self.inside)
        first = np.searchsorted(word_bytes, starts)
        self.lengths = np.diff(np.append(first, len(word_bytes)))
        self.first_word = np.searchsorted(starts, bounds)  # of each text, and the end
        self.counts = np.diff(self.first_word)
        self._word_bytes = word_bytes

    def hashes(self) -> np.ndarray:
        return run_hashes(self.raw[self._word_bytes], self.lengths)

    def windows(self, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the window that starts at each word, and which of them lie within one text."""
        words = self.hashes()
        n = max(0, len(words) - size + 1)
        total = np.zeros(n, np.uint64)
        for i in range(size):
            total += words[i : i + n] * _WEIGHTS[i]
        ends = np.repeat(self.first_word[1:], self.counts)[:n]
        return mix(total + np.uint64(size)), np.arange(n) + size <= ends

    def shingle_sets(self, size: int = 5) -> list[np.ndarray]:
        """Sorted distinct window hashes of each text; a text of fewer words has all its words as one."""
        words = self.hashes()
        hashes, _ = self.windows(size)
        sets = []
        for first, n in zip(self.first_word[:-1].tolist(), self.counts.tolist(), strict=True):
            if n >= size:
                sets.append(np.unique(hashes[first : first + n - size + 1]))
            elif n:
                total = (words[first : first + n] * _WEIGHTS[:n]).sum(dtype=np.uint64)
                sets.append(mix(np.array([total + np.uint64(n)], np.uint64)))
            else:
                sets.append(np.zeros(0, np.uint64))
        return sets

    def per_text(self, marks: np.ndarray) -> np.ndarray:
        """Number of marked bytes in each text."""
        sums = np.concatenate([[0], np.cumsum(marks, dtype=np.int64)])
        return sums[self.bounds[1:]] - sums[self.bounds[:-1]]

    def per_text_of_words(self, marks: np.ndarray) -> np.ndarray:
        """Number of marked words in each text."""
        sums = np.concatenate([[0], np.cumsum(marks, dtype=np.int64)])
        return sums[self.first_word[1:]] - sums[self.first_word[:-1]]


def repeated(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marks of keys that occur twice or more, and of those that are not the first of their kind."""
    twice, later = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    later[order[1:][same]] = True
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    return twice, later
