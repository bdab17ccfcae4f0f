"""Words, word hashes and word n-grams of text batches, vectorised with numpy.

Word hashes are 64-bit (xxhash64) and deterministic across workers. A word is the
longest run of letters and digits of the lower-cased text.
"""

from __future__ import annotations

import re

import numpy as np
import xxhash

WORD = re.compile(r"[^\W_]+")
_MULT = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))
_CACHE_LIMIT = 1_000_000


class WordHashes(dict):
    """word -> 64-bit hash; emptied when full so that a worker's memory stays bounded."""

    def __missing__(self, word: str) -> int:
        if len(self) >= _CACHE_LIMIT:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


HASHES = WordHashes()


def words(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def word_hashes(text: str | None) -> np.ndarray:
    found = words(text)
    return np.fromiter(map(HASHES.__getitem__, found), dtype=np.uint64, count=len(found))


def mix(values: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that every bit of a combined hash depends on all its parts."""
    values = (values ^ (values >> np.uint64(31))) * _MULT[1]
    return values ^ (values >> np.uint64(29))


def ngrams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of n successive words, in text order."""
    size = len(hashes) - n + 1
    if size <= 0:
        return np.empty(0, dtype=np.uint64)
    out = np.zeros(size, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            out = (out ^ hashes[k : k + size]) * _MULT[0] + _MULT[2]
        return mix(out)


def ngram_set(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct n-grams of a text."""
    return np.unique(ngrams(word_hashes(text), n))


def hash_words(found: list) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of many word lists in one array, and the offsets of each list in it."""
    ends = np.cumsum(np.fromiter(map(len, found), dtype=np.int64, count=len(found)))
    flat = np.fromiter(
        (HASHES[w] for ws in found for w in ws), dtype=np.uint64, count=int(ends[-1]) if len(ends) else 0
    )
    return flat, np.concatenate(([0], ends))


def batch_ngram_sets(texts: list[str | None], n: int) -> list[np.ndarray]:
    """Sorted distinct n-grams of each text; the hashing runs once over the whole batch."""
    return ngram_sets([WORD.findall(t.lower()) if t else () for t in texts], n)


def ngram_sets(found: list, n: int) -> list[np.ndarray]:
    """Sorted distinct n-grams of each list of words."""
    flat, offsets = hash_words(found)
    grams = ngrams(flat, n)  # those that reach over the end of a text are never sliced below
    out = []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        part = np.sort(grams[a : b - n + 1]) if b - a >= n else grams[:0]
        if len(part) > 1:
            part = part[np.concatenate(([True], part[1:] != part[:-1]))]
        out.append(part)
    return out
