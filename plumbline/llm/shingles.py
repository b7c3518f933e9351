"""Word shingles as sorted 64-bit fingerprints.

Words are ``[^\\x20\\x09-\\x0D]+`` of the text after lower-casing A-Z only; a set holds the distinct shingles of five
consecutive words, or the whole sequence as one shingle when there are fewer words. No words: the empty set.
"""

from __future__ import annotations

import numpy as np
import xxhash

WORDS = 5
#: Words whose hash a worker keeps; at this many the memo starts anew, so memory stays bounded.
MEMO = 1_000_000
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5], dtype=np.uint64)


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO:
            self.clear()
        self[word] = out = xxhash.xxh64_intdigest(word)
        return out


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def split_words(text: str | None) -> list[bytes]:
    """bytes.lower() changes A-Z only and bytes.split() splits at exactly \\x20 and \\x09-\\x0D."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def windows(words: list[bytes], hashes: WordHashes, size: int = WORDS) -> np.ndarray:
    """Fingerprint of every window of `size` words in order; none if there are fewer words."""
    n = len(words)
    if n < size:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, n)
    out = np.full(n - size + 1, size * 0x2545F4914F6CDD1D & 0xFFFFFFFFFFFFFFFF, np.uint64)
    for j in range(size):
        # each place has its own odd factor and rotation, so the order of words counts
        w = h[j : n - size + 1 + j]
        out += ((w << np.uint64(j * 7 + 1)) | (w >> np.uint64(63 - j * 7))) * _ODD[j % 5]
    return mix(out)


def shingle_set(text: str | None, hashes: WordHashes, size: int = WORDS) -> np.ndarray:
    """Sorted distinct fingerprints of the set of a text."""
    words = split_words(text)
    if not words:
        return np.empty(0, np.uint64)
    return np.unique(windows(words, hashes, min(size, len(words))))


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted distinct arrays."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int(np.count_nonzero(b[at] == a))
