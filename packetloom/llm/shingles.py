"""Words, word hashes and shingle hashes of whole texts, a block of texts at a time in NumPy.

A word is a run of bytes other than 0x20 and 0x09-0x0D, with A-Z lowered.  In UTF-8 these
bytes never occur inside another character, so this equals the same rule on characters.
"""

from __future__ import annotations

import numpy as np

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_VALUE = np.random.default_rng(20).integers(0, 1 << 64, 256, np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_STEP = np.uint64(0xD6E8FEB86659FD93)
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads 64-bit values over all bits."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _power(base: np.uint64, size: int) -> np.ndarray:
    held = _powers.get(str(base))
    if held is None or len(held) < size:
        steps = np.full(max(size, 1 << 20), base, np.uint64)
        steps[0] = 1
        held = np.multiply.accumulate(steps)
        if len(held) <= 1 << 22:
            _powers[str(base)] = held
    return held[:size]


def word_spans(data: np.ndarray, starts_of_texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every word in the joined bytes; no word crosses a text's start."""
    inside = ~_SPACE[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    cuts = starts_of_texts[(starts_of_texts > 0) & (starts_of_texts < len(data))]
    begins[cuts] = inside[cuts]
    ends[cuts - 1] = inside[cuts - 1]
    return np.flatnonzero(begins), np.flatnonzero(ends) + 1


def running_sums(data: np.ndarray) -> np.ndarray:
    """Running sums of weighted byte values, from which the hash of any span follows."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_VALUE[data] * _power(_BASE, len(data)), out=sums[1:])
    return sums


def hashes_from(sums: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return mix((sums[ends] - sums[begins]) * _power(_INVERSE, len(sums))[begins] + (ends - begins).astype(np.uint64))


def span_hashes(data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of the bytes of every span."""
    return hashes_from(running_sums(data), begins, ends)


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All bytes in one array, and where each text starts (and the last one ends)."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    return np.frombuffer(b"".join(texts), np.uint8), np.r_[0, np.cumsum(sizes)]


def hashed_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes of all texts in order, the first word of each text (one more at the end), and the word spans."""
    data, offsets = joined(texts)
    begins, ends = word_spans(data, offsets[:-1]) if len(data) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    return span_hashes(LOWER[data], begins, ends), np.searchsorted(begins, offsets), begins, ends


def windows(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` consecutive words; fewer words give none."""
    count = len(words) - size + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(count, np.uint64)
    for at in range(size):
        total = total * _STEP + words[at : at + count]
    return mix(total)


def shingle_set(words: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct shingle hashes of one text; with fewer words than ``size``, the whole sequence as one."""
    if 0 < len(words) < size:
        return windows(words, len(words)) ^ np.uint64(len(words))
    return np.unique(windows(words, size))


def shingle_sets(texts: list[bytes], size: int) -> list[np.ndarray]:
    words, firsts, _, _ = hashed_words(texts)
    return [shingle_set(words[firsts[i] : firsts[i + 1]], size) for i in range(len(texts))]
