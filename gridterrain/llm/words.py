"""Words, windows of words and their 64-bit hashes, a whole Arrow column at a time.

A word is a maximal run of bytes other than blank and 0x09 to 0x0D, in UTF-8 and unchanged. A word's
hash takes in eight bytes after the other and a window's the hashes of its halves, each time through a
function that spreads every bit over all others, so repetitive texts collide no more than random ones.
Different words share a hash with a chance of 2^-64 a pair.
"""

from __future__ import annotations

import numpy as np

_GAPS = np.zeros(256, bool)
_GAPS[[9, 10, 11, 12, 13, 32]] = True
_WORD_STEP, _FIRST_STEP, _LAST_STEP, _OTHER_STEP = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93))


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit values over all bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _hashed(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each run of bytes, eight bytes of all runs that are long enough at a time."""
    length = (ends - starts).astype(np.int64)
    out = mix(length.astype(np.uint64) * _WORD_STEP)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(data) + 1, "<u8", padded.data, strides=(1,))
    rows, done = np.arange(len(starts)), 0
    while len(rows):
        left = length[rows] - done
        # Bytes behind the run's end are shifted out.
        value = eight[starts[rows] + done] << (8 * (8 - np.minimum(left, 8))).astype(np.uint64)
        out[rows] = mix((out[rows] ^ value) * _FIRST_STEP)
        done += 8
        rows = rows[left > 8]
    return out


def word_bounds(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of texts that lie end to end in ``data``; no word crosses a text's bound."""
    gap = _GAPS[data]
    first = ~gap
    first[1:] &= gap[:-1]
    last = ~gap
    last[:-1] &= gap[1:]
    inner = bounds[(bounds > 0) & (bounds < len(data))]
    first[inner] |= ~gap[inner]
    last[inner - 1] |= ~gap[inner - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def hashed_words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, starts and ends of all words, and the index of each text's first word (one more at the end)."""
    starts, ends = word_bounds(data, bounds)
    return _hashed(data, starts, ends), starts, ends, np.searchsorted(starts, bounds)


def windows(words: np.ndarray, size: int, other: bool = False) -> np.ndarray:
    """Hash of the ``size`` words from each word on; ``other`` gives an independent second hash.

    The last ``size - 1`` windows would run over the end and are left out.
    """
    return _windows(mix(words ^ _OTHER_STEP) if other else words, size, _OTHER_STEP if other else _WORD_STEP)


def _windows(words: np.ndarray, size: int, step: np.uint64) -> np.ndarray:
    if size == 1:
        return words
    half = size // 2
    halves = _windows(words, half, step)
    n = max(0, len(words) - size + 1)
    both = mix(halves[:n] * _FIRST_STEP + mix(halves[half : half + n] ^ step))
    return mix(both * _FIRST_STEP + mix(words[size - 1 :] ^ _LAST_STEP)) if size % 2 else both


def inside(first_words: np.ndarray, n_windows: int, size: int) -> np.ndarray:
    """Which windows lie within one text."""
    text = np.repeat(np.arange(len(first_words) - 1), np.diff(first_words))[:n_windows]
    return np.arange(n_windows) + size <= first_words[1:][text]


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """Distinct hashes of a text's windows of ``size`` words; a shorter text is one window, an empty one none."""
    return np.unique(windows(words, min(size, len(words)))) if len(words) else np.zeros(0, np.uint64)
