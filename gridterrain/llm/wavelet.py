"""A wavelet matrix over integers: one bit-plane per bit, each with counts, in one file.

Level 0 holds the highest bit of every value in order; each level moves the values with bit 0, in order, before
those with bit 1. A plane is packed bits plus the number of ones before every block of 512 bits, which
answers rank; select is a search over these counts. Values are numbered by rank among the distinct ones,
so there are as many planes as the number of distinct values needs.
"""

from __future__ import annotations

import json
import struct

import numpy as np

_BLOCK = 512
_MARK = b"WVMX1\n"


def _pack(bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    packed = np.packbits(bits)
    padded = np.zeros(-(-max(1, len(packed)) // (_BLOCK // 8)) * (_BLOCK // 8), np.uint8)
    padded[: len(packed)] = packed
    ones = np.bitwise_count(padded).reshape(-1, _BLOCK // 8).sum(axis=1, dtype=np.int64)
    return padded, np.concatenate([[0], np.cumsum(ones)]).astype("<u8")


def _ranked(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values and each value's rank among them; by a table where that is no larger than the values allow."""
    if not len(values):
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    top = int(values.max())
    if top > 16 * len(values) + (1 << 16):
        return np.unique(values, return_inverse=True)
    seen = np.zeros(top + 1, bool)
    seen[values] = True
    return np.flatnonzero(seen), (np.cumsum(seen) - 1).astype(np.uint16 if seen.sum() <= 1 << 16 else np.uint32)[values]


def build(values: np.ndarray, tables: dict[str, np.ndarray]) -> bytes:
    """The file: a JSON header with the place of each part, the distinct values, ``tables`` and the planes."""
    symbols, codes = _ranked(values)
    levels = max(1, int(len(symbols) - 1).bit_length()) if len(symbols) else 0
    codes = codes.astype(np.uint16 if levels <= 16 else np.uint32, copy=False)
    parts = {"symbols": symbols.astype("<u4")} | tables
    zeros = []
    for level in range(levels):
        ones = (codes & codes.dtype.type(1 << (levels - 1 - level))) != 0
        parts[f"bits{level}"], parts[f"ones{level}"] = _pack(ones)
        # Positions instead of masks: three times as fast on mixed bits.
        low, high = codes[np.flatnonzero(~ones)], codes[np.flatnonzero(ones)]
        zeros.append(len(low))
        codes = np.concatenate([low, high])
    places, at = {}, 0
    for name, part in parts.items():
        places[name] = [at, part.nbytes, part.dtype.str]
        at += part.nbytes
    head = json.dumps({"n": len(values), "levels": levels, "zeros": zeros, "parts": places}).encode()
    return b"".join([_MARK, struct.pack("<Q", len(head)), head, *[np.ascontiguousarray(p).tobytes() for p in parts.values()]])


class Wavelet:
    """A file opened through ``read(at, n)``; single answers read a few blocks of each plane only."""

    def __init__(self, read):
        self._read = read
        mark = read(0, len(_MARK) + 8)
        if mark[: len(_MARK)] != _MARK:
            raise ValueError("no wavelet matrix")
        (size,) = struct.unpack("<Q", mark[len(_MARK) :])
        head = json.loads(read(len(mark), size))
        self.n, self.levels, self.zeros, self._parts = head["n"], head["levels"], head["zeros"], head["parts"]
        self._base = len(mark) + size
        self.symbols = self.table("symbols")

    def table(self, name: str, start: int = 0, stop: int | None = None) -> np.ndarray:
        at, size, kind = self._parts[name]
        width = np.dtype(kind).itemsize
        stop = size // width if stop is None else stop
        return np.frombuffer(self._read(self._base + at + start * width, (stop - start) * width), kind)

    def values(self) -> np.ndarray:
        """All values in order, from the last plane up."""
        kind = np.uint16 if self.levels <= 16 else np.uint32
        codes = np.zeros(self.n, kind)
        for level in reversed(range(self.levels)):
            ones = np.unpackbits(self.table(f"bits{level}"), count=self.n).view(bool)
            above = np.empty(self.n, kind)
            above[np.flatnonzero(~ones)] = codes[: self.zeros[level]]
            above[np.flatnonzero(ones)] = codes[self.zeros[level] :] | kind(1 << (self.levels - 1 - level))
            codes = above
        return self.symbols[codes] if self.n else np.zeros(0, "<u4")

    def _ones_before(self, level: int, at: int) -> int:
        block, rest = divmod(at, _BLOCK)
        ones = int(self.table(f"ones{level}", block, block + 1)[0])
        if rest:
            held = self.table(f"bits{level}", block * _BLOCK // 8, block * _BLOCK // 8 + -(-rest // 8))
            ones += int(np.unpackbits(held, count=rest).sum())
        return ones

    def access(self, at: int) -> int:
        """The value at a position."""
        if not 0 <= at < self.n:
            raise IndexError(at)
        code = 0
        for level in range(self.levels):
            before, upto = self._ones_before(level, at), self._ones_before(level, at + 1)
            bit = upto - before
            code = code << 1 | bit
            at = self.zeros[level] + before if bit else at - before
        return int(self.symbols[code])

    def _code(self, value: int) -> int | None:
        at = int(np.searchsorted(self.symbols, value))
        return at if at < len(self.symbols) and self.symbols[at] == value else None

    def _range(self, code: int, stop: int) -> tuple[int, int]:
        """Where the occurrences of a code before ``stop`` lie below the last plane."""
        first, last = 0, stop
        for level in range(self.levels):
            a, b = self._ones_before(level, first), self._ones_before(level, last)
            one = code >> (self.levels - 1 - level) & 1
            first, last = (self.zeros[level] + a, self.zeros[level] + b) if one else (first - a, last - b)
        return first, last

    def count(self, value: int, stop: int | None = None) -> int:
        """How often a value occurs before ``stop`` (default: in all)."""
        code = self._code(value)
        first, last = self._range(code, self.n if stop is None else stop) if code is not None else (0, 0)
        return last - first

    def select(self, value: int, k: int) -> int:
        """Position of the ``k``-th occurrence of a value, from 0."""
        code = self._code(value)
        first, last = self._range(code, self.n) if code is not None else (0, 0)
        if not 0 <= k < last - first:
            raise IndexError(k)
        at = first + k
        for level in reversed(range(self.levels)):
            at = self._position(level, at - self.zeros[level], True) if code >> (self.levels - 1 - level) & 1 else self._position(level, at, False)
        return at

    def _position(self, level: int, k: int, one: bool) -> int:
        """Position of the ``k``-th one or zero of a plane, by bisection over its counts."""
        low, high = 0, -(-self.n // _BLOCK) - 1
        while low < high:
            middle = (low + high + 1) // 2
            ones = int(self.table(f"ones{level}", middle, middle + 1)[0])
            low, high = (middle, high) if (ones if one else middle * _BLOCK - ones) <= k else (low, middle - 1)
        ones = int(self.table(f"ones{level}", low, low + 1)[0])
        bits = np.unpackbits(self.table(f"bits{level}", low * _BLOCK // 8, (low + 1) * _BLOCK // 8))
        return low * _BLOCK + int(np.flatnonzero(bits == one)[k - (ones if one else low * _BLOCK - ones)])

    def occurrences(self, value: int) -> list[int]:
        return [self.select(value, k) for k in range(self.count(value))]
