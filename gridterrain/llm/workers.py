"""Helpers for functions that run in Python workers over Arrow batches."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa

# Texts are taken through numpy in slices of about this many bytes, which bounds a worker's memory.
SLICE_BYTES = 4 << 20
# Windows and n-grams of all words take some thirty times a slice's bytes.
SMALL_SLICE_BYTES = 1 << 20


def worker_cache(key: str, build: Callable):
    """The value that ``build`` made for ``key`` in this worker process, kept across its tasks."""
    holder = sys.modules.setdefault("gridterrain_worker_cache", types.ModuleType("gridterrain_worker_cache"))
    if not hasattr(holder, key):
        setattr(holder, key, build())
    return getattr(holder, key)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts of an Arrow column and the bounds of each; null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_string())
    bounds = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, 8 * column.offset) if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), bounds


def slices(bounds: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of texts ``(first, last + 1)`` of about ``most`` bytes; a longer text is a run of its own."""
    first = 0
    while first < len(bounds) - 1:
        last = max(first + 1, int(np.searchsorted(bounds, bounds[first] + most, "right")) - 1)
        yield first, last
        first = last


def small_slices(bounds: np.ndarray) -> Iterator[tuple[int, int]]:
    """``slices`` for work that takes many times the bytes of a slice."""
    return slices(bounds, SMALL_SLICE_BYTES)


def sorted_groups(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The groups of equal, not null integer ``keys`` in batches that are sorted by them, one at a time."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        values = np.stack([np.asarray(batch.column(k).to_numpy(zero_copy_only=False), np.int64) for k in keys])
        edges = np.flatnonzero((values[:, 1:] != values[:, :-1]).any(axis=0)) + 1
        for start, stop in zip([0, *edges.tolist()], [*edges.tolist(), batch.num_rows], strict=True):
            key = tuple(values[:, start].tolist())
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(start, stop - start))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def blob(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values).tobytes()
