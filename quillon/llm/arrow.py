"""Small Arrow helpers for ``mapInArrow`` functions."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once; a longer text is a slice of its own.
SLICE_BYTES = 4 << 20


def text_slices(batch: pa.RecordBatch, text: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts a batch where its texts pass ``limit`` bytes; no row is left out."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(sizes.astype(np.int64)) // limit
    cuts = np.flatnonzero(np.diff(part)) + 1
    for lo, hi in zip([0, *cuts], [*cuts, len(sizes)]):
        if hi > lo:
            yield batch.slice(lo, hi - lo)


def binaries(parts: list[bytes]) -> pa.Array:
    return pa.array(parts, type=pa.binary())


def lists(values: pa.Array, offsets: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, type=pa.int32()), values)


def string_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a null-free large_string array end to end, and n + 1 bounds."""
    _, offsets, data = texts.buffers()
    bounds = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo, hi = (int(bounds[0]), int(bounds[-1])) if len(bounds) else (0, 0)
    return raw[lo:hi], bounds - lo


_HELD: dict[str, Callable[[], None]] = {}


def begin_task(owner: str = "", clear: Callable[[], None] | None = None) -> None:
    """Called where a task's Python begins: Spark reuses workers, so caches that
    another operator left are dropped, and freed memory goes back."""
    others = [name for name in _HELD if name != owner]
    for name in others:
        _HELD.pop(name)()
    if clear is not None:
        _HELD[owner] = clear
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)
