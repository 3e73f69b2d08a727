"""Words of Arrow text columns as byte positions, block by block."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# A-Z to a-z, other bytes as they are
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    """Whether a byte lies in one of the ranges, ends included."""
    table = np.zeros(256, bool)
    for first, last in ranges:
        table[first : last + 1] = True
    return table


def text_blocks(batches: Iterator[pa.RecordBatch], limit: int, text: str = "text") -> Iterator[pa.RecordBatch]:
    """The rows dealt anew in blocks of about ``limit`` bytes of text; a longer text is a block of its own.

    Null texts become empty ones.
    """
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        at = batch.schema.get_field_index(text)
        batch = batch.set_column(at, text, pc.fill_null(batch.column(at), ""))
        ends = np.cumsum(pc.binary_length(batch.column(at)).to_numpy(zero_copy_only=False))
        start = 0
        while start < batch.num_rows:
            before = int(ends[start - 1]) if start else 0
            stop = min(batch.num_rows, max(start + 1, int(np.searchsorted(ends, before + limit - size, "right"))))
            held.append(batch.slice(start, stop - start))
            size += int(ends[stop - 1]) - before
            start = stop
            if size >= limit or start < batch.num_rows:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


class Words:
    """The words of a block of texts: maximal runs of the bytes in ``kind``, A-Z lower-cased.

    ``flat`` holds all texts, each followed by a line feed, which must be no word byte; word ``i``
    is ``flat[starts[i]:ends[i]]``; ``counts`` has the words of each text.
    """

    def __init__(self, texts: pa.Array, kind: np.ndarray) -> None:
        joined = pc.binary_join_element_wise(texts.cast(pa.large_string()), pa.scalar("", pa.large_string()), pa.scalar("\n", pa.large_string()))
        buffers = joined.buffers()
        offsets = np.frombuffer(buffers[1], np.int64)[joined.offset : joined.offset + len(joined) + 1]
        raw = np.frombuffer(buffers[2], np.uint8)[offsets[0] : offsets[-1]] if len(joined) else np.zeros(0, np.uint8)
        self.flat = LOWER[raw]
        inside = kind[self.flat]
        edges = np.flatnonzero(np.diff(inside.view(np.int8), prepend=np.int8(0), append=np.int8(0)))
        self.starts, self.ends = edges[::2], edges[1::2]
        at = np.searchsorted(self.starts, offsets - offsets[0])
        self.counts = np.diff(at)
        self._inside = inside

    def strings(self) -> pa.Array:
        """The words as an Arrow array."""
        sizes = self.ends - self.starts
        offsets = np.zeros(len(sizes) + 1, np.int64)
        np.cumsum(sizes, out=offsets[1:])
        return pa.LargeStringArray.from_buffers(len(sizes), pa.py_buffer(offsets), pa.py_buffer(self.flat[self._inside]))


def give_back() -> None:
    """Return freed memory to the system: a worker stays between tasks, and what it holds is lost to the executor."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)
