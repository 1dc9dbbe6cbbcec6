"""Texts as rows of chunk numbers: every distinct chunk of a batch is worked on once, and no Python step runs per chunk.

A batch of texts is one buffer of bytes. Chunks are slices of that buffer, so Arrow numbers them without copying; what a chunk
stands for (token ids, say) is looked up per distinct chunk, and taken back into the order of the texts by Arrow.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text worked on at a time; a longer text is a batch of its own.
BATCH_BYTES = 2_000_000


class Chunks(NamedTuple):
    codes: pa.Array  # number of each chunk, in the order of the texts
    distinct: pa.Array  # the chunk of each number
    bounds: np.ndarray  # where each text's chunks begin; one entry more than texts


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, and where each begins; one entry more than texts. No text may be null."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def numbered_chunks(raw: np.ndarray, starts: np.ndarray, bounds: np.ndarray) -> Chunks:
    """Number the chunks that begin at `starts` and fill the buffer without gaps."""
    offsets = pa.py_buffer(np.append(starts, len(raw)).astype(np.int32))
    array = pa.Array.from_buffers(pa.string(), len(starts), [None, offsets, pa.py_buffer(raw)]).dictionary_encode()
    return Chunks(array.indices, array.dictionary, bounds)


def words_of(texts: pa.Array) -> Chunks:
    """The chunks between ASCII white space of each text; null texts have none."""
    raw, offsets = flat(pc.fill_null(texts, ""))
    inside = (raw != 32) & (raw - np.uint8(9) > 4)
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(raw))]
    begins[edges] = inside[edges]
    ends[edges - 1] = inside[edges - 1]
    starts = np.flatnonzero(begins)
    size = np.flatnonzero(ends) + 1 - starts
    # Without the blanks, chunks fill the buffer.
    return numbered_chunks(raw[inside], np.cumsum(size) - size, np.searchsorted(starts, offsets))


def taken(chunks: Chunks, values: Iterable[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """What the distinct chunks stand for, in the order of the texts, and where each text's bytes begin."""
    table = pa.array(values, pa.large_binary(), size=len(chunks.distinct))
    rows = table.take(chunks.codes)
    ends = np.frombuffer(rows.buffers()[1], np.int64)[: len(rows) + 1] if len(rows) else np.zeros(1, np.int64)
    data = rows.buffers()[2] if len(rows) else None
    raw = np.frombuffer(data, np.uint8)[: ends[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, ends[chunks.bounds]


def in_slices(batch: pa.RecordBatch, text: str, size: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in slices of bounded bytes of text; a longer text is a slice of its own."""
    column = batch.column(batch.schema.get_field_index(text))
    length = np.asarray(pc.fill_null(pc.binary_length(column), 0), np.int64)
    low = 0
    while low < batch.num_rows:
        high = low + max(1, int(np.searchsorted(np.cumsum(length[low:]), size, side="right")))
        yield batch.slice(low, high - low)
        low = high


class Remembered:
    """What each distinct chunk stands for, as bytes, kept over the batches of a worker."""

    def __init__(self, make: Callable[[list[str]], Iterable[bytes]], most: int = 100_000) -> None:
        self.make, self.most, self.known = make, most, {}

    def of(self, chunks: Chunks) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all chunks in the order of the texts, and where each text's begin."""
        wanted = chunks.distinct.to_pylist()
        if len(self.known) > self.most:
            self.known = {c: self.known[c] for c in wanted if c in self.known}
        new = [c for c in wanted if c not in self.known]
        if new:
            self.known.update(zip(new, self.make(new)))
        return taken(chunks, map(self.known.__getitem__, wanted))
