"""Words of many texts at once, as numpy arrays over an Arrow column's own bytes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from .recompression import _ODD, mix

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_MARK = np.zeros(256, bool)
_MARK[list(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), 0xC3]] = True
_KEEP = np.array([(1 << (8 * i)) - 1 for i in range(9)], np.uint64)  # the low i bytes of eight


@dataclass
class Words:
    data: np.ndarray  # bytes of all texts
    start: np.ndarray  # of each word, in data
    end: np.ndarray
    first: np.ndarray  # of each text, in words
    last: np.ndarray  # of each text, past its last word

    @property
    def hashes(self) -> np.ndarray:
        return self.hashed(_ODD)

    def hashed(self, odd: np.uint64) -> np.ndarray:
        """A 64-bit hash of each word's bytes, eight of them at a time, by an odd multiplier."""
        padded = np.r_[self.data, np.zeros(8, np.uint8)]
        eights = np.ndarray(len(self.data) + 1, "<u8", padded, strides=(1,))
        size = self.end - self.start
        out = mix(size.astype(np.uint64) + odd)
        at, k = np.arange(len(size)), 0
        while len(at):
            out[at] = mix(out[at] * odd + (eights[self.start[at] + k] & _KEEP[np.minimum(size[at] - k, 8)]))
            k += 8
            at = at[size[at] > k]
        return out


def trimmed(w: Words) -> Words:
    """The same words without ASCII punctuation at their ends; a word of punctuation alone keeps its first character."""
    start, end = w.start.copy(), w.end.copy()
    for move, edge in ((-1, end), (1, start)):
        at = np.arange(len(edge))
        while len(at):
            at = at[_MARK[w.data[edge[at] - (move < 0)]] & (end[at] - start[at] > 1)]
            edge[at] += move
    return Words(w.data, start, end, w.first, w.last)


def column_of(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The stretches data[start:end] as a binary column."""
    size = end - start
    at = np.r_[0, np.cumsum(size)].astype(np.int64)
    body = data[np.repeat(start - at[:-1], size) + np.arange(at[-1])]
    return pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(at.tobytes()), pa.py_buffer(body.tobytes())]).cast(pa.binary())


def tokenise(column: pa.Array, lower: bool = False, letters: bool = False) -> Words:
    """Words of a string column; a null text has none. lower: A-Z as a-z. letters: maximal runs of A-Z, a-z and U+00C0 to U+00FF instead."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(pa.large_binary()) if len(column) else pa.array([], pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    raw, offsets = (_LOWER[raw] if lower else raw), offsets - offsets[0]
    inside = _LETTER[raw] if letters else ~_SPACE[raw]
    if letters:  # what begins with the byte C3 is U+00C0 to U+00FF
        inside[1:] |= raw[:-1] == 0xC3
    solid = np.r_[False, inside, False]
    cut = np.zeros(len(raw) + 1, bool)
    cut[offsets] = True  # a word never goes from one text into the next
    start = np.flatnonzero(solid[1:-1] & (~solid[:-2] | cut[:-1]))
    end = np.flatnonzero(solid[1:-1] & (~solid[2:] | cut[1:])) + 1
    bounds = np.searchsorted(start, offsets)
    return Words(raw, start, end, bounds[:-1], bounds[1:])


def row_slices(batch: pa.RecordBatch | pa.Table, most: int, text: str = "text") -> Iterator[pa.RecordBatch | pa.Table]:
    """Runs of whole rows that hold about `most` bytes of text; one longer text is a run of its own."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy()
    total, at = np.cumsum(sizes), 0
    while at < len(sizes):
        upto = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + most, side="right")))
        yield batch.slice(at, upto - at)
        at = upto
