"""Words of many texts at once, in numpy: a word is a run of bytes other than space and \\t to \\r."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def large_binary(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """An Arrow array of the byte strings that lie one after another in ``data``."""
    offsets = np.concatenate([np.zeros(1, np.int64), ends.astype(np.int64)])
    return pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def bytes_of(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all bytes, offsets) of a large_binary array."""
    _, offsets, data = col.buffers()
    off = np.frombuffer(offsets, np.int64)[col.offset:col.offset + len(col) + 1]
    if data is None:
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[off[0]:off[-1]], off - off[0]


def pieces(col: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    """Row ranges of a string array that hold at most ``most`` bytes each (or one row)."""
    size = np.concatenate([[0], np.cumsum(pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False))])
    at = 0
    while at < len(col):
        to = max(at + 1, int(np.searchsorted(size, size[at] + most, "right")) - 1)
        yield at, to
        at = to


class Words:
    """The words of an Arrow array of texts (NULL: none).

    ``doc_ends``: number of words up to the end of each text; ``codes``: the word's number in
    ``distinct``; equal words of any two texts have equal codes.
    """

    def __init__(self, texts: pa.Array):
        col = pc.fill_null(texts.cast(pa.large_binary()), b"")
        data, off = bytes_of(pc.binary_join_element_wise(col, pa.scalar(b"", pa.large_binary()),
                                                         pa.scalar(b" ", pa.large_binary())))
        inside = ~_SPACE[data]
        edge = np.diff(inside, prepend=False, append=False) if len(data) else np.zeros(0, bool)
        edges = np.flatnonzero(edge)
        starts, ends = edges[::2], edges[1::2]       # every text ends with a space
        self.lengths = ends - starts
        self.doc_ends = np.searchsorted(starts, off[1:])
        inside[ends] = True
        spaced = data.copy()
        spaced[ends] = 0x20
        self._spaced = spaced[inside]                # every word with one space behind it
        kept = np.ones(len(self._spaced), bool)
        kept[np.cumsum(self.lengths + 1) - 1] = False
        words = large_binary(self._spaced[kept], np.cumsum(self.lengths)).dictionary_encode()
        self.codes = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.distinct = words.dictionary

    @property
    def doc_starts(self) -> np.ndarray:
        return np.concatenate([np.zeros(1, np.int64), self.doc_ends[:-1]])

    def joined(self, keep: np.ndarray) -> pa.Array:
        """Each text's kept words, joined by one space."""
        sizes = (self.lengths + 1) * keep
        ends = np.concatenate([[0], np.cumsum(sizes)])[self.doc_ends]
        data = self._spaced[np.repeat(keep, self.lengths + 1)]
        some = np.diff(ends, prepend=0) > 0
        without = np.ones(len(data), bool)
        without[ends[some] - 1] = False              # the space behind a text's last word
        return large_binary(data[without], ends - np.cumsum(some)).cast(pa.large_string())
