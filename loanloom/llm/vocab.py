"""Words of texts as exact local numbers, block by block.

Texts are read as bytes: a table marks the bytes of words, another those at which a
sequence of words ends. Within a block equal words get equal numbers (an Arrow
dictionary of the words themselves, no hashes), so counts per block are exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from .batches import _BASE, _LOWER, _VALUES, _powers, mix, rows_of, slices

BLOCK_BYTES = 4 << 20


def byte_table(*spans: int | tuple[int, int]) -> np.ndarray:
    """Marks the bytes, and the ranges of bytes, that are named."""
    table = np.zeros(256, bool)
    for span in spans:
        first, last = span if isinstance(span, tuple) else (span, span)
        table[first:last + 1] = True
    return table


@dataclass
class Block:
    """``rows``: the batch the words are from; ``row``, ``ids``: of each word; ``words``: what the ids stand for.

    ``run[i]`` is equal for words that no break separates. ``own`` words belong to this
    block, the rest only complete the sequences that begin in it. ``again``: the block goes
    on with the text of the one before.
    """

    rows: pa.RecordBatch
    row: np.ndarray
    ids: np.ndarray
    words: pa.Array
    run: np.ndarray
    own: int
    again: bool = False

    def starts(self, n: int) -> np.ndarray:
        """Where the sequences of ``n`` words of this block begin."""
        last = len(self.ids) - n + 1
        if last < 1:
            return np.zeros(0, np.int64)
        found = np.flatnonzero(self.run[:last] == self.run[n - 1:])
        return found[found < self.own]


class WordBlocks:
    """Cuts record batches into blocks of words; A-Z are lower-cased.

    ``word`` and ``stop`` are byte tables; ``ahead`` words beyond its own are read in a
    block of a text that is longer than a block, so that no sequence is lost at a cut.
    """

    def __init__(self, word: np.ndarray, stop: np.ndarray, ahead: int = 0, size: int = BLOCK_BYTES):
        self.word, self.stop, self.ahead, self.size = word, stop & ~word, ahead, size

    def of(self, batches, column: str = "text") -> Iterator[Block]:
        for rows in slices(batches, column, self.size):
            texts = rows.column(column).cast(pa.large_string()).fill_null("")
            offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
            data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0]:offsets[-1]]
            offsets = offsets - offsets[0]
            if len(data) <= self.size or rows.num_rows > 1:
                yield self._block(rows, data, offsets, len(data))
                continue
            at = 0
            while at < len(data):
                end = self._next(data, at + self.size, 0)
                beyond = self._next(data, end, self.ahead)
                yield self._block(rows, data[at:beyond], np.array([0, beyond - at]), end - at, at > 0)
                at = end

    def _next(self, data: np.ndarray, at: int, words: int) -> int:
        """The first place from ``at`` on that is in no word; with ``words``, the end of so many more, or a break before it."""
        span = 256
        while at < len(data):
            inside = self.word[data[at:at + span]]
            ends = np.flatnonzero(inside[:-1] & ~inside[1:]) + 1 if words else np.flatnonzero(~inside)
            done = ends[max(words, 1) - 1:][:1].tolist()
            if words:
                done += np.flatnonzero(self.stop[data[at:at + span]])[:1].tolist()
            if done:
                return at + min(done)
            if at + span >= len(data):
                break
            span *= 4
        return len(data)

    def _block(self, rows: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray, limit: int, again: bool = False) -> Block:
        word = self.word[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        starts = np.flatnonzero(word & (~np.concatenate(([False], word[:-1])) | edge[:-1])) if len(data) else np.zeros(0, np.int64)
        ends = np.flatnonzero(word & (~np.concatenate((word[1:], [False])) | edge[1:])) + 1 if len(data) else starts
        bounds = np.searchsorted(starts, offsets)
        row = rows_of(bounds)
        breaks = np.cumsum(self.stop[data] | edge[:-1], dtype=np.int32) if len(data) else starts
        marks = np.concatenate(([0], np.cumsum(ends - starts)))
        kept = np.ascontiguousarray(_LOWER[data[word]])
        coded = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(marks), pa.py_buffer(kept)]).dictionary_encode()
        return Block(rows, row, coded.indices.to_numpy().astype(np.int64), coded.dictionary, breaks[starts], int(np.searchsorted(starts, limit)), again)


def word_hashes(words: pa.Array) -> np.ndarray:
    """64-bit hashes of words, none of which is empty."""
    words = words.cast(pa.large_binary())
    offsets = np.frombuffer(words.buffers()[1], np.int64)[words.offset:words.offset + len(words) + 1]
    if not len(words):
        return np.zeros(0, np.uint64)
    data = np.frombuffer(words.buffers()[2], np.uint8)[offsets[0]:offsets[-1]]
    starts, sizes = offsets[:-1] - offsets[0], np.diff(offsets)
    place = np.arange(len(data)) - np.repeat(starts, sizes)
    sums = np.add.reduceat(_VALUES[data] * _powers(_BASE, int(sizes.max()))[place], starts)
    return mix(sums + sizes.astype(np.uint64) * np.uint64(_BASE))
