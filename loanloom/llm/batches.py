"""What the operators share: bounded Arrow slices, texts as byte arrays, word hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame

BLOCK_BYTES = 1 << 20
WORD_BYTES = 1 << 18  # hashed at once: a byte takes some fifty while its word is found
BATCH_LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 4 << 20  # of texts that Spark hands to a Python task at once, where the session sets no limit
_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15 | 1
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def bounded(docs: DataFrame) -> DataFrame:
    """``docs``, of whose session Python tasks get batches of limited bytes. Without a limit Spark holds
    ten thousand texts, however long, per task on both sides."""
    conf = docs.sparkSession.conf
    if conf.get(BATCH_LIMIT, None) is None:
        conf.set(BATCH_LIMIT, str(BATCH_BYTES))
    return docs


def slices(batches, column: str | int = "text", most: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that each holds at most ``most`` bytes of the column, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0), dtype=np.int64)
        ends, first = np.cumsum(sizes), 0
        while first < len(sizes):
            before = ends[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(ends, before + most, "right")))
            yield batch.slice(first, last - first)
            first = last


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit words."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    done = 1
    while done < n:  # doubling: out[done:2*done] = out[:done] * base**done
        take = min(done, n - done)
        out[done:done + take] = out[:take] * np.uint64(pow(base, done, 1 << 64))
        done += take
    return out


class Words:
    """Hashes of words: runs of bytes that a table marks, with bytes mapped by another table.

    ``of(texts)`` gives the 64-bit hashes of all words of an Arrow string column
    and the number of words before each row; a null row has no words. Longer
    inputs than a block are hashed block by block, cut between words, so memory
    stays bounded by the block and eight bytes a word. With ``most`` only so many first
    bytes of a word are hashed.
    """

    def __init__(self, space: np.ndarray = _SPACE, lower: np.ndarray = _LOWER, block: int = WORD_BYTES, most: int | None = None):
        self.space, self.values, self.block, self.most = space, _VALUES[lower], block, most
        self.powers = self.inverse = np.ones(0, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.powers) < n:
            self.powers = _powers(_BASE, n)
            self.inverse = _powers(pow(_BASE, -1, 1 << 64), n)

    def _hash(self, data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes and start positions of the words of a block; no word spans a cut."""
        word = ~self.space[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[cuts] = True
        before = np.concatenate(([False], word[:-1]))
        starts = np.flatnonzero(word & (~before | edge[:-1]))
        after = np.concatenate((word[1:], [False]))
        ends = np.flatnonzero(word & (~after | edge[1:])) + 1
        if self.most:
            ends = np.minimum(ends, starts + self.most)
        self._grow(len(data) + 1)
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.values[data] * self.powers[:len(data)], out=sums[1:])
        hashes = (sums[ends] - sums[starts]) * self.inverse[starts]
        return mix(hashes + (ends - starts).astype(np.uint64) * np.uint64(_BASE)), starts

    def of(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        texts = texts.cast(pa.large_string()).fill_null("")
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0]:offsets[-1]]
        offsets = offsets - offsets[0]
        hashes, starts, at = [], [], 0
        while at < len(data):
            end = min(at + self.block, len(data))
            if end < len(data):  # back to the last space, or on to the next where a word fills the block
                spaces = np.flatnonzero(self.space[data[at:end]])
                while not len(spaces) and end < len(data):
                    ahead = np.flatnonzero(self.space[data[end:end + self.block]])
                    end = end + int(ahead[0]) + 1 if len(ahead) else min(end + self.block, len(data))
                    if len(ahead):
                        break
                if len(spaces):
                    end = at + int(spaces[-1]) + 1
            inside = offsets[(offsets > at) & (offsets < end)] - at
            h, s = self._hash(data[at:end], inside)
            hashes.append(h)
            starts.append(s + at)
            at = end
        if not hashes:
            return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
        return np.concatenate(hashes), np.searchsorted(np.concatenate(starts), offsets)


def rows_of(bounds: np.ndarray) -> np.ndarray:
    """The row of each item, given the number of items before each row."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
