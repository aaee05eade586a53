"""BPE encoding with reuse of content-defined chunks, and decoding.

Texts are cut where a rolling hash of the last characters has its low bits clear, so the
same passage is cut alike wherever it stands. The ``SHARED_CHUNKS`` chunks that save most
are encoded once, on Spark, and handed to all tasks; others are kept by a task while its
cache has room for them, and encoded anew where they come again later.
A cut may run through a word: at each seam the last pieces of the left and the first of
the right chunk are encoded again, together, and spliced in where the outer pieces agree;
where they don't, the chunks are encoded as one. A run of chunks without agreement, such
as a text without white space, is cut anew only when it has grown by half, and encoded
once, when it ends.
"""

from __future__ import annotations

import hashlib
import uuid
from collections import Counter
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .batches import slices
from .pieces import Pieces, per_process, pieces_of, tokenizer_text

WINDOW = 16
CUT_BITS = 8
LEAST_CHARS = 64
MOST_CHARS = 4096
SHARED_CHUNKS = 4096
EDGE = 2  # pieces on either side of a seam
_FACTOR = 0x01000193


def cuts(text: str) -> list[int]:
    """Ends of the chunks of a text, its own end included."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    hashes, span = codes * np.uint32(0x9E3779B1), 1
    while span < WINDOW:  # a window of twice the length from two of the last
        grown = hashes.copy()
        grown[span:] += hashes[:-span] * np.uint32(pow(_FACTOR, span, 1 << 32))
        hashes, span = grown, span * 2
    hits = np.flatnonzero((hashes ^ (hashes >> np.uint32(15))) & np.uint32((1 << CUT_BITS) - 1) == 0) + 1
    out, last, n = [], 0, len(codes)
    for at in hits.tolist():
        while at - last > MOST_CHARS:
            last += MOST_CHARS
            out.append(last)
        if at - last >= LEAST_CHARS and at < n:
            out.append(at)
            last = at
    while n - last > MOST_CHARS:
        last += MOST_CHARS
        out.append(last)
    return [*out, n]


def chunks_of(text: str) -> list[str]:
    ends = cuts(text)
    return [text[a:b] for a, b in zip([0, *ends], ends)]


def chunk_name(chunk: str) -> int:
    return int.from_bytes(hashlib.blake2b(chunk.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


class Chunk:
    """A chunk with its pieces at both ends; ``ids`` of all its pieces are made when they are first asked for."""

    __slots__ = ("text", "head", "tail", "count", "_pieces", "_parts", "_ids", "_edges")

    def __init__(self, text: str, pieces: Pieces, ids: bytes | None = None):
        parts = pieces.cut(text)
        self.text, self.count, self._pieces, self._edges = text, len(parts), pieces, None
        self.head, self.tail = parts[:EDGE], parts[-EDGE:]
        self._ids, self._parts = ids, None if ids is not None else parts

    @property
    def ids(self) -> bytes:
        if self._ids is None:
            self._ids = b"".join(map(self._pieces.__getitem__, self._parts))
            self._parts = None
        return self._ids

    @property
    def edges(self) -> tuple[int, int]:
        """How many bytes of ids the first and the last pieces have."""
        if self._edges is None:
            self._edges = tuple(sum(len(self._pieces[p]) for p in edge) for edge in (self.head, self.tail))
        return self._edges


class ChunkEncoder:
    """Encodes texts from chunks; ``shared`` are chunks that came encoded, the task's own are kept beside."""

    def __init__(self, pieces: Pieces, shared: dict[str, Chunk], keep: int = 8_000):
        self.pieces, self.shared, self.own, self.keep = pieces, shared, {}, keep
        self.encoded = self.reused = self.repaired = 0

    def chunk(self, text: str) -> Chunk:
        found = self.shared.get(text) or self.own.get(text)
        if found is not None:
            self.reused += 1
            return found
        self.encoded += 1
        made = Chunk(text, self.pieces)
        if len(self.own) >= self.keep:
            for old in list(islice(self.own, self.keep // 2)):
                del self.own[old]
        self.own[text] = made
        return made

    def _seam(self, left: Chunk, right: Chunk) -> bytes | None:
        """Ids between the two chunks' inner pieces; None for too few pieces, or without agreement."""
        if left.count < 2 * EDGE or right.count < 2 * EDGE:
            return None
        seam = self.pieces.cut("".join(left.tail + right.head))
        if seam[0] != left.tail[0] or seam[-1] != right.head[-1]:
            return None
        self.repaired += seam != left.tail + right.head
        return b"".join(map(self.pieces.__getitem__, seam))

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if not self.pieces.sound(text):
            return self.pieces.whole(text)
        out, left, skip = [], None, 0
        waiting, chars, run = [], 0, False  # chunks that belong to the left one but were not cut with it yet
        for end in chunks_of(text):
            if left is None:
                left = self.chunk(end)
                continue
            if not waiting:
                right = self.chunk(end)
                joined = self._seam(left, right)
                if joined is not None:
                    out += [left.ids[skip:len(left.ids) - left.edges[1]], joined]
                    left, skip, run = right, right.edges[0], False
                    continue
            waiting.append(end)
            chars += len(end)
            if not run or 2 * chars >= len(left.text):
                left, run = Chunk("".join([left.text, *waiting]), self.pieces), True
                waiting, chars = [], 0
        if waiting:
            left = Chunk("".join([left.text, *waiting]), self.pieces)
        return b"".join([*out, left.ids[skip:]])


def shared_chunks(docs: DataFrame, json: str, most: int = SHARED_CHUNKS) -> dict[str, bytes]:
    """The chunks that save most when encoded once, of all that occur twice or more, with their ids.

    Counted over all documents by name, with partial counts per task; then their texts are
    fetched from one document each and encoded on Spark. ``most`` bounds what is handed to
    all tasks (at most ``most`` times ``MOST_CHARS`` characters); every other chunk is
    encoded where it occurs.
    """
    def count(batches):
        seen: Counter = Counter()
        first: dict[int, int] = {}

        def rows():
            return pa.RecordBatch.from_arrays([
                pa.array([k for k, _ in seen], pa.int64()), pa.array(list(seen.values()), pa.int64()),
                pa.array([n for _, n in seen], pa.int64()), pa.array([first[k] for k, _ in seen], pa.int64())], ["name", "n", "chars", "doc"])

        for batch in slices(batches, 1):
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if text:
                    for c in chunks_of(text):
                        name = chunk_name(c)
                        seen[name, len(c)] += 1
                        first.setdefault(name, doc)
            if len(seen) >= 200_000:
                yield rows()
                seen.clear()
                first.clear()
        if seen:
            yield rows()

    counted = docs.select("doc_id", "text").mapInArrow(count, "name long, n long, chars long, doc long").groupBy("name").agg(
        F.sum("n").alias("n"), F.max("chars").alias("chars"), F.min("doc").alias("doc")).filter("n > 1")
    best = counted.orderBy(F.desc(F.expr("(n - 1) * chars")), "name").limit(most).select("name", "doc").toArrow()
    names = frozenset(best["name"].to_pylist())
    if not names:
        return {}
    sources = docs.sparkSession.createDataFrame([(d,) for d in sorted({d for d in best["doc"].to_pylist() if d is not None})], "doc_id long")
    anonymous = docs.filter("doc_id IS NULL").select("text") if None in best["doc"].to_pylist() else None  # chunks of rows without id alone
    holding = docs.join(F.broadcast(sources), "doc_id", "left_semi").select("text")
    holding = holding if anonymous is None else holding.union(anonymous)

    def fetch(batches):
        sent: set[int] = set()
        for batch in slices(batches, 0):
            out = []
            for text in batch.column(0).to_pylist():
                for c in chunks_of(text) if text else ():
                    name = chunk_name(c)
                    if name in names and name not in sent:
                        sent.add(name)
                        out.append((name, c))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in out], pa.int64()), pa.array([c for _, c in out])], ["name", "chunk"])

    def encode(batches):
        pieces = pieces_of(json)
        for batch in batches:
            ids = [pieces.encode(c) for c in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], ["chunk", "ids"])

    texts = holding.mapInArrow(fetch, "name long, chunk string").groupBy("name").agg(F.min("chunk").alias("chunk"))
    found = texts.select("chunk").mapInArrow(encode, "chunk string, ids binary").toArrow()
    return dict(zip(found["chunk"].to_pylist(), found["ids"].to_pylist()))


def encode_documents(docs: DataFrame, tokenizer: str, most: int = SHARED_CHUNKS) -> DataFrame:
    """(doc_id, ids) of every row of ``docs`` (doc_id, text; others are left out).

    ``ids`` holds little-endian unsigned 32-bit integers, equal to those of the tokenizers
    library for the whole text without added special tokens; a null or empty text has none.
    Texts are read three times (count, fetch, encode) and never shuffled.
    """
    json = tokenizer_text(tokenizer)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ready, version = docs.sparkSession.sparkContext.broadcast(shared_chunks(docs, json, most)), uuid.uuid4().hex

    def run(batches):
        pieces = pieces_of(json)
        shared = per_process("chunks", version, lambda: {c: Chunk(c, pieces, ids) for c, ids in ready.value.items()})
        encoder = ChunkEncoder(pieces, shared)
        for batch in slices(batches, 1):
            ids = [encoder.encode(t or "") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    return docs.mapInArrow(run, "doc_id long, ids binary")


def decode_documents(encoded: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, ids, text) with the library's decoding of ``ids``, special tokens kept."""
    json = tokenizer_text(tokenizer)

    def run(batches):
        pieces = pieces_of(json)
        for batch in slices(batches, 1):
            texts = [pieces.decode(i) for i in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["doc_id", "ids", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids binary, text string")


def round_trip(docs: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every document, encoded and decoded."""
    both = decode_documents(encode_documents(docs, tokenizer), tokenizer)
    return both.select(
        "doc_id", F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))
