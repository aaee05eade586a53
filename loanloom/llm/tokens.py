"""Token ids as ORC files: integer run-length encoding, row indexes, Bloom filters on document ids."""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..sources.tables import new_path
from .batches import slices
from .pieces import pieces_of, tokenizer_text

END_ID = 2
CACHED = 600_000  # pieces a worker keeps
ORC_OPTIONS = {
    "compression": "zstd", "orc.stripe.size": str(16 << 20), "orc.create.index": "true", "orc.row.index.stride": "1000",
    "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01",
}
BROADCAST_FILES = 1 << 20


@dataclass(frozen=True)
class TokenFiles:
    """A folder of ORC files (doc_id, part, at, n_tokens, ids) in ascending doc_id order.

    Files follow each other in order of ``part``; ``at`` counts the ids before a document
    within its part.
    """

    spark: SparkSession
    path: str

    def rows(self, doc_ids: list[int] | None = None) -> DataFrame:
        """The files' rows; with ``doc_ids`` stripes and row groups are skipped by their metadata.

        The files are read by ORC stripe, so one large file keeps many tasks busy.
        """
        df = self.spark.read.orc(self.path)
        return df if doc_ids is None else df.filter(F.col("doc_id").isin(doc_ids))

    def documents(self, doc_ids: list[int] | None = None) -> DataFrame:
        """(doc_id, start, n_tokens, ids): ``start`` counts the ids of all documents before.

        A part's offset comes from the sums of ``n_tokens``, of which there is one per file.
        """
        sums = self.rows().groupBy("part").agg(F.sum("n_tokens").alias("n")).toPandas().sort_values("part")
        offsets = sums.assign(offset=sums["n"].cumsum() - sums["n"])[["part", "offset"]].astype({"part": "int32", "offset": "int64"})
        table = self.spark.createDataFrame(offsets, "part int, offset long")
        table = F.broadcast(table) if len(offsets) <= BROADCAST_FILES else table
        return self.rows(doc_ids).join(table, "part").select(
            "doc_id", (F.col("offset") + F.col("at")).alias("start"), "n_tokens", "ids")


def write_tokens(docs: DataFrame, tokenizer: str, path: str | None = None, end_id: int = END_ID) -> TokenFiles:
    """Encode the texts of ``docs`` (doc_id, text; others are left out) and write them in doc_id order.

    ``tokenizer`` is the path of a tokenizers file. A null text is empty; every document
    ends with ``end_id``. Null ids come first; rows with one id are ordered by their
    text's hash and dealt out over parts however many they are. Texts move once, in
    ranges of the id, before they are encoded.
    """
    json = tokenizer_text(tokenizer)
    path = path or new_path(docs.sparkSession, "tokens")

    def run(batches):
        pieces, part, done = pieces_of(json, CACHED), TaskContext.get().partitionId(), 0
        end = np.array([end_id], "<u4").tobytes()
        for batch in slices(batches, 1):
            ids = [pieces.encode(t) + end if t else end for t in batch.column(1).to_pylist()]
            counts = np.array([len(i) // 4 for i in ids], np.int64)
            offsets = np.concatenate(([0], np.cumsum(counts)))
            flat = np.frombuffer(b"".join(ids), "<i4")
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(np.full(len(ids), part, np.int32)), pa.array(done + offsets[:-1]), pa.array(counts),
                pa.ListArray.from_arrays(offsets.astype(np.int32), flat),
            ], ["doc_id", "part", "at", "n_tokens", "ids"])
            done += int(offsets[-1])

    ordered = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
        F.xxhash64("text").alias("tie"), F.monotonically_increasing_id().alias("row"),
    ).repartitionByRange("doc_id", "tie", "row").sortWithinPartitions("doc_id", "tie", "row")
    encoded = ordered.select("doc_id", "text").mapInArrow(run, "doc_id long, part int, at long, n_tokens long, ids array<int>")
    encoded.write.options(**ORC_OPTIONS).orc(path)
    return TokenFiles(docs.sparkSession, path)


def token_digests(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Documents written and read back: doc_id, start, n_tokens, ids_crc32."""
    def run(batches):
        for batch in batches:
            lists = batch.column(3)
            values, offsets = lists.values.to_numpy(), lists.offsets.to_numpy()
            sums = [zlib.crc32(values[a:b].astype("<u4").tobytes()) for a, b in zip(offsets[:-1], offsets[1:])]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return write_tokens(docs, tokenizer).documents().mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
