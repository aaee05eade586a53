"""Sharding by histogram sort: exact byte counts below candidate boundaries, refined until balanced, one exchange."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..sources.tables import materialized

LOW, HIGH = -(1 << 63), (1 << 63) - 1


def order_key(text: str, *rest) -> F.Column:
    """A 64-bit sort key: 40 bits of the text's hash, then 24 bits that set apart rows of one text.

    Copies lie side by side, yet a boundary can run through a text that a third of
    all rows share.
    """
    high = F.shiftleft(F.shiftright(F.xxhash64(F.col(text)), 24), 24)
    return high.bitwiseOR(F.xxhash64(*rest).bitwiseAND(F.lit((1 << 24) - 1)))


def _counts(df: DataFrame, key: str, size: str, probes: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Exact bytes and rows between neighbouring probes; a task returns one row per gap it met."""
    edges = np.array(probes, np.int64)

    def run(batches):
        total, rows = np.zeros(len(edges) + 1, np.int64), np.zeros(len(edges) + 1, np.int64)
        for batch in batches:
            at = np.searchsorted(edges, batch.column(0).to_numpy(zero_copy_only=False), "right")
            np.add.at(total, at, batch.column(1).to_numpy(zero_copy_only=False))
            rows += np.bincount(at, minlength=len(rows))
        met = np.flatnonzero(rows)
        yield pa.RecordBatch.from_arrays([pa.array(met, pa.int64()), pa.array(total[met]), pa.array(rows[met])], ["gap", "bytes", "rows"])

    found = df.select(key, size).mapInArrow(run, "gap long, bytes long, rows long").groupBy("gap").agg(
        F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows")).toPandas()
    total, rows = np.zeros(len(edges) + 1, np.int64), np.zeros(len(edges) + 1, np.int64)
    total[found["gap"].to_numpy()] = found["bytes"].to_numpy()
    rows[found["gap"].to_numpy()] = found["rows"].to_numpy()
    return total, rows


def splitters(df: DataFrame, key: str, size: str, parts: int, coarse: int, tolerance: float = 0.002, fine: int = 8) -> tuple[list[int], np.ndarray]:
    """``parts - 1`` boundaries in key order, and the exact rows of each part.

    Every ``coarse``-th boundary bounds a shard and must have its share of the bytes
    below it to within ``tolerance`` of a shard; the others may be off by a tenth of a
    part. Each round counts, in one pass, the bytes below ``fine`` further probes of
    every interval that still holds an unsettled boundary, and stops at the tolerance
    or where an interval holds a single key. The driver keeps a few numbers per boundary.
    """
    probes = sorted({LOW + (HIGH - LOW) * i // (parts * 4) for i in range(1, parts * 4)})
    while True:
        gaps, rows = _counts(df, key, size, probes)
        below = np.cumsum(gaps)[:-1]  # bytes below probes[i]
        total = int(gaps.sum())
        part = total / parts
        chosen, more = [], []
        for b in range(1, parts):
            goal = total * b / parts
            allowed = tolerance * part * coarse if b % coarse == 0 else 0.1 * part
            i = int(np.searchsorted(below, goal))
            near = [j for j in (i - 1, i) if 0 <= j < len(probes)]
            best = min(near, key=lambda j: abs(below[j] - goal))
            chosen.append(probes[best])
            if abs(below[best] - goal) > allowed:
                low = probes[i - 1] if i else LOW
                high = probes[i] if i < len(probes) else HIGH
                more += [low + (high - low) * k // (fine + 1) for k in range(1, fine + 1)]
        added = set(more) - set(probes) - {LOW}
        if not total or not added:
            break
        probes = sorted(set(probes) | added)
    index = {p: i for i, p in enumerate(probes)}
    bounds = sorted(chosen)
    upto = np.cumsum(rows)
    at = np.array([upto[index[p]] for p in bounds] + [upto[-1]])
    return bounds, np.diff(np.concatenate(([0], at)))


def histogram_shards(df: DataFrame, key: str, size: str, shards: int, tie: list[str], tolerance: float = 0.002) -> DataFrame:
    """Adds ``shard`` and ``slot`` to the rows of ``df``, which has a long ``key`` and a ``size`` in bytes.

    Shards are ranges of the key with near equal bytes; slots number a shard's rows
    from 0 in order of (key, tie columns). A shard is cut into parts of a few thousandths
    of the rows, so no task holds a shard; rows move once, to their part. Rows of equal
    key stay in one part. Columns named ``shard`` or ``slot`` are replaced.

    ``df`` is read once per round and must give the same rows each time: hand in a
    written table. An empty table gives no rows.
    """
    spark = df.sparkSession
    df = df.drop("shard", "slot", "shard_part")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    coarse = max(2, -(-2 * tasks // shards))
    bounds, rows = splitters(df, key, size, shards * coarse, coarse, tolerance)
    edges = np.array(bounds, np.int64)
    first = np.concatenate(([0], np.cumsum(rows)[:-1]))
    offset = first - first[np.arange(len(first)) // coarse * coarse]
    offsets = F.lit([int(x) for x in offset])

    @F.pandas_udf("int")
    def part_of(keys: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(edges, keys.to_numpy(), "right").astype(np.int32))

    placed = df.withColumn("shard_part", part_of(F.col(key)))
    within = F.row_number().over(Window.partitionBy("shard_part").orderBy(key, *tie))
    return placed.withColumn("slot", (F.element_at(offsets, F.col("shard_part") + 1) + within - 1).cast("long")).withColumn(
        "shard", F.floor(F.col("shard_part") / coarse).cast("int")).drop("shard_part")


def sharded_documents(docs: DataFrame, shards: int = 16) -> DataFrame:
    """Documents dealt into shards of near equal bytes: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    A row's size is its text's UTF-8 bytes plus 1; a null text has none and the crc32 of
    the empty text. Copies lie side by side within a shard, except where a boundary
    must run through a group to keep the shards even. Null ids and repeated rows are
    placed like any other. Only ids, sizes and hashes are written and moved.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    thin = docs.select(
        F.col("doc_id"), text.alias("body"), F.monotonically_increasing_id().alias("row")
    ).select(
        "doc_id", "row", (F.octet_length("body") + 1).cast("long").alias("size"),
        F.crc32(F.col("body").cast("binary")).alias("text_crc32"), order_key("body", "doc_id", "row").alias("key"),
    )
    placed = histogram_shards(materialized(thin, "shard-keys"), "key", "size", shards, ["doc_id", "row"])
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))
