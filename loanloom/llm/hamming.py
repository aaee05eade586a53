"""Exact top-k search over binary codes by incremental multi-index hashing.

Codes of 128 bits are cut into m segments of about log2(N) bits. A code within
m * (r + 1) - 1 bits of a query agrees with it to within r bits in one segment at least.
So segments are probed with all values at radius 0, 1, 2, ... until the kth verified
distance of a query is within what its radius provably covers; only queries that are not
yet settled go on to the next radius.
"""

from __future__ import annotations

from math import log2

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..sources.tables import materialized

BITS = 128
SEED = 20240


def binary_codes(df: DataFrame, key: str, vector: str, seed: int = SEED) -> DataFrame:
    """(id, hi, lo): on which side of 128 fixed random planes each vector lies.

    Rows without id or vector, and empty vectors, have no code and are left out; missing
    and NaN coordinates count as 0. Vectors of different lengths use the first rows of
    the same planes.
    """
    def run(batches):
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            ids, vectors = batch.column(0), batch.column(1)
            lengths = np.diff(vectors.offsets.to_numpy())
            values = np.nan_to_num(vectors.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False), nan=0.0)
            starts = np.cumsum(lengths) - lengths
            for n in np.unique(lengths[lengths > 0]).tolist():
                rows = np.flatnonzero(lengths == n)
                if n not in planes:
                    planes[n] = np.random.default_rng(seed).standard_normal((n, BITS))
                sides = values[starts[rows][:, None] + np.arange(n)] @ planes[n] > 0
                halves = np.packbits(sides, axis=1, bitorder="little").view("<i8")
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(rows)), pa.array(halves[:, 0].copy()), pa.array(halves[:, 1].copy())], ["id", "hi", "lo"])

    chosen = df.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{vector}`").cast("array<float>").alias("vector"))
    return chosen.filter("id IS NOT NULL AND vector IS NOT NULL").mapInArrow(run, "id long, hi long, lo long")


def _distance(a: str, b: str) -> Column:
    return sum((F.bit_count(F.col(f"{a}{h}").bitwiseXOR(F.col(f"{b}{h}"))) for h in ("hi", "lo")), F.lit(0)).cast("int")


def segments(codes: int) -> list[tuple[str, int, int]]:
    """(half, first bit, width) of each segment, for so many different codes."""
    per_half = min(32, max(1, round(BITS / 2 / max(1.0, log2(max(codes, 2))))))
    cuts = [64 * i // per_half for i in range(per_half + 1)]
    return [(half, a, b - a) for half in ("hi", "lo") for a, b in zip(cuts, cuts[1:])]


def _values(cut: list[tuple[str, int, int]], prefix: str = "") -> Column:
    """(seg, width, value) of every segment of a code, as an array."""
    return F.array(*[
        F.struct(F.lit(i).alias("seg"), F.lit(width).alias("width"),
                 F.shiftrightunsigned(F.col(prefix + half), first).bitwiseAND(F.lit((1 << width) - 1 if width < 64 else -1)).alias("value"))
        for i, (half, first, width) in enumerate(cut)
    ])


def _flipped(segments: DataFrame, radius: int) -> DataFrame:
    """Each row (value, width) with ``value`` changed in ``radius`` of its bits, in every way.

    One bit after the other, from the lowest on, so the ways are made row by row on the
    executors.
    """
    out = segments.withColumn("bit", F.lit(-1))
    for _ in range(radius):
        higher = F.when(F.col("bit") + 1 < F.col("width"), F.sequence(F.col("bit") + 1, F.col("width") - 1))
        out = out.withColumn("bit", F.explode(higher)).withColumn("value", F.expr("value ^ shiftleft(1L, bit)"))
    return out.drop("bit")


def nearest(codes: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(id, neighbor_id, distance, rank): the ``k`` nearest other ids of every query id.

    ``codes`` and ``queries`` have (id, hi, lo); the order is (distance, neighbor_id), an
    id is no neighbour of itself, and repeated rows count once. Where fewer than ``k``
    other ids exist, all are returned.

    Equal codes are searched once: a code keeps its least ``k + 1`` ids, found by a window
    that limits groups before its exchange, so a code that a third of all rows share is
    neither probed nor verified more often than another.
    """
    codes = materialized(codes.select("id", "hi", "lo").distinct(), "codes")
    by_code = Window.partitionBy("hi", "lo")
    ids = materialized(codes.withColumn("place", F.row_number().over(by_code.orderBy("id"))).filter(F.col("place") <= k + 1), "ids")
    classes = materialized(ids.groupBy("hi", "lo").agg(F.min("id").alias("least"), F.count("*").alias("n")), "classes")
    total = classes.count()
    cut = segments(total)
    index = materialized(classes.select(F.explode(_values(cut)).alias("s"), "hi", "lo", "least", "n").select("s.seg", "s.value", "hi", "lo", "least", "n"), "index")
    asked = materialized(queries.select("id", F.col("hi").alias("qhi"), F.col("lo").alias("qlo")).distinct(), "queries")
    active = asked.select("qhi", "qlo").distinct().withColumn("bound", F.lit(BITS))
    best, radius, widest = None, 0, max(w for _, _, w in cut)
    per_query = Window.partitionBy("qhi", "qlo").orderBy("distance", "least")
    settled = None
    while total:
        probes = active.select("qhi", "qlo", "bound", F.explode(_values(cut, "q")).alias("s")).select("qhi", "qlo", "bound", "s.*")
        probes = _flipped(probes, radius).select("qhi", "qlo", "bound", "seg", "value")
        # probes grow with the radius, which Spark cannot foresee: never broadcast them; what is beyond the
        # kth distance so far is dropped where it is met
        met = probes.hint("merge").join(index, ["seg", "value"]).withColumn("distance", _distance("q", "")).filter(
            F.col("distance") <= F.col("bound")).select("qhi", "qlo", "hi", "lo", "least", "n", "distance").distinct()
        if best is not None:
            met = met.unionByName(best.join(active, ["qhi", "qlo"], "left_semi").select(met.columns)).distinct()
        best = materialized(met.withColumn("place", F.row_number().over(per_query)).filter(F.col("place") <= k + 1).drop("place"), "best")
        covered = len(cut) * (radius + 1) - 1
        upto = F.sum("n").over(per_query.rowsBetween(Window.unboundedPreceding, 0))
        reached = best.withColumn("upto", upto).filter(F.col("upto") >= k + 1).groupBy("qhi", "qlo").agg(F.min("distance").alias("kth"))
        radius += 1
        if radius > widest:
            settled = best if settled is None else settled.unionByName(best)
            break
        done = materialized(reached.filter(F.col("kth") <= covered).select("qhi", "qlo"), "settled")
        ready = best.join(done, ["qhi", "qlo"], "left_semi")
        settled = ready if settled is None else settled.unionByName(ready)
        active = active.select("qhi", "qlo").join(done, ["qhi", "qlo"], "left_anti").join(reached, ["qhi", "qlo"], "left")
        active = materialized(active.select("qhi", "qlo", F.coalesce("kth", F.lit(BITS)).alias("bound")), "active")
        if active.isEmpty():
            break
    if settled is None:
        return codes.select("id", F.col("id").alias("neighbor_id"), F.lit(0).alias("distance"), F.lit(0).alias("rank")).limit(0)
    listed = settled.select("qhi", "qlo", "hi", "lo", "distance").join(ids.select("hi", "lo", F.col("id").alias("neighbor_id")), ["hi", "lo"])
    first = Window.partitionBy("qhi", "qlo").orderBy("distance", "neighbor_id")
    answers = listed.withColumn("place", F.row_number().over(first)).filter(F.col("place") <= k + 1).drop("place", "hi", "lo")
    rank = F.row_number().over(Window.partitionBy("id", "qhi", "qlo").orderBy("distance", "neighbor_id"))
    return asked.join(answers, ["qhi", "qlo"]).filter("id <> neighbor_id").withColumn("rank", rank).filter(F.col("rank") <= k).select(
        "id", "neighbor_id", "distance", "rank")
