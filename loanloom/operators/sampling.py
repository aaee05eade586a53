"""Splits, folds and resampling weights that depend only on ids and a seed."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.core import col, hash_word
from .lookup import attach_lookup, dealt

WORD = 1 << 32
BINS = 1 << 18


def _poisson_cdf() -> tuple[float, ...]:
    """Cumulative Poisson(1) probabilities, as far as they differ in 32 bits."""
    term = total = math.exp(-1)
    out = [total]
    while True:
        term /= len(out)
        total += term
        if int(total * WORD) == int(out[-1] * WORD):
            return tuple(out)
        out.append(total)


POISSON_CDF = _poisson_cdf()  # the thresholds of a weight
# Fixed value: multiplier of the 32-bit integer mixer.
MIXER = 0x45D9F3B


def random_split(df: DataFrame, id_col: str, test_size: float = 0.3, seed: int = 42) -> DataFrame:
    """Add ``split``: a row is in ``test`` when its id hashes below the share."""
    cut = int(round(test_size * WORD))
    part = F.when(hash_word(id_col, seed) < cut, F.lit("test")).otherwise(F.lit("train"))
    return df.withColumn("split", part)


def _cut_points(df: DataFrame, id_col: str, label: str, shares: list[float], seed) -> DataFrame:
    """Per label and share: the last (hash, id) pair that still falls below the share.

    Hashes are counted in bins first, so only the one bin in which a cut falls
    is ever ranked and the full table is never sorted or shuffled.
    """
    hashed = df.filter(col(label).isNotNull()).select(
        col(label).alias("_label"), col(id_col).alias("_id"), hash_word(id_col, seed).alias("_hash")
    ).withColumn("_bin", F.floor(F.col("_hash") / (WORD // BINS)))
    label_bins = Window.partitionBy("_label")
    bins = hashed.groupBy("_label", "_bin").agg(F.count(F.lit(1)).alias("_n")).select(
        "_label", "_bin", "_n",
        F.sum("_n").over(label_bins.orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)).alias("_upto"),
        F.sum("_n").over(label_bins).alias("_all"),
    )
    wanted = F.explode(F.array(*[
        F.struct(F.lit(i).alias("cut"), F.floor(F.col("_all") * F.lit(float(s))).alias("rank"))
        for i, s in enumerate(shares)
    ]))
    cut_bins = (
        bins.withColumn("_want", wanted)
        .select("_label", "_bin", F.col("_want.cut").alias("_cut"),
                (F.col("_want.rank") - (F.col("_upto") - F.col("_n"))).alias("_rank"), "_n")
        .filter((F.col("_rank") >= 1) & (F.col("_rank") <= F.col("_n")))
        .drop("_n")
    )
    inside = attach_lookup(hashed, cut_bins, ["_label", "_bin"], "inner")
    # rows of one id count together, so a frequent id stays one row here
    ids = inside.groupBy("_label", "_cut", "_rank", "_hash", "_id").agg(F.count(F.lit(1)).alias("_m"))
    order = Window.partitionBy("_label", "_cut").orderBy("_hash", "_id").rowsBetween(Window.unboundedPreceding, 0)
    return (
        ids.withColumn("_last", F.sum("_m").over(order))
        .filter((F.col("_last") >= F.col("_rank")) & (F.col("_last") - F.col("_m") < F.col("_rank")))
        .groupBy("_label")
        .pivot("_cut", list(range(len(shares))))
        .agg(F.first(F.struct("_hash", "_id")))
        .select("_label", *[F.col(str(i)).alias(f"_cut{i}") for i in range(len(shares))])
    )


def _share_index(df: DataFrame, id_col: str, label: str, shares: list[float], seed) -> DataFrame:
    """Add ``_index``: how many of the cumulative shares a row lies beyond, within its label."""
    cuts = _cut_points(df, id_col, label, shares, seed).withColumnRenamed("_label", label)
    marked = attach_lookup(df, cuts, [label])
    here = F.struct(hash_word(id_col, seed).alias("_hash"), col(id_col).alias("_id"))
    index: Column = F.lit(0)
    for i in range(len(shares)):
        index = index + F.when(here <= F.col(f"_cut{i}"), 0).otherwise(1)
    index = F.when(col(label).isNotNull(), index)
    return marked.select(*df.columns, index.cast("int").alias("_index"))


def stratified_split(
    df: DataFrame, id_col: str, label: str, ratios: dict[str, float], seed: int = 123
) -> DataFrame:
    """Add ``split`` with exactly ``floor(share * n)`` rows of every label up to each cut.

    Rows without a label get no split.
    """
    names, shares, total = list(ratios), [], 0.0
    for name in names[:-1]:
        total += ratios[name]
        shares.append(round(total, 12))
    indexed = _share_index(df, id_col, label, shares, seed)
    split = F.when(F.col("_index") == 0, names[0])
    for i, name in enumerate(names[1:], 1):
        split = split.when(F.col("_index") == i, name)
    return indexed.withColumn("split", split).drop("_index")


def stratified_sample(df: DataFrame, id_col: str, label: str, share: float, seed: int = 123) -> DataFrame:
    """An exact share of the rows of every label."""
    marked = stratified_split(df, id_col, label, {"in": share, "out": 1 - share}, seed)
    return marked.filter(F.col("split") == "in").drop("split")


def stratified_folds(df: DataFrame, id_col: str, label: str, k: int = 5, seed: int = 123) -> DataFrame:
    """Add ``fold`` 0..k-1; per label the fold sizes differ by at most one."""
    indexed = _share_index(df, id_col, label, [i / k for i in range(1, k)], seed)
    return indexed.withColumnRenamed("_index", "fold")


def _mix(x: np.ndarray) -> np.ndarray:
    """Mixes 32-bit words; products wrap."""
    for _ in range(2):
        x = ((x >> np.uint32(16)) ^ x) * np.uint32(MIXER)
    return (x >> np.uint32(16)) ^ x


def poisson_weights(first: np.ndarray, second: np.ndarray, iterations: np.ndarray) -> np.ndarray:
    """Poisson(1) weights, one row per iteration and one column per table row."""
    first, second, iterations = (x.astype(np.uint32) for x in (first, second, iterations))
    u = _mix(first[None, :] ^ _mix(second[None, :] + iterations[:, None]))
    weights = np.zeros(u.shape, np.uint8)
    for p in POISSON_CDF:
        weights += u >= int(p * WORD)
    return weights.astype(np.float64)


def with_poisson_weight(
    df: DataFrame, id_col: str, seed: int, iteration: int = 0, name: str = "weight"
) -> DataFrame:
    """Add the same weight as a column, for a single resample.

    The mixing goes step by step through one helper column, because each step
    reads its input twice.
    """
    x = F.col("_mixed")
    folded = F.shiftright(x, 16).bitwiseXOR(x)
    steps = [folded * F.lit(MIXER) % F.lit(WORD)] * 2 + [folded]
    out = df.withColumn("_mixed", (hash_word(id_col, seed, 1) + iteration) % WORD)
    for step in [*steps, hash_word(id_col, seed, 0).bitwiseXOR(x), *steps]:
        out = out.withColumn("_mixed", step)
    weight = F.lit(0)
    for p in POISSON_CDF:
        weight = weight + (x >= int(p * WORD)).cast("int")
    # never null, so no null check on it is copied below the steps above
    return out.withColumn(name, F.coalesce(weight, F.lit(0))).drop("_mixed")


def resample(df: DataFrame, id_col: str, by: str | None = None, seed: int = 123) -> DataFrame:
    """Rows drawn with replacement: each is repeated by its Poisson(1) weight.

    ``by`` only requires the group key to be present; weights are independent
    per row, so every group keeps its size in expectation.
    """
    source = df if by is None else df.filter(col(by).isNotNull())
    weighted = with_poisson_weight(source, id_col, seed, name="_weight")
    copies = F.explode(F.array(*[F.lit(i) for i in range(1, len(POISSON_CDF) + 1)])).alias("copy")
    return weighted.select("*", copies).filter(F.col("copy") <= F.col("_weight")).drop("_weight")


def bootstrap_sums(
    df: DataFrame, id_col: str, group: str, columns: list[str], iterations: int, seed: int | list[int] = 123
) -> DataFrame:
    """``(grp, feature, iter, sw, swx)``: weighted count and sum of every resample.

    Each task turns its rows into ``iterations`` weighted sums per group and
    feature, so what is shuffled does not grow with the table. All features
    share the weights of a row, unless each has a seed of its own. Rows stay in the task
    that read them; only tables too small for a task per core are dealt out first, in
    turn, so no id gathers in one place.
    """
    seeds = [seed] * len(columns) if isinstance(seed, int) else list(seed)
    kinds = {s: [j for j, t in enumerate(seeds) if t == s] for s in dict.fromkeys(seeds)}
    source = dealt(df.filter(col(group).isNotNull()).select(
        col(group).cast("string").alias("_grp"),
        *[hash_word(id_col, s, word).alias(f"_{word}_{s}") for s in kinds for word in (0, 1)],
        *[col(c).cast("double").alias(c) for c in columns],
    ))
    block = 50
    held_cells = 10_000_000

    def partial(batches):
        sums: dict[str, np.ndarray] = {}

        def rows(held):
            step = max(1, 100_000 // max(iterations, 1))  # features in a frame
            for name, acc in held.items():
                for at in range(0, len(columns), step):
                    features = np.array(columns[at:at + step], object)
                    yield pd.DataFrame({
                        "grp": name, "feature": np.repeat(features, iterations), "iter": np.tile(np.arange(iterations), len(features)),
                        "sw": acc[:, at:at + step, 0].T.ravel(), "swx": acc[:, at:at + step, 1].T.ravel(),
                    })

        for pdf in batches:
            for start in range(0, len(pdf), 20_000):
                part = pdf.iloc[start:start + 20_000]
                for name, rows_of in part.groupby("_grp", sort=False):
                    whole = rows_of[columns].to_numpy(dtype=float)
                    acc = sums.setdefault(name, np.zeros((iterations, len(columns), 2)))
                    for s, places in kinds.items():
                        x = whole[:, places]
                        holes = np.isnan(x)
                        some = np.flatnonzero(holes.any(axis=0))
                        known = (~holes[:, some]).astype(float)
                        ends = [(end, (x == end).astype(float)) for end in (np.inf, -np.inf) if (x == end).any()]
                        x = np.where(np.isfinite(x), x, 0.0)
                        a, b = (rows_of[f"_{word}_{s}"].to_numpy().astype(np.uint64) for word in (0, 1))
                        for lo in range(0, iterations, block):
                            its = np.arange(lo, min(lo + block, iterations), dtype=np.uint64)
                            w = poisson_weights(a, b, its)
                            counts = np.repeat(w.sum(axis=1)[:, None], len(places), axis=1)
                            counts[:, some] = w @ known  # whole columns share one count
                            acc[lo:lo + len(its), places, 0] += counts
                            acc[lo:lo + len(its), places, 1] += w @ x
                            # an infinite value counts only where it was drawn
                            for end, where in ends:
                                acc[lo:lo + len(its), places, 1] += np.where(w @ where > 0, end, 0.0)
                if len(sums) * iterations * len(columns) > held_cells:
                    yield from rows(sums)
                    sums = {}
        yield from rows(sums)

    schema = "grp string, feature string, iter int, sw double, swx double"
    return (
        source.mapInPandas(partial, schema)
        .groupBy("grp", "feature", "iter")
        .agg(F.sum("sw").alias("sw"), F.sum("swx").alias("swx"))
    )


def bootstrap_means(df, id_col, group, columns, iterations, seed=123) -> DataFrame:
    sums = bootstrap_sums(df, id_col, group, columns, iterations, seed)
    return sums.select("grp", "feature", "iter", F.try_divide("swx", "sw").alias("mean"))
