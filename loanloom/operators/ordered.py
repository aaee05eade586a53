"""Exact ranks, running totals and quantiles that no single task has to hold.

Values are first reduced to counts per distinct value. Groups above the size
limit are then cut into slices at approximate quantiles: the cuts only decide
which rows are sorted together, so results do not depend on how good they are.
Slice totals give every slice its offset.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.core import col
from .lookup import GROUP_ROWS, null_safe_join, small_or_lazy, split_by_size

SLICE_ROWS = 500_000  # rows a slice should hold
SAMPLED_PER_SLICE = 256  # values per slice, on average, from which the cuts are taken
CUT_CELLS = 1 << 21  # most cut points that may be broadcast (16 MB)


def slice_count(rows: int) -> int:
    """Slices for a group of that many rows, a power of two."""
    wanted = max(2, rows // SLICE_ROWS + 1)
    return 1 << (wanted - 1).bit_length()


def slice_cuts(counted: DataFrame, df: DataFrame, keys: list[str], value: str, slices: int, rows: int, limit: int) -> DataFrame:
    """``slices - 1`` approximate quantiles of the distinct values of every group of more than ``limit`` rows.

    They are taken from a hash-chosen share of the distinct values, so what meets in one
    task per group grows with the number of slices and not with the rows. A large group
    of so few values that none was chosen stays one slice.
    """
    # one text literal instead of thousands of number literals in the plan
    shares = F.split(F.lit(",".join(str(i / slices) for i in range(1, slices))), ",").cast("array<double>")
    word = 1 << 30
    chosen = F.pmod(F.xxhash64(col(value).cast("double")), F.lit(word)) < max(1, min(word, word * SAMPLED_PER_SLICE * slices // max(rows, 1)))
    cuts = counted.filter(chosen).groupBy(*keys).agg(
        F.percentile_approx(col(value).cast("double"), shares, F.lit(2 * slices)).alias("_cuts"))
    large = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")).filter(F.col("_rows") > limit).select(*keys)
    return null_safe_join(cuts, large, keys, "left_semi")


def _with_slice(counted: DataFrame, keys: list[str], value: str, cuts: DataFrame, slices: int) -> DataFrame:
    """Add ``_slice``: how many cut points of its group lie below the value (binary search).

    Groups without cut points stay one slice.
    """
    cuts, small = small_or_lazy(cuts, CUT_CELLS // slices)
    out = null_safe_join(counted, cuts, keys, "left", small).withColumn("_slice", F.lit(0))
    half = slices // 2
    while half:
        below = F.get("_cuts", F.col("_slice") + (half - 1)) < col(value).cast("double")
        out = out.withColumn("_slice", F.when(below, F.col("_slice") + half).otherwise(F.col("_slice")))
        half //= 2
    return out.drop("_cuts")


def running_totals(
    counted: DataFrame, keys: list[str], value: str, sums: list[str], source: DataFrame | None = None, rows: int = 0,
    limit: int = GROUP_ROWS,
) -> DataFrame:
    """Add ``<s>_before`` (sum over smaller values) and ``<s>_all`` (sum over the group).

    ``counted`` has one row per (keys, value). Without ``source`` each group is
    sorted in one task, which callers allow only for groups of a checked size.
    With it, the uncounted rows and their number, groups of more than ``limit``
    rows are sorted in slices.
    """
    before_all = (Window.unboundedPreceding, -1)
    if source is None:
        group = Window.partitionBy(*keys)
        earlier = group.orderBy(value).rowsBetween(*before_all)
        return counted.select(
            "*",
            *[F.coalesce(F.sum(s).over(earlier), F.lit(0)).alias(f"{s}_before") for s in sums],
            *[F.sum(s).over(group).alias(f"{s}_all") for s in sums],
        )
    slices = slice_count(rows)
    sliced = _with_slice(counted, keys, value, slice_cuts(counted, source, keys, value, slices, rows, limit), slices)
    part = [*keys, "_slice"]
    group = Window.partitionBy(*keys)
    lower = group.orderBy("_slice").rowsBetween(*before_all)
    # at most one row per slice reach this window
    offsets = (
        sliced.groupBy(*part)
        .agg(*[F.sum(s).alias(f"_{s}") for s in sums])
        .select(
            *part,
            *[F.coalesce(F.sum(f"_{s}").over(lower), F.lit(0)).alias(f"_{s}_offset") for s in sums],
            *[F.sum(f"_{s}").over(group).alias(f"{s}_all") for s in sums],
        )
    )
    earlier = Window.partitionBy(*part).orderBy(value).rowsBetween(*before_all)
    local = sliced.select(
        "*", *[F.coalesce(F.sum(s).over(earlier), F.lit(0)).alias(f"_{s}_local") for s in sums]
    )
    return null_safe_join(local, offsets, part, "inner").select(
        *counted.columns,
        *[(F.col(f"_{s}_offset") + F.col(f"_{s}_local")).alias(f"{s}_before") for s in sums],
        *[f"{s}_all" for s in sums],
    )


def to_long(df: DataFrame, keys: list[str], columns: list[str], name: str, value: str) -> DataFrame:
    """One row per non-null cell of the listed numeric columns."""
    cells = df.select(*keys, *[col(c).cast("double").alias(c) for c in columns])
    return cells.unpivot(keys, columns, name, value).filter(F.col(value).isNotNull())


def _sliced_quantiles(df, keys, columns, probs, rows: int, limit: int) -> DataFrame:
    group = [*keys, "_column"]
    long = to_long(df, keys, columns, "_column", "_value")
    counted = long.groupBy(*group, "_value").agg(F.count(F.lit(1)).alias("n"))
    ranked = running_totals(counted, group, "_value", ["n"], long, rows, limit)

    def at(rank: Column) -> Column:
        hit = (F.col("n_before") <= rank) & (rank < F.col("n_before") + F.col("n"))
        return F.max(F.when(hit, F.col("_value")))

    picks, values = [], []
    for i, p in enumerate(probs):
        place = F.lit(float(p)) * (F.col("n_all") - 1)
        picks += [
            at(F.floor(place)).alias(f"_lo{i}"),
            at(F.ceil(place)).alias(f"_hi{i}"),
            F.max(place - F.floor(place)).alias(f"_w{i}"),
        ]
        values.append(F.expr(f"_lo{i} + (_hi{i} - _lo{i}) * _w{i}"))
    found = ranked.groupBy(*group).agg(*picks).select(*group, F.array(*values).alias("_q"))
    wide = [
        F.first(F.when(F.col("_column") == c, F.col("_q")), ignorenulls=True).alias(c)
        for c in columns
    ]
    # groups without a known value keep their row
    return null_safe_join(df.select(*keys).distinct(), found.groupBy(*keys).agg(*wide), keys)


def exact_quantiles(
    df: DataFrame, keys: list[str], columns: list[str], probs: list[float], limit: int = GROUP_ROWS
) -> DataFrame:
    """Linearly interpolated quantiles per group: one array column per input column.

    Groups within the limit use the built-in aggregate in one shuffle; larger
    ones are ranked slice by slice.
    """
    shares = F.array(*[F.lit(float(p)) for p in probs])
    builtin = [F.percentile(col(c).cast("double"), shares).alias(c) for c in columns]
    if not keys:
        rows = df.count()
        if rows <= limit:
            return df.agg(*builtin)
        one = df.withColumn("_one", F.lit(1))
        return _sliced_quantiles(one, ["_one"], columns, probs, rows, limit).drop("_one")
    small, large = split_by_size(df, keys, limit)
    out = small.groupBy(*keys).agg(*builtin)
    if large is not None:
        out = out.unionByName(_sliced_quantiles(large, keys, columns, probs, df.count(), limit))
    return out


def average_ranks(
    df: DataFrame, value: str, keys: list[str] = (), limit: int = GROUP_ROWS
) -> DataFrame:
    """Per distinct value: its row count and the rank its ties share on average."""
    group = list(keys) or ["_one"]
    source = df.filter(col(value).isNotNull()).withColumn("_one", F.lit(1))
    counted = source.groupBy(*group, value).agg(F.count(F.lit(1)).alias("n"))
    # the row count bounds the number of distinct values in any group
    rows = source.count()
    ranked = running_totals(counted, group, value, ["n"], source if rows > limit else None, rows, limit)
    rank = (F.col("n_before") + (F.col("n") + 1) / 2).alias("avg_rank")
    return ranked.select(*keys, value, "n", rank)
