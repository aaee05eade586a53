"""Joining small derived tables, and keeping very large groups apart."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..functions.core import col
from ..sources.tables import materialized

LOOKUP_ROWS = 20_000  # largest table that may be broadcast
SPLIT_BYTES = 128 << 20  # read by a task
TASK_ROWS = 25_000  # a learner gives to another task
GROUP_ROWS = 500_000  # largest group that one task may sort or keep as value counts


def small_or_lazy(table: DataFrame, max_rows: int = LOOKUP_ROWS) -> tuple[DataFrame, bool]:
    """Compute ``table`` once if it has at most ``max_rows`` rows.

    At most ``max_rows + 1`` rows reach the driver. A larger table is returned
    as it was, with False.
    """
    rows = table.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        return table, False
    return table.sparkSession.createDataFrame(rows, table.schema), True


def attach_lookup(
    df: DataFrame, lookup: DataFrame, on: list[str], how: str = "left", max_rows: int = LOOKUP_ROWS
) -> DataFrame:
    """Join a derived table: broadcast when its size was checked, else an ordinary join."""
    lookup, small = small_or_lazy(lookup, max_rows)
    return df.join(F.broadcast(lookup) if small else lookup, on, how)


def null_safe_join(df: DataFrame, other: DataFrame, keys: list[str], how: str = "left", broadcast: bool = False) -> DataFrame:
    """Join on keys of which NULLs count as equal; the columns of ``df`` come first, keys once."""
    right = other.select(*[col(k).alias(f"_right_{k}") if k in keys else col(k) for k in other.columns])
    right = F.broadcast(right) if broadcast else right
    same = reduce(lambda a, b: a & b, [col(k).eqNullSafe(col(f"_right_{k}")) for k in keys])
    return df.join(right, same, how).drop(*[f"_right_{k}" for k in keys])


def dealt(df: DataFrame) -> DataFrame:
    """Deal the rows of a small frame out to all tasks in turn, for work that is heavy per row.

    A frame that is estimated to be read by a task per core already stays as it is.
    """
    spark = df.sparkSession
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(parts) if size < parts * SPLIT_BYTES else df


def spread(df: DataFrame, rows_per_task: int = TASK_ROWS) -> DataFrame:
    """A written table whose rows lie in too few files for its number of rows, written again in a file per core.

    Bytes say little about the work of a learner: a million rows may be one small file and then one task.
    Tables with less than ``rows_per_task`` rows per task stay as they are.
    """
    wanted = min(df.sparkSession.sparkContext.defaultParallelism, df.count() // rows_per_task)
    return materialized(df.repartition(wanted), "spread") if wanted > df.rdd.getNumPartitions() else df


def split_by_size(
    df: DataFrame, keys: list[str], limit: int = GROUP_ROWS
) -> tuple[DataFrame, DataFrame | None]:
    """Rows of groups with at most ``limit`` rows, and rows of larger groups (None if none).

    A NULL key is a group like any other.
    """
    large = df.groupBy(*keys).count().filter(F.col("count") > limit).select(*keys)
    rows, small = small_or_lazy(large)
    if small and rows.isEmpty():
        return df, None
    return null_safe_join(df, rows, keys, "left_anti", small), null_safe_join(df, rows, keys, "left_semi", small)
