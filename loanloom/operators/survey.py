"""Borrower survey: repair, daily and weekday counts, shares, histograms, box statistics."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.core import col
from .lookup import attach_lookup
from .ordered import exact_quantiles

# Age given to unknown ages, and the statuses whose missing
# income is filled.
UNKNOWN_AGE = 26
FILLED_STATUSES = ("Student", "Pensioner", "Working")
STATUSES = ("Businessman", "Pensioner", "Student", "Working")


def _with_median(df: DataFrame, key: str, value: str) -> DataFrame:
    medians = exact_quantiles(df.filter(col(key).isNotNull()), [key], [value], [0.5])
    return attach_lookup(df, medians.select(key, F.col(value)[0].alias("_median")), [key])


def group_median_impute(
    df: DataFrame, key: str = "status", value: str = "income", filled: tuple[str, ...] = FILLED_STATUSES
) -> DataFrame:
    """Negatives become their group's median, then missing values the new median of the listed groups."""
    first = _with_median(df, key, value)
    negative = (col(value) < 0) & col(key).isNotNull()
    repaired = first.withColumn(value, F.when(negative, F.col("_median")).otherwise(col(value))).drop("_median")
    second = _with_median(repaired, key, value)
    missing = col(value).isNull() & col(key).isin(*filled)
    return second.withColumn(value, F.when(missing, F.col("_median")).otherwise(col(value))).drop("_median")


def age_repair(age: str | Column = "age", value: int = UNKNOWN_AGE) -> Column:
    return F.when(col(age).isNull() | (col(age) == 0), value).otherwise(col(age)).cast("int")


def clean_survey(df: DataFrame) -> DataFrame:
    """The whole repair: known status, income filled, no unknown businessman, age, narrow types."""
    known = group_median_impute(df.filter(col("status").isNotNull()))
    kept = known.filter(~((col("status") == "Businessman") & col("income").isNull()))
    return kept.withColumn("age", age_repair().cast("smallint")).withColumn("income", col("income").cast("int"))


def daily_count_mean(df: DataFrame, date: str = "date", key: str = "status", value: str = "income") -> DataFrame:
    """Count and mean per day for every status and, with a missing status, for the whole day.

    The day's figures are summed from the per-status ones.
    """
    parts = df.filter(col(date).isNotNull()).groupBy(date, key).agg(
        F.count(col(value)).alias("n"), F.sum(col(value)).alias("_sum")
    )
    # every per-status row counts once for its status and once for the day
    rows = F.array(
        F.struct(col(key).alias(key), F.lit(False).alias("_day")),
        F.struct(F.lit(None).cast("string").alias(key), F.lit(True).alias("_day")),
    )
    both = parts.select(date, "n", "_sum", F.explode(rows).alias("_r")).select(date, "n", "_sum", "_r.*")
    sums = both.filter(F.col("_day") | col(key).isNotNull()).groupBy(date, key, "_day").agg(
        F.sum("n").alias("n"), F.sum("_sum").alias("_sum")
    )
    return sums.select(date, key, "n", F.try_divide("_sum", "n").alias("mean_value"))


def weekday_counts(df: DataFrame, date: str = "date", value: str = "income") -> DataFrame:
    """Known values per weekday, Monday = 0."""
    return df.groupBy(F.weekday(col(date)).alias("dow")).agg(F.count(col(value)).alias("cnt_daily"))


def weekday_status_pivot(
    df: DataFrame, date: str = "date", key: str = "status", value: str = "income", values: tuple[str, ...] = STATUSES
) -> DataFrame:
    counts = [F.count(F.when(col(key) == v, col(value))).alias(v) for v in values]
    return df.filter(col(key).isNotNull()).groupBy(F.weekday(col(date)).alias("dow")).agg(*counts)


def group_share(df: DataFrame, key: str = "status", value: str = "income") -> DataFrame:
    """Known values per group and their share of all groups."""
    grouped = df.filter(col(key).isNotNull())
    total = grouped.select(F.count(col(value)).cast("double")).scalar()
    counts = grouped.groupBy(key).agg(F.count(col(value)).alias("n"))
    return counts.select(key, "n", F.try_divide(F.col("n").cast("double"), total).alias("share"))


def auto_bins(n: int, low: float, high: float, iqr: float) -> int:
    """Number of equal-width bins by the narrower of the Sturges and Freedman-Diaconis rules."""
    if n == 0 or high == low:
        return 1
    width = (high - low) / (math.log2(n) + 1)
    fd = 2 * iqr / n ** (1 / 3)
    width = min(width, fd) if fd > 0 else width
    return max(1, math.ceil((high - low) / width))


def histogram(df: DataFrame, value: str, bins: int | str = 10, by: str | None = None) -> DataFrame:
    """``(by, bin, lower, upper, n)``: equal-width counts; each group spans its own range.

    ``bins="auto"`` chooses the number from the whole column.
    """
    keys = [by] if by else []
    known = df.filter(col(value).isNotNull())
    x = col(value).cast("double")
    if bins == "auto":
        q = exact_quantiles(known, [], [value], [0.25, 0.75]).first()[0] or [0.0, 0.0]
        r = known.agg(F.count(x), F.min(x), F.max(x)).first()
        bins = auto_bins(r[0], r[1] or 0.0, r[2] or 0.0, q[1] - q[0])
    if by:
        known = known.filter(col(by).isNotNull())
    ranges = known.groupBy(*keys).agg(F.min(x).alias("_lo"), F.max(x).alias("_hi"))
    if keys:
        placed = attach_lookup(known, ranges, keys)
        lo, hi = F.col("_lo"), F.col("_hi")
    else:
        r = ranges.first()
        placed, lo, hi = known, F.lit(r["_lo"]).cast("double"), F.lit(r["_hi"]).cast("double")
    # a column of one value spans half a unit to either side
    flat = lo == hi
    low, high = F.when(flat, lo - 0.5).otherwise(lo), F.when(flat, hi + 0.5).otherwise(hi)
    index = F.least(F.floor((x - low) * bins / (high - low)), F.lit(bins - 1)).cast("int")
    cells = placed.select(*keys, low.alias("_lo"), high.alias("_hi"), index.alias("bin"))
    counts = cells.groupBy(*keys, "_lo", "_hi", "bin").agg(F.count(F.lit(1)).alias("n"))
    step = (F.col("_hi") - F.col("_lo")) / bins
    return counts.select(
        *keys, "bin", (F.col("_lo") + step * F.col("bin")).alias("lower"),
        (F.col("_lo") + step * (F.col("bin") + 1)).alias("upper"), "n",
    )


def box_stats(df: DataFrame, value: str = "income", by: str = "status", whisker: float = 1.5) -> DataFrame:
    """Quartiles, whisker ends and the number of values beyond them, per group."""
    known = df.filter(col(value).isNotNull() & col(by).isNotNull()).select(by, col(value).cast("double").alias("_x"))
    quartiles = exact_quantiles(known, [by], ["_x"], [0.25, 0.5, 0.75])
    q1, q3 = F.col("_x")[0], F.col("_x")[2]
    limits = quartiles.select(
        by, q1.alias("q1"), F.col("_x")[1].alias("q2"), q3.alias("q3"),
        (q1 - whisker * (q3 - q1)).alias("_low"), (q3 + whisker * (q3 - q1)).alias("_high"),
    )
    placed = attach_lookup(known, limits, [by])
    inside = (F.col("_x") >= F.col("_low")) & (F.col("_x") <= F.col("_high"))
    return placed.groupBy(by, "q1", "q2", "q3").agg(
        F.min(F.when(inside, F.col("_x"))).alias("whisker_low"),
        F.max(F.when(inside, F.col("_x"))).alias("whisker_high"),
        F.count(F.when(~inside, 1)).alias("n_outliers"),
    )
