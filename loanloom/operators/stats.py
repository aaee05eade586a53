"""Feature tests against a binary target, for all features in one job."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import special
from ..functions.core import col, settled
from .lookup import GROUP_ROWS, small_or_lazy
from .ordered import average_ranks, exact_quantiles, running_totals, to_long
from .sampling import bootstrap_means

ALPHA = 0.05
# Anderson-Darling 1 % critical value, its size correction, and
# the smallest group that is tested.
AD_CRITICAL, AD_LINEAR, AD_SQUARE, AD_MIN_ROWS = 1.092, 4.0, 25.0, 42
# Fixed value: smallest difference of means that counts.
MIN_DIFFERENCE = 0.001


def _labelled(df: DataFrame, features: list[str], target: str) -> DataFrame:
    """Long form ``(feature, value, target)`` of labelled rows with known values."""
    source = df.filter(col(target).isNotNull()).withColumn("_t", col(target).cast("int"))
    long = to_long(source, ["_t"], features, "feature", "value")
    return long.select("feature", "value", F.col("_t").alias("target"))


def t_test(df: DataFrame, features: list[str], target: str = "target") -> DataFrame:
    """Pooled two-sample t per feature; ``significant`` is 1 where p < 0.05."""
    parts = []
    source = df.filter(col(target).isin(0, 1))
    for f in features:
        x = col(f).cast("double")
        for t in (0, 1):
            v = F.when(col(target).cast("int") == t, x)
            parts += [F.count(v).alias(f"{f}_n{t}"), F.avg(v).alias(f"{f}_m{t}"), F.var_samp(v).alias(f"{f}_v{t}")]
    stats = ("n0", "m0", "v0", "n1", "m1", "v1")
    rows = F.array(*[
        F.struct(F.lit(f).alias("feature"), *[F.col(f"`{f}_{s}`").cast("double").alias(s) for s in stats])
        for f in features
    ])
    one = source.agg(*parts).select(F.explode(rows).alias("r")).select("r.*")
    dof = F.col("n0") + F.col("n1") - 2
    pooled = F.try_divide((F.col("n0") - 1) * F.col("v0") + (F.col("n1") - 1) * F.col("v1"), dof)
    spread = F.sqrt(pooled * (F.try_divide(F.lit(1.0), "n0") + F.try_divide(F.lit(1.0), "n1")))
    t = F.try_divide(F.col("m0") - F.col("m1"), spread)
    out = one.select("feature", t.alias("t_stat"), dof.alias("dof"))
    return out.withColumn("p_value", special.student_p("t_stat", "dof")).withColumn(
        "significant", F.coalesce((F.col("p_value") < ALPHA).cast("int"), F.lit(0))
    )


def _ranked_counts(df: DataFrame, features: list[str], target: str = "target") -> DataFrame:
    """Per (feature, value) the rows of target 0 and 1 with running totals."""
    long = _labelled(df, features, target).filter(F.col("target").isin(0, 1))
    counted = long.groupBy("feature", "value").agg(
        F.count(F.when(F.col("target") == 0, 1)).alias("n0"),
        F.count(F.when(F.col("target") == 1, 1)).alias("n1"),
    ).withColumn("n", F.col("n0") + F.col("n1"))
    # the table's row count bounds the distinct values of every feature
    rows = df.count()
    return running_totals(counted, ["feature"], "value", ["n"], long if rows > GROUP_ROWS else None, rows, GROUP_ROWS)


def mann_whitney(df: DataFrame, features: list[str], target: str = "target") -> DataFrame:
    """Two-sided rank-sum test of target 0 against 1 with tie and continuity correction."""
    ranked = _ranked_counts(df, features, target)
    n = F.col("n").cast("double")
    rank = F.col("n_before") + (n + 1) / 2
    sums = ranked.groupBy("feature").agg(
        F.sum(F.col("n0") * rank).alias("rank_sum"),
        F.sum("n0").cast("double").alias("n0"),
        F.sum("n1").cast("double").alias("n1"),
        F.sum(n * n * n - n).alias("ties"),
    )
    a, b = F.col("n0"), F.col("n1")
    total, pairs = a + b, a * b
    u = F.col("rank_sum") - a * (a + 1) / 2
    tie_term = F.coalesce(F.try_divide(F.col("ties"), total * (total - 1)), F.lit(0.0))
    spread = F.sqrt(pairs / 12 * ((total + 1) - tie_term))
    z = F.try_divide(F.greatest(u, pairs - u) - pairs / 2 - 0.5, spread)
    out = sums.select("feature", u.alias("u_stat"), z.alias("z_stat"))
    p = F.least(
        F.when(F.col("z_stat") >= 0, special.normal_p("z_stat"))
        .otherwise(2 - special.normal_p("z_stat")), F.lit(1.0))
    return out.withColumn("p_value", p).withColumn(
        "significant", F.coalesce((F.col("p_value") < ALPHA).cast("int"), F.lit(0))
    )


def anderson_darling(
    df: DataFrame, features: list[str], target: str = "target", min_n: int = AD_MIN_ROWS
) -> DataFrame:
    """Normality per feature and target group.

    Groups below ``min_n`` rows are skipped: statistic and critical value are 0,
    so they count as normal, and ``skipped`` says so.
    """
    long = _labelled(df, features, target)
    group = ["feature", "target"]
    counted = long.groupBy(*group, "value").agg(F.count(F.lit(1)).alias("n"))
    moments = long.groupBy(*group).agg(
        F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"), F.count(F.lit(1)).alias("rows")
    )
    moments, small = small_or_lazy(moments)
    rows = df.count()
    totals = running_totals(counted, group, "value", ["n"], long if rows > GROUP_ROWS else None, rows, GROUP_ROWS)
    ranked = totals.join(F.broadcast(moments) if small else moments, group, "left")
    ranked = ranked.withColumn("_z", F.try_divide(F.col("value") - F.col("mean"), F.col("sd")))
    ranked = ranked.withColumn("_a", F.abs("_z")).withColumn("_q", F.col("_z") * F.col("_z"))
    most, least = (F.expr(text) for text in special.log_cdf_texts("_a", "_q"))
    right = F.col("_z") >= 0
    low = F.col("n_before").cast("double")
    high = low + F.col("n")
    size = F.col("n_all").cast("double")
    ranked = ranked.filter(F.col("sd") > 0).withColumn("_most", most).withColumn("_least", least)
    term = (high * high - low * low) * F.when(right, F.col("_most")).otherwise(F.col("_least")) + (
        (size - low) * (size - low) - (size - high) * (size - high)
    ) * F.when(right, F.col("_least")).otherwise(F.col("_most"))
    found = ranked.withColumn("_term", term).groupBy(*group).agg(F.sum("_term").alias("_sum"))
    size = F.col("rows").cast("double")
    critical = F.round(AD_CRITICAL / (1 + AD_LINEAR / size - AD_SQUARE / (size * size)), 3)
    skipped = F.col("rows") < min_n
    out = moments.join(found, group, "left").select(
        *group, "rows",
        F.when(skipped, 0.0).otherwise(-size - F.col("_sum") / size).alias("a2_stat"),
        F.when(skipped, 0.0).otherwise(critical).alias("critical"),
        skipped.alias("skipped"),
    )
    return out.withColumn("normal", F.coalesce(F.col("a2_stat") <= F.col("critical"), F.lit(False)))


def normal_features(df: DataFrame, features: list[str], target: str = "target") -> DataFrame:
    """``(feature, normal)``: normal in at least one target group."""
    return anderson_darling(df, features, target).groupBy("feature").agg(F.max("normal").alias("normal"))


def category_counts(df: DataFrame, features: list[str], target: str = "target") -> DataFrame:
    """Long contingency table ``(feature, category, n0, n1, n)`` of labelled rows."""
    source = df.filter(col(target).isNotNull()).select(
        col(target).cast("int").alias("_t"), *[col(f).cast("string").alias(f) for f in features]
    )
    long = source.unpivot(["_t"], features, "feature", "category").filter(F.col("category").isNotNull())
    return long.groupBy("feature", "category").agg(
        F.count(F.when(F.col("_t") == 0, 1)).alias("n0"),
        F.count(F.when(F.col("_t") == 1, 1)).alias("n1"),
        F.count(F.lit(1)).alias("n"),
    )


def group_cross_tab(df: DataFrame, feature: str, target: str = "target") -> DataFrame:
    """Counts per category and target with the category's size and default percentage."""
    counts = category_counts(df, [feature], target)
    return counts.select("category", "n0", "n1", "n", _percentage().alias("default_pct"))


def _percentage() -> Column:
    return F.round(F.round(F.try_divide(F.col("n1").cast("double"), F.col("n")), 4) * 100, 2)


def chi_squared(
    df: DataFrame, features: list[str], target: str = "target", table: str = "standard"
) -> DataFrame:
    """Contingency test per categorical feature.

    ``standard`` tests category by target. ``reference`` tests the table that
    also holds each category's size and default percentage as two more columns.
    """
    counts = category_counts(df, features, target).withColumn("pct", _percentage())
    cells = ["n0", "n1"] if table == "standard" else ["n0", "n1", "n", "pct"]
    row = reduce(Column.__add__, [F.col(c) for c in cells]).cast("double")
    sums = counts.withColumn("_row", row).groupBy("feature").agg(
        F.count(F.lit(1)).alias("categories"),
        F.sum("_row").alias("total"),
        *[F.sum(F.col(c).cast("double")).alias(f"_c_{c}") for c in cells],
        *[F.sum(F.try_divide(F.col(c).cast("double") * F.col(c), "_row")).alias(f"_s_{c}") for c in cells],
    )
    # sum over cells of (o - e)^2 / e  ==  total * (sum of o^2 / (row * column) - 1)
    shares = [F.coalesce(F.try_divide(f"_s_{c}", f"_c_{c}"), F.lit(0.0)) for c in cells]
    present = reduce(Column.__add__, [(F.col(f"_c_{c}") > 0).cast("int") for c in cells])
    stat = F.col("total") * (reduce(Column.__add__, shares) - 1)
    out = sums.select(
        "feature",
        F.abs(stat).alias("chi2_stat"),
        ((F.col("categories") - 1) * (present - 1)).cast("int").alias("dof"),
    )
    p = F.when(F.col("dof") > 0, special.chi2_p("chi2_stat", F.col("dof").cast("double"))).otherwise(1.0)
    return out.withColumn("p_value", p).withColumn("significant", (F.col("p_value") <= ALPHA).cast("int"))


def ci_verdict(lo: str | Column, hi: str | Column, least: float = MIN_DIFFERENCE) -> Column:
    """0 when the interval covers the smallest difference, or an end lies within it of zero."""
    lo, hi = col(lo), col(hi)
    covered = (lo <= least) & (hi >= least)
    near = F.least(F.abs(lo), F.abs(hi)) <= least
    return F.when(covered | near, 0).otherwise(1).cast("int")


def _difference(means: DataFrame, low_group: str, high_group: str, paired: str) -> DataFrame:
    """``(feature, diff)`` of the resampled means of two groups."""
    if paired == "sorted":
        # one row per resample: the iteration count bounds the window
        order = Window.partitionBy("feature", "grp").orderBy("mean", "iter")
        means = means.withColumn("iter", F.row_number().over(order))
    pick = {g: F.max(F.when(F.col("grp") == g, F.col("mean"))) for g in (low_group, high_group)}
    return means.groupBy("feature", "iter").agg((pick[high_group] - pick[low_group]).alias("diff"))


def bootstrap_diff(
    df: DataFrame, id_col: str, features: list[str], target: str = "target", iterations: int = 1000,
    alpha: float = ALPHA, seed: int = 123, paired: str = "sorted",
) -> DataFrame:
    """Interval of the difference of resampled means between target 1 and 0, with verdict.

    ``sorted`` subtracts the k-th smallest means of the two groups from each
    other; ``independent`` subtracts resample by resample.
    """
    source = df.withColumn("_grp", col(target).cast("int")).filter(F.col("_grp").isin(0, 1))
    means = bootstrap_means(source, id_col, "_grp", features, iterations, seed)
    diffs = _difference(means, "0", "1", paired)
    order = Window.partitionBy("feature").orderBy("diff")
    places = diffs.withColumn("_place", F.row_number().over(order) - 1)
    lo, hi = round(iterations * alpha / 2), min(round(iterations * (1 - alpha / 2)), iterations - 1)
    ends = places.groupBy("feature").agg(
        F.round(F.max(F.when(F.col("_place") == lo, F.col("diff"))), 3).alias("ci_low"),
        F.round(F.max(F.when(F.col("_place") == hi, F.col("diff"))), 3).alias("ci_high"),
    )
    return ends.withColumn("significant", F.coalesce(ci_verdict("ci_low", "ci_high"), F.lit(0)))


def bootstrap_ci_by_group(
    df: DataFrame, id_col: str, key: str, value: str, iterations: int = 10_000, level: float = 95.0, seed: int = 123
) -> DataFrame:
    """Percentile interval of the resampled mean per group."""
    means = bootstrap_means(df, id_col, key, [value], iterations, seed)
    tail = (100 - level) / 200
    return means.groupBy(F.col("grp").alias(key)).agg(
        F.percentile(settled("mean", 2), F.lit(tail)).alias("ci_low"),
        F.percentile(settled("mean", 2), F.lit(1 - tail)).alias("ci_high"),
        F.avg("mean").alias("boot_mean"),
    )


def bootstrap_model_gap(
    df: DataFrame, id_col: str, a: str, b: str, iterations: int = 10_000, alpha: float = ALPHA, seed: int = 123
) -> DataFrame:
    """Interval of the difference between two models' resampled mean scores.

    The two columns are resampled independently of each other, in one pass with two seeds.
    """
    source = df.select(col(id_col).alias("_id"), col(a).alias("_a"), col(b).alias("_b"), F.lit("all").alias("_grp"))
    means = bootstrap_means(source, "_id", "_grp", ["_a", "_b"], iterations, [seed, seed + 1])
    both = means.groupBy("iter").agg(*[F.max(F.when(F.col("feature") == c, F.col("mean"))).alias(c) for c in ("_a", "_b")])
    gap = both.withColumn("_gap", F.col("_a") - F.col("_b"))
    ends = gap.agg(
        F.avg("_a").alias("mean_a"), F.avg("_b").alias("mean_b"),
        F.percentile("_gap", F.lit(alpha / 2)).alias("ci_low"),
        F.percentile("_gap", F.lit(1 - alpha / 2)).alias("ci_high"),
    )
    return ends.withColumn("significant", ((F.col("ci_low") > 0) | (F.col("ci_high") < 0)).cast("int"))


def feature_vote(votes: DataFrame, rule: str = ">") -> DataFrame:
    """Combine ``(feature, vote)`` rows: share above (``>``), at least (``>=``) one half, or ``any``."""
    share = F.avg(F.col("vote").cast("double"))
    keep = {">": share > 0.5, ">=": share >= 0.5, "any": F.max("vote") == 1}[rule]
    return votes.groupBy("feature").agg(share.alias("share"), keep.cast("int").alias("keep"))


def find_outliers(
    df: DataFrame, columns: list[str], low: float = 0.25, high: float = 0.75, coef: float = 1.5,
    skip_null_columns: bool = True,
) -> DataFrame:
    """Limits per column and how many rows lie outside.

    A column with any missing value has no limits unless ``skip_null_columns``
    is off.
    """
    usable = list(columns)
    if skip_null_columns:
        # quantiles are the costly part, so only columns that can have limits reach them
        holes = df.agg(*[F.count(F.when(col(c).isNull(), 1)).alias(c) for c in columns]).first()
        usable = [c for c in columns if not holes[c]]
    limits = _limits(exact_quantiles(df, [], usable, [low, high]), usable, coef) if usable else {}
    counts = df.agg(*[
        F.count(F.when((col(c) < lo) | (col(c) > hi), 1)).alias(c) for c, (lo, hi) in limits.items()
    ]).first() if limits else {}
    rows = [
        (c, *(limits.get(c, (None, None))), int(counts[c]) if c in limits else 0) for c in columns
    ]
    return df.sparkSession.createDataFrame(
        rows, "column_name string, lower_limit double, upper_limit double, n_outliers long"
    )


def _limits(quantiles: DataFrame, columns: list[str], coef: float) -> dict[str, tuple[float, float]]:
    row = quantiles.first()
    limits = {}
    for c in columns:
        if row[c] is not None and row[c][0] is not None:
            lo, hi = row[c]
            limits[c] = (lo - coef * (hi - lo), hi + coef * (hi - lo))
    return limits


def drop_outliers(df: DataFrame, limits: DataFrame, mode: str = "drop") -> DataFrame:
    """Remove rows that any limit excludes, or (``null``) empty the limited table's numeric cells.

    ``limits`` is the one-row-per-column table of ``find_outliers``.
    """
    rows = limits.collect()  # one row per column of the schema
    bounds = {r["column_name"]: r for r in rows if r["lower_limit"] is not None}
    outside = reduce(
        Column.__or__,
        [F.coalesce((col(c) < r["lower_limit"]) | (col(c) > r["upper_limit"]), F.lit(False)) for c, r in bounds.items()],
        F.lit(False),
    )
    if mode == "drop":
        return df.filter(~outside)
    numeric = {r["column_name"] for r in rows}
    marked = df.withColumn("_outside", outside)
    return marked.select(*[
        F.when(~F.col("_outside"), col(c)).alias(c) if c in numeric else col(c) for c in df.columns
    ])


__all__ = [
    "t_test", "mann_whitney", "anderson_darling", "chi_squared", "bootstrap_diff", "ci_verdict",
    "bootstrap_ci_by_group", "bootstrap_model_gap", "feature_vote", "find_outliers", "drop_outliers",
    "average_ranks",
]
