"""Per-client features of the application table itself."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import client as fx
from ..functions.core import col
from .lookup import attach_lookup


def group_mean_gap(
    df: DataFrame, keys: list[str], column: str, where=None, name: str = "composite_metric"
) -> DataFrame:
    """Value minus the mean of its group, the mean taken over the rows that ``where`` keeps."""
    source = df if where is None else df.filter(where)
    for k in keys:
        source = source.filter(col(k).isNotNull())
    means = source.groupBy(*keys).agg(F.avg(col(column)).alias("_mean"))
    joined = attach_lookup(df, means, keys)
    return joined.withColumn(name, col(column) - F.col("_mean")).drop("_mean")


def with_client_features(
    df: DataFrame, weights: dict[str, float] = fx.SOURCE_WEIGHTS, building_nulls: int = 30
) -> DataFrame:
    """Add documents, building, ages, burdens, source score and income gap in one projection."""
    gap = group_mean_gap(df, ["code_gender", "name_education_type"], "amt_income_total", col("target").isNotNull())
    age = fx.id_change_age()
    return gap.select(
        *[col(c) for c in df.columns],
        fx.num_documents(df).alias("num_documents"),
        fx.building_info(df, n=building_nulls).alias("building_info"),
        fx.full_years("days_birth").alias("age_years"),
        age.alias("id_change_age"),
        fx.id_change_delay(age).alias("id_age_change_diff"),
        fx.late_id_change(age).alias("flag_late_id_change"),
        *[c.alias(n) for n, c in fx.client_ratios().items()],
        fx.source_presence_score(weights).alias("weighted_ext_scores"),
        "composite_metric",
    )


def client_features(df: DataFrame, key: str = "sk_id_curr", **options) -> DataFrame:
    """The added features alone, one row per client."""
    out = with_client_features(df, **options)
    return out.select(key, *[c for c in out.columns if c not in df.columns])
