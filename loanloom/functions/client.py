"""Row-wise client features: ages, document changes, burdens, source presence."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from .core import col, ratio

DAYS_PER_YEAR = 365.25
# Ages at which an identity document is issued or renewed.
DOCUMENT_AGES = (45, 20, 14)
# Recorded importances of the three external sources, and the
# multipliers of the value-weighted sum.
SOURCE_WEIGHTS = {"ext_source_1": 0.30, "ext_source_2": 0.25, "ext_source_3": 0.45}
SUM_WEIGHTS = {"ext_source_1": 0.5, "ext_source_2": 1.3, "ext_source_3": 0.7}
BUILDING_PATTERN = "_avg|_mode|_medi"
DOCUMENT_PREFIX = "flag_document_"


def full_years(days: str | Column) -> Column:
    return F.floor(col(days) / DAYS_PER_YEAR).cast("smallint")


def id_change_age(birth: str = "days_birth", publish: str = "days_id_publish") -> Column:
    return full_years(col(birth) + col(publish))


def id_change_delay(age: Column) -> Column:
    """Years since the document change that was due at that age."""
    late, mid, first = DOCUMENT_AGES
    return (
        F.when(age >= late, age - late).when(age >= mid, age - mid).otherwise(age - first).cast("int")
    )


def late_id_change(age: Column) -> Column:
    return F.when(id_change_delay(age) > 0, 1).otherwise(0).cast("int")


def client_ratios() -> dict[str, Column]:
    adults = col("cnt_fam_members") - col("cnt_children")
    children, income = col("cnt_children"), col("amt_income_total")
    return {
        "annuity_to_income_rate": ratio("amt_annuity", income, "inf"),
        "children_per_adult": ratio(children, adults, "inf"),
        "inc_per_child": F.when(children > 0, ratio(income, children)).when(children == 0, income),
        "inc_per_adult": ratio(income, adults, "inf"),
        "annuity_rate": F.round(ratio("amt_annuity", "amt_credit", "inf") * 100, 3),
    }


def source_presence_score(weights: dict[str, float] = SOURCE_WEIGHTS) -> Column:
    """Sum of the weights of the sources that are present; their values do not count."""
    total = F.lit(0.0)
    for name, weight in weights.items():
        total = total + F.when(col(name).isNotNull(), F.lit(float(weight))).otherwise(0.0)
    return total


def weighted_sum(weights: dict[str, float] = SUM_WEIGHTS) -> Column:
    total = None
    for name, weight in weights.items():
        term = col(name) * F.lit(float(weight))
        total = term if total is None else total + term
    return total


def num_documents(df: DataFrame, prefix: str = DOCUMENT_PREFIX) -> Column:
    """Documents handed in, plus the identity document itself."""
    total = F.lit(1)
    for name in df.columns:
        if prefix in name:
            total = total + F.coalesce(col(name).cast("int"), F.lit(0))
    return total.cast("int")


def building_info(df: DataFrame, pattern: str = BUILDING_PATTERN, n: int = 30) -> Column:
    """1 where fewer than ``n`` of the building columns are missing."""
    missing = F.lit(0)
    for name in df.columns:
        if re.search(pattern, name):
            missing = missing + col(name).isNull().cast("int")
    return (missing < n).cast("int")
