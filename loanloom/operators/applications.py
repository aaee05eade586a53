"""Per-client features of earlier applications and of instalment payments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.core import INF, ratio, settled
from .bureau import category_values

CLIENT = "sk_id_curr"
# Hours of the four parts of the day.
DAY_PARTS = {
    "early": (5, 6, 7, 8),
    "daytime": (9, 10, 11, 12, 13, 14, 15, 16, 17, 18),
    "afterwork": (19, 20, 21, 22),
    "late": (23, 0, 1, 2, 3, 4),
}


def _known(x: Column) -> Column:
    return F.when(~F.isnan(x), x)


def previous_expressions(types: list[str]) -> dict[str, Column]:
    approved = _known(F.avg(ratio("amt_credit", "amt_application", "inf")))
    hour = F.col("hour_appr_process_start")
    return {
        **{
            f"num_prev_{t.lower()}": F.count(F.when(F.col("name_contract_type") == t, F.col("sk_id_prev")))
            for t in types
        },
        "avg_pct_approved": F.when(approved == INF, 0.0).otherwise(settled(approved, 2)),
        "avg_inq_freq": -F.avg("days_decision").cast("int"),
        **{
            f"cnt_{part}_applications": F.count(F.when(hour.isin(*hours), F.col("sk_id_prev")))
            for part, hours in DAY_PARTS.items()
        },
    }


def previous_features(
    df: DataFrame, names: list[str] | None = None, types: list[str] | None = None, fill: bool = False
) -> DataFrame:
    """Features of earlier applications in one aggregate; ``fill`` turns missing ones to 0."""
    types = category_values(df, "name_contract_type") if types is None else types
    features = previous_expressions(types)
    chosen = list(features) if names is None else names
    out = df.filter(F.col(CLIENT).isNotNull()).groupBy(CLIENT).agg(*[features[n].alias(n) for n in chosen])
    return out.fillna(0) if fill else out


def payment_expressions() -> dict[str, Column]:
    # day numbers are negative before the application; their sign is turned first
    delay = -F.col("days_instalment") + F.col("days_entry_payment")
    paid = _known(F.avg(ratio("amt_payment", "amt_instalment", "inf")))
    return {
        "cnt_late_payments": F.count(F.when(delay > 0, F.col("sk_id_prev"))),
        "early_payments": F.count(F.when(delay < 0, F.col("sk_id_prev"))),
        "avg_pct_instalment_paid": settled(paid, 3),
    }


def payment_features(df: DataFrame, names: list[str] | None = None, fill: bool = False) -> DataFrame:
    """Late and early payments and the mean paid share, in one aggregate."""
    features = payment_expressions()
    chosen = list(features) if names is None else names
    out = df.filter(F.col(CLIENT).isNotNull()).groupBy(CLIENT).agg(*[features[n].alias(n) for n in chosen])
    return out.fillna(0) if fill else out
