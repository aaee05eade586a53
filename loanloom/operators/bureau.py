"""Per-client features of external credits and their monthly balances.

Every feature is one aggregate expression, so any subset costs one shuffle by
client. Balance rows are reduced per credit before they meet their client.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.core import INF, col, ratio, zero_filled_sum

CLIENT, CREDIT = "sk_id_curr", "sk_id_bureau"
# Balance statuses.
NOT_OPEN = ("X", "C", "5")
CLOSED_STATUS = "C"
OVERDUE_STATUSES = ("1", "2", "3", "4", "5")
DAYS_PER_MONTH = 30


def category_values(df: DataFrame, column: str) -> list[str]:
    """Sorted distinct categories; each becomes a column of its own."""
    rows = df.select(column).filter(col(column).isNotNull()).distinct().collect()
    return sorted(r[0] for r in rows)


def _amount_features() -> dict[str, Column]:
    overdue, credit = F.col("amt_credit_sum_overdue"), F.col("amt_credit_sum")
    active = F.col("credit_active") == "Active"
    rate = ratio(
        zero_filled_sum(F.when(active, overdue)), zero_filled_sum(F.when(active, credit)), "inf"
    )
    rate = F.when(rate == INF, 0.0).otherwise(rate)
    return {
        "max_overdue_amt": F.max(overdue),
        "min_overdue_amt": F.when(F.max(overdue) > 0, F.min(F.when(overdue != 0, overdue))).otherwise(0.0),
        "actv_overdue_rate": F.when(F.max(F.when(active, 1)) == 1, rate),
    }


def _type_counts(types: list[str], prefix: str, where: Column | None) -> dict[str, Column]:
    out = {}
    for t in types:
        hit = F.col("credit_type") == t
        hit = hit if where is None else hit & where
        out[prefix + t] = F.count(F.when(hit, F.col(CREDIT)))
    return out


def _any_overdue() -> Column:
    return (F.col("amt_credit_max_overdue") > 0) | (F.col("amt_credit_sum_overdue") > 0)


def _nonzero(count: Column) -> Column:
    return F.when(count > 0, count)


def _balance_features() -> dict[str, Column]:
    rows = _nonzero(F.coalesce(F.sum("_rows"), F.lit(0)))
    closed = _nonzero(F.coalesce(F.sum("_closed"), F.lit(0)))
    opened = _nonzero(F.coalesce(F.sum("_open"), F.lit(0)))
    late = {s: F.coalesce(F.sum(f"_dpd_{s}"), F.lit(0)) for s in OVERDUE_STATUSES}
    active = F.col("credit_active") == "Active"
    return {
        "cnt_open_credits": opened,
        "cnt_closed_credits": closed,
        **{f"cnt_overdue_{s}_dpd": c for s, c in late.items()},
        "cnt_credits": rows,
        "rate_closed_credits": ratio(closed, rows),
        "rate_open_credits": ratio(opened, rows),
        **{f"rate_{s}_dpd": ratio(c, rows) for s, c in late.items()},
        "diff_last_closed_credit": F.max("_last_closed") * DAYS_PER_MONTH,
        "days_since_last_actv_credit": F.max("days_credit"),
        "months_since_last_actv_credit": F.max(F.when(active, F.col("_first_month"))),
    }


def _per_credit(balance: DataFrame) -> DataFrame:
    status, month = F.col("status"), F.col("months_balance")
    closed = status == CLOSED_STATUS
    return balance.filter(F.col(CREDIT).isNotNull()).groupBy(CREDIT).agg(
        F.count(F.lit(1)).alias("_rows"),
        F.count(F.when(~status.isin(*NOT_OPEN), status)).alias("_open"),
        F.count(F.when(closed, 1)).alias("_closed"),
        *[F.count(F.when(status == s, 1)).alias(f"_dpd_{s}") for s in OVERDUE_STATUSES],
        F.max(F.when(closed, month)).alias("_last_closed"),
        F.min(month).alias("_first_month"),
    )


def credit_features(
    credits: DataFrame, balance: DataFrame | None = None, names: list[str] | None = None,
    types: list[str] | None = None,
) -> DataFrame:
    """One row per client with the features named, or with all of them.

    Names are those of the amounts, ``<type>``, ``cnt_overdue_<type>``,
    ``cnt_closed_<type>``, and with ``balance`` the monthly ones. Credit types
    are looked up when not given.
    """
    types = category_values(credits, "credit_type") if types is None else types
    features = {
        **_amount_features(),
        **_type_counts(types, "", None),
        **_type_counts(types, "cnt_overdue_", _any_overdue()),
        **_type_counts(types, "cnt_closed_", F.col("credit_active") == "Closed"),
    }
    source = credits.filter(F.col(CLIENT).isNotNull())
    if balance is not None:
        features.update(_balance_features())
        source = source.join(_per_credit(balance), CREDIT, "left")
    chosen = list(features) if names is None else names
    return source.groupBy(CLIENT).agg(*[features[n].alias(n) for n in chosen])


def type_count_features(credits: DataFrame, prefix: str = "", types: list[str] | None = None) -> DataFrame:
    """Credits per client and type: all, ``cnt_overdue_`` or ``cnt_closed_``."""
    types = category_values(credits, "credit_type") if types is None else types
    return credit_features(credits, None, [prefix + t for t in types], types)


# ---- shares and counts in plain relational form ------------------------------

def active_overdue_rates(credits: DataFrame) -> DataFrame:
    """Overdue share of active credits with a positive amount, largest first."""
    counted = credits.filter((F.col("credit_active") == "Active") & (F.col("amt_credit_sum") > 0))
    rate = ratio(F.sum("amt_credit_sum_overdue"), F.sum("amt_credit_sum"))
    return counted.groupBy(CLIENT).agg(rate.alias("actv_overdue_rate")).orderBy(F.desc("actv_overdue_rate"), CLIENT)


def closed_clean_count(credits: DataFrame) -> DataFrame:
    clean = (F.col("amt_credit_sum") > 0) & (F.col("amt_credit_sum_overdue") == 0)
    closed = credits.filter((F.col("credit_active") == "Closed") & clean)
    return closed.groupBy(CLIENT).agg(F.count(F.lit(1)).alias("cnt"))


def active_ratio(credits: DataFrame) -> DataFrame:
    """Share of a client's credits that are active, in one aggregate."""
    share = ratio(F.count(F.when(F.col("credit_active") == "Active", 1)), F.count(F.lit(1)))
    return credits.groupBy(CLIENT).agg(F.round(share, 2).alias("active_ratio"))
