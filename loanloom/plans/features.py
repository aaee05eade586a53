"""From raw tables to one cleaned table per client."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions.client import SOURCE_WEIGHTS
from ..functions.core import col, column_kinds
from ..operators import applications, bureau, cards, clients, relational as rel, stats
from ..operators.cleaning import MISSING_NUMBER, MISSING_TEXT, fill_nulls, replace_infinite, snake_case_columns
from ..sources.tables import bucketed

# Largest income and largest numbers of children.
MAX_INCOME, MAX_CHILDREN, MAX_CHILDREN_BASELINE = 500_000, 15, 10


def history_features(bur: DataFrame, bur_bal: DataFrame, cc: DataFrame, prev: DataFrame, inst: DataFrame) -> list[DataFrame]:
    """Four feature sets of a client's history, one row per client each."""
    return [
        applications.payment_features(inst, fill=True),
        bureau.credit_features(bur, bur_bal),
        applications.previous_features(prev, fill=True),
        cards.card_features_by_client(cards.card_features(cc), prev),
    ]


def features_train_test(
    app: DataFrame, bur: DataFrame, bur_bal: DataFrame, cc: DataFrame, prev: DataFrame, inst: DataFrame,
    weights: dict[str, float] = SOURCE_WEIGHTS,
) -> DataFrame:
    """Every client with all features; the client's own are columns, not a join."""
    base = clients.with_client_features(app, weights)
    return rel.assemble_features(base, history_features(bur, bur_bal, cc, prev, inst), "sk_id_curr")


def assemble_bucketed(
    app: DataFrame, bur: DataFrame, bur_bal: DataFrame, cc: DataFrame, prev: DataFrame, inst: DataFrame, buckets: int,
    weights: dict[str, float] = SOURCE_WEIGHTS,
) -> DataFrame:
    """The same table from feature sets that are kept bucketed by client: their joins need no exchange."""
    sets = [clients.with_client_features(app, weights), *history_features(bur, bur_bal, cc, prev, inst)]
    base, *history = [bucketed(f, "sk_id_curr", buckets, "feature-set") for f in sets]
    return rel.assemble_features(base, history, "sk_id_curr")


def _half(df: DataFrame, numeric: list[str]) -> DataFrame:
    limits = stats.find_outliers(df, numeric, 0.05, 0.95)
    return stats.drop_outliers(df, limits, "null")


def clean_table(df: DataFrame, baseline: bool = False, fill_test: bool = True, fraud_filter: bool = True) -> DataFrame:
    """Outliers emptied per half, values capped, gaps filled, fraud removed, names in snake case.

    ``baseline`` fills with 0, allows fewer children, and skips the sign
    change, the fraud filter and the renaming. ``fill_test=False`` leaves the
    gaps of unlabelled rows.
    """
    numeric, _ = column_kinds(df, ("sk_id_curr", "target"))
    parts = []
    for labelled in (True, False):
        half = df.filter(col("target").isNotNull() if labelled else col("target").isNull())
        half = _half(half, numeric)
        if "name_type_suite" in half.columns:
            half = half.fillna(MISSING_TEXT, subset=["name_type_suite"])
        if not baseline:
            half = rel.flip_sign(half, [c for c in ("days_employed", "days_registration") if c in half.columns])
        children = MAX_CHILDREN_BASELINE if baseline else MAX_CHILDREN
        limits = {"amt_income_total": MAX_INCOME, "cnt_children": children}
        half = rel.cap_values(half, {c: v for c, v in limits.items() if c in half.columns})
        number = 0 if baseline else MISSING_NUMBER
        if labelled or fill_test:
            columns = [c for c in half.columns if c not in ("sk_id_curr", "target")]
            half = fill_nulls(half, number, None if baseline else MISSING_TEXT, columns)
        if "avg_pct_instalment_paid" in half.columns:
            half = replace_infinite(half, ["avg_pct_instalment_paid"], number)
        parts.append(half)
    data = rel.union_all(*parts)
    if baseline:
        return data
    data = rel.drop_fraud(data) if fraud_filter else data
    return snake_case_columns(data)
