"""Credit decisions over application tables and the profit they add up to."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import scoring
from ..functions.core import col

INTEREST = 0.15  # fixed value: yearly rate earned on repaid loans


def credit_decision(df: DataFrame, proba: str = "proba", threshold: float = scoring.APPROVE_BELOW) -> DataFrame:
    """Add ``decision``, ``amount``, ``threshold`` and ``proba`` to every application."""
    score = scoring.scorecard_total()
    return df.select(
        *[c for c in df.columns if c != "proba"],
        scoring.decision(proba, threshold).alias("decision"),
        scoring.approved_amount(proba, score, threshold).alias("amount"),
        F.lit(threshold).alias("threshold"),
        col(proba).alias("proba"),
    )


def portfolio_pnl(decided: DataFrame, rate: float = INTEREST, counted: str = "amt_credit") -> DataFrame:
    """Profit table per decision and amount, with a ``total`` row summed from it."""
    groups = decided.groupBy("decision", "amount").agg(
        F.avg("proba").alias("proba"), F.count(col(counted)).alias("count")
    )
    n, p, amount = F.col("count"), F.col("proba"), F.col("amount")
    defaulters = n * p
    paid = n - defaulters
    loss, gross = defaulters * amount, paid * amount * rate
    rows = groups.select(
        "decision", amount.cast("int").alias("amount"), "proba", "count", defaulters.alias("defaulters"),
        paid.alias("paid"), loss.alias("loss"), gross.alias("gross"), (gross - loss).alias("profit"),
    )
    sums = ("count", "defaulters", "paid", "loss", "gross", "profit")
    total = rows.agg(*[F.sum(c).alias(c) for c in sums]).select(
        F.lit("total").alias("decision"), F.lit(None).cast("int").alias("amount"),
        F.try_divide("defaulters", "count").alias("proba"), *sums,
    )
    return rows.unionByName(total)
