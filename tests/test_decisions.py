"""Scorecard and loan amount: given cases and band edges."""

from itertools import product

import pytest
from pyspark.sql import functions as F

from loanloom.functions import scoring
from loanloom.operators import decisions


def points(spark, schema, rows, expression):
    """Expression value per row, in row order."""
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"i int, {schema}")
    return [r[0] for r in df.orderBy("i").select(expression).collect()]


CASES = [
    ("age_years int", scoring.score_age,
     {(15,): 0, (70,): 0, (35,): 5, (55,): 3, (25,): 0, (26,): 5, (50,): 5, (51,): 3, (65,): 3, (66,): 0, (None,): 0}),
    ("days_employed int", scoring.score_employment,
     {(150,): 0, (365,): 0, (366,): 1, (750,): 1, (1095,): 1, (1500,): 3, (1825,): 3, (1826,): 5}),
    ("amt_income_total double", scoring.score_income,
     {(10000.0,): 0, (50000.0,): 0, (75000.0,): 0, (75001.0,): 1, (100000.0,): 1, (150000.0,): 3, (200000.0,): 3,
      (225000.0,): 5, (300000.0,): 5}),
    ("car_loan int, mortgage int", scoring.score_purpose, {(1, 1): 5, (1, 0): 5, (0, 1): 5, (0, 0): 1}),
    ("ext_source_2 double", scoring.score_external, {(1.0,): 5, (0.0,): 0}),
    ("microloan int", scoring.score_microloan, {(0,): 5, (3,): 0}),
]


@pytest.mark.parametrize("schema, score, cases", CASES)
def test_single_scores(spark, schema, score, cases):
    assert points(spark, schema, list(cases), score()) == list(cases.values())


def test_loan_amount(spark):
    cases = {
        (0.07, 15): 250000, (0.11, 32): 250000, (0.13, 27): 100000, (0.10, 15): 50000, (0.085, 5): 20000,
        (0.08, 1): 250000, (0.2, 30): 250000, (0.2, 25): 100000, (0.2, 7): 50000,
    }
    got = points(spark, "p double, s int", list(cases), scoring.loan_amount("p", "s"))
    assert got == list(cases.values())


def test_total_is_the_sum_of_the_scores(spark):
    """All 384 combinations of points, each reached through inputs that earn them."""
    inputs = [
        {0: 20, 3: 60, 5: 30}, {0: 100, 1: 500, 3: 1500, 5: 3000}, {0: 1e4, 1: 1e5, 3: 2e5, 5: 3e5},
        {1: 0, 5: 1}, {0: 0.0, 5: 1.0}, {0: 2, 5: 0},
    ]
    combos = list(product(*[list(m) for m in inputs]))
    rows = [(a[x], b[y], c[z], d[u], 0, e[v], f[w]) for (x, y, z, u, v, w) in combos for a, b, c, d, e, f in [inputs]]
    schema = ("age_years int, days_employed int, amt_income_total double, car_loan int, mortgage int, "
              "ext_source_2 double, microloan int")
    assert len(rows) == 384
    assert points(spark, schema, rows, scoring.scorecard_total()) == [sum(c) for c in combos]


def test_decision_threshold_and_profit(spark):
    rows = [(1, 0.25, 1.0), (2, 0.2499, 1.0), (3, 0.05, None)]
    df = spark.createDataFrame(rows, "id int, p double, amt_credit double").select(
        "*", F.lit(30).alias("age_years"), F.lit(500).alias("days_employed"), F.lit(1e5).alias("amt_income_total"),
        F.lit(0).alias("car_loan"), F.lit(0).alias("mortgage"), F.lit(0.0).alias("ext_source_2"), F.lit(1).alias("microloan"))
    decided = decisions.credit_decision(df, "p").orderBy("id")
    got = [(r["decision"], r["amount"]) for r in decided.collect()]
    assert got == [("declined", 0), ("accepted", 50000), ("accepted", 250000)]
    table = {(r["decision"], r["amount"]): r for r in decisions.portfolio_pnl(decided).collect()}
    mid = table[("accepted", 50000)]
    assert mid["profit"] == pytest.approx((1 - 0.2499) * 50000 * 0.15 - 0.2499 * 50000)
    assert table[("accepted", 250000)]["count"] == 0  # a missing amount of credit is not counted
    assert table[("total", None)]["profit"] == pytest.approx(sum(r["profit"] for k, r in table.items() if k[0] != "total"))
