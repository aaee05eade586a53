"""Scorecard, loan amount and decision as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .core import col

# Fixed values of the scorecard and the loan grades.
AGE_BANDS = ((26, 50, 5), (51, 65, 3))  # from, to, points; other ages 0
EMPLOYMENT_STEPS = ((365, 0), (1095, 1), (1825, 3))  # up to days, points
EMPLOYMENT_TOP = 5
INCOME_STEPS = ((225_000, 5), (150_000, 3))  # at least, points
INCOME_LOW = (75_000, 1)  # above, points
PURPOSE_POINTS, OTHER_PURPOSE_POINTS = 5, 1
EXTERNAL_POINTS = 5
NO_MICROLOAN_POINTS = 5
LOAN_GRADES = ((30, 250_000), (25, 100_000), (7, 50_000))  # score at least, amount
SMALLEST_LOAN, LARGEST_LOAN = 20_000, 250_000
SAFE_PROBABILITY = 0.08
APPROVE_BELOW = 0.25
ACCEPTED, DECLINED = "accepted", "declined"


def _points(value: int) -> Column:
    return F.lit(value).cast("int")


def score_age(age: str | Column = "age_years") -> Column:
    (lo, mid, young), (_, hi, older) = AGE_BANDS
    return (
        F.when(col(age).between(lo, mid), _points(young))
        .when((col(age) > mid) & (col(age) <= hi), _points(older))
        .otherwise(_points(0))
    )


def score_employment(days: str | Column = "days_employed") -> Column:
    out = None
    for limit, points in EMPLOYMENT_STEPS:
        hit = col(days) <= limit
        out = F.when(hit, _points(points)) if out is None else out.when(hit, _points(points))
    return out.when(col(days).isNotNull(), _points(EMPLOYMENT_TOP)).otherwise(_points(0))


def score_income(income: str | Column = "amt_income_total") -> Column:
    (top, top_points), (mid, mid_points) = INCOME_STEPS
    return (
        F.when(col(income) >= top, _points(top_points))
        .when(col(income) >= mid, _points(mid_points))
        .when(col(income) > INCOME_LOW[0], _points(INCOME_LOW[1]))
        .otherwise(_points(0))
    )


def score_purpose(car: str | Column = "car_loan", home: str | Column = "mortgage") -> Column:
    wanted = (col(car) == 1) | (col(home) == 1)
    return F.when(wanted, _points(PURPOSE_POINTS)).otherwise(_points(OTHER_PURPOSE_POINTS))


def score_external(source: str | Column = "ext_source_2") -> Column:
    return F.when(col(source) == 1, _points(EXTERNAL_POINTS)).otherwise(_points(0))


def score_microloan(count: str | Column = "microloan") -> Column:
    return F.when(col(count) == 0, _points(NO_MICROLOAN_POINTS)).otherwise(_points(0))


def scorecard_total() -> Column:
    """Sum of the six scores on the columns' usual names (1 to 30)."""
    return (
        score_age() + score_employment() + score_income()
        + score_purpose() + score_external() + score_microloan()
    )


def loan_amount(proba: str | Column, score: str | Column) -> Column:
    out = F.when(col(proba) <= SAFE_PROBABILITY, _points(LARGEST_LOAN))
    for least, amount in LOAN_GRADES:
        out = out.when(col(score) >= least, _points(amount))
    return out.otherwise(_points(SMALLEST_LOAN))


def decision(proba: str | Column, threshold: float = APPROVE_BELOW) -> Column:
    return F.when(col(proba) < threshold, F.lit(ACCEPTED)).otherwise(F.lit(DECLINED))


def approved_amount(proba: str | Column, score: str | Column, threshold: float = APPROVE_BELOW) -> Column:
    return F.when(col(proba) < threshold, loan_amount(proba, score)).otherwise(_points(0))
