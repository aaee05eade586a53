"""Queries over the scorecard, the decision and the profit table."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions import scoring
from ..operators import decisions
from ..plans.standin import Views
from .registry import query, rounded

_SCORES = {
    "score_age": "CASE WHEN age_years BETWEEN 26 AND 50 THEN 5 WHEN age_years BETWEEN 51 AND 65 THEN 3 ELSE 0 END",
    "score_employment": "CASE WHEN days_employed > 1825 THEN 5 WHEN days_employed > 1095 THEN 3 WHEN days_employed > 365 THEN 1 ELSE 0 END",
    "score_income": "CASE WHEN amt_income_total <= 75000 THEN 0 WHEN amt_income_total < 150000 THEN 1 WHEN amt_income_total < 225000 THEN 3 ELSE 5 END",
    "score_purpose": "CASE WHEN car_loan <> 1 AND mortgage <> 1 THEN 1 ELSE 5 END",
    "score_external": "CASE WHEN ext_source_2 <> 1 THEN 0 ELSE 5 END",
    "score_microloan": "CASE WHEN microloan <> 0 THEN 0 ELSE 5 END",
}


def _register(name: str, expression) -> None:
    @query(name, f"SELECT sk_id_curr, {_SCORES[name]} AS points FROM scored")
    def run(v: Views) -> DataFrame:
        return v.scored.select("sk_id_curr", expression().alias("points"))


for _name in _SCORES:
    _register(_name, getattr(scoring, _name))

_TOTAL = " + ".join(f"({s})" for s in _SCORES.values())
_AMOUNT = ("CASE WHEN proba_a <= 0.08 THEN 250000 WHEN score < 7 THEN 20000 WHEN score < 25 THEN 50000 "
           "WHEN score < 30 THEN 100000 ELSE 250000 END")
_SCORED = f"WITH s AS (SELECT *, {_TOTAL} AS score FROM scored)"
_DECIDED = _SCORED + f""", d AS (SELECT *, CASE WHEN proba_a < 0.25 THEN 'accepted' ELSE 'declined' END AS decision,
    CASE WHEN proba_a < 0.25 THEN {_AMOUNT} ELSE 0 END AS amount FROM s)"""


@query("scorecard_total", _SCORED + " SELECT sk_id_curr, score FROM s")
def scorecard_total(v: Views) -> DataFrame:
    return v.scored.select("sk_id_curr", scoring.scorecard_total().alias("score"))


@query("loan_amount", _SCORED + f" SELECT sk_id_curr, {_AMOUNT} AS amount FROM s")
def loan_amount(v: Views) -> DataFrame:
    return v.scored.select("sk_id_curr", scoring.loan_amount("proba_a", scoring.scorecard_total()).alias("amount"))


@query("credit_decision", _DECIDED + " SELECT sk_id_curr, decision, amount, 0.25::DOUBLE AS threshold, proba_a AS proba FROM d")
def credit_decision(v: Views) -> DataFrame:
    return decisions.credit_decision(v.scored, "proba_a").select("sk_id_curr", "decision", "amount", "threshold", "proba")


_PNL = _DECIDED + """, g AS (SELECT decision, amount, avg(proba_a) AS proba, count(amt_credit) AS cnt FROM d GROUP BY 1, 2),
    r AS (SELECT decision, amount, proba, cnt, cnt * proba AS bad, cnt - cnt * proba AS good FROM g)"""


@query("portfolio_pnl", _PNL + """
    SELECT decision, amount, round(proba, 6) AS proba, cnt AS count, round(bad, 4) AS defaulters, round(good, 4) AS paid,
      round(bad * amount, 2) AS loss, round(good * amount * 0.15::DOUBLE, 2) AS gross,
      round(good * amount * 0.15::DOUBLE - bad * amount, 2) AS profit FROM r
    UNION ALL SELECT 'total', NULL, round(sum(bad) / sum(cnt), 6), CAST(sum(cnt) AS BIGINT), round(sum(bad), 4), round(sum(good), 4),
      round(sum(bad * amount), 2), round(sum(good * amount * 0.15::DOUBLE), 2),
      round(sum(good * amount * 0.15::DOUBLE - bad * amount), 2) FROM r""")
def portfolio_pnl(v: Views) -> DataFrame:
    table = decisions.portfolio_pnl(decisions.credit_decision(v.scored, "proba_a"))
    return rounded(table, 2, proba=6, defaulters=4, paid=4)
