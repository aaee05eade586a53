"""Queries over the client features and the survey."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import client as fx
from ..operators import applications, bureau, cards, clients, stats, survey
from ..plans.standin import Views
from .registry import query, rounded
from .sources import TYPES

# ---- credits -----------------------------------------------------------------


@query("max_overdue", "SELECT sk_id_curr, max(amt_credit_sum_overdue) AS max_overdue_amt FROM bur GROUP BY 1")
def max_overdue(v: Views) -> DataFrame:
    return bureau.credit_features(v.bur, None, ["max_overdue_amt"], TYPES)


@query("min_nonzero_overdue", """
    SELECT sk_id_curr, coalesce(min(amt_credit_sum_overdue) FILTER (WHERE amt_credit_sum_overdue > 0), 0) AS min_overdue_amt
    FROM bur GROUP BY 1""")
def min_nonzero_overdue(v: Views) -> DataFrame:
    return bureau.credit_features(v.bur, None, ["min_overdue_amt"], TYPES)


@query("active_overdue_rate", """
    SELECT sk_id_curr, CASE WHEN n = 0 OR (credit = 0 AND overdue = 0) THEN NULL WHEN credit = 0 THEN 0.0
      ELSE round(overdue / credit, 6) END AS actv_overdue_rate
    FROM (SELECT sk_id_curr, count(*) FILTER (WHERE credit_active = 'Active') AS n,
        coalesce(sum(amt_credit_sum) FILTER (WHERE credit_active = 'Active'), 0) AS credit,
        coalesce(sum(amt_credit_sum_overdue) FILTER (WHERE credit_active = 'Active'), 0) AS overdue
      FROM bur GROUP BY 1)""")
def active_overdue_rate(v: Views) -> DataFrame:
    return rounded(bureau.credit_features(v.bur, None, ["actv_overdue_rate"], TYPES), 6)


def _types_sql(prefix: str, where: str) -> str:
    cells = ", ".join(
        f"""count(*) FILTER (WHERE credit_type = '{t}'{where}) AS "{prefix}{t}\"""" for t in TYPES)
    return f"SELECT sk_id_curr, {cells} FROM bur GROUP BY 1"


_OVERDUE = " AND (amt_credit_max_overdue > 0 OR amt_credit_sum_overdue > 0)"


@query("count_by_type_pivot", _types_sql("", ""))
def count_by_type_pivot(v: Views) -> DataFrame:
    return bureau.type_count_features(v.bur, "")


@query("overdue_by_type_pivot", _types_sql("cnt_overdue_", _OVERDUE))
def overdue_by_type_pivot(v: Views) -> DataFrame:
    return bureau.type_count_features(v.bur, "cnt_overdue_")


@query("closed_by_type_pivot", _types_sql("cnt_closed_", " AND credit_active = 'Closed'"))
def closed_by_type_pivot(v: Views) -> DataFrame:
    return bureau.type_count_features(v.bur, "cnt_closed_")


_DPD = "12345"
# balance rows of every client that has a credit
_BALANCE = f"""
    WITH rows_of AS (
      SELECT b.sk_id_curr, b.sk_id_bureau, b.days_credit, b.credit_active, l.status, l.months_balance
      FROM bur b LEFT JOIN bur_bal l ON l.sk_id_bureau = b.sk_id_bureau),
    m AS (
      SELECT sk_id_curr,
        nullif(count(*) FILTER (WHERE status IN ('0', '1', '2', '3', '4')), 0) AS cnt_open_credits,
        nullif(count(*) FILTER (WHERE status = 'C'), 0) AS cnt_closed_credits,
        {', '.join(f"count(*) FILTER (WHERE status = '{d}') AS cnt_overdue_{d}_dpd" for d in _DPD)},
        nullif(count(months_balance), 0) AS cnt_credits,
        30 * max(months_balance) FILTER (WHERE status = 'C') AS diff_last_closed_credit
      FROM rows_of GROUP BY 1)
"""


def _balance(v: Views, names: list[str]) -> DataFrame:
    return bureau.credit_features(v.bur, v.bur_bal, names, TYPES)


@query("open_month_count", _BALANCE + "SELECT sk_id_curr, cnt_open_credits FROM m")
def open_month_count(v: Views) -> DataFrame:
    return _balance(v, ["cnt_open_credits"])


@query("closed_month_count", _BALANCE + "SELECT sk_id_curr, cnt_closed_credits FROM m")
def closed_month_count(v: Views) -> DataFrame:
    return _balance(v, ["cnt_closed_credits"])


@query("dpd_pivot", _BALANCE + f"SELECT sk_id_curr, {', '.join(f'cnt_overdue_{d}_dpd' for d in _DPD)} FROM m")
def dpd_pivot(v: Views) -> DataFrame:
    return _balance(v, [f"cnt_overdue_{d}_dpd" for d in _DPD])


@query("balance_row_count", _BALANCE + "SELECT sk_id_curr, cnt_credits FROM m")
def balance_row_count(v: Views) -> DataFrame:
    return _balance(v, ["cnt_credits"])


@query("status_rates", _BALANCE + "SELECT sk_id_curr, " + ", ".join(
    f"round({c} / CAST(cnt_credits AS DOUBLE), 6) AS {n}" for n, c in [
        ("rate_closed_credits", "cnt_closed_credits"), ("rate_open_credits", "cnt_open_credits"),
        *[(f"rate_{d}_dpd", f"cnt_overdue_{d}_dpd") for d in _DPD]]) + " FROM m")
def status_rates(v: Views) -> DataFrame:
    names = ["rate_closed_credits", "rate_open_credits", *[f"rate_{d}_dpd" for d in _DPD]]
    return rounded(_balance(v, names), 6)


@query("last_closed_days", _BALANCE + "SELECT sk_id_curr, diff_last_closed_credit FROM m")
def last_closed_days(v: Views) -> DataFrame:
    return _balance(v, ["diff_last_closed_credit"])


@query("last_active_age", _BALANCE + """, c AS (
      SELECT sk_id_curr, sk_id_bureau, max(days_credit) AS days_credit,
        min(months_balance) FILTER (WHERE credit_active = 'Active') AS first_month FROM rows_of GROUP BY 1, 2)
    SELECT sk_id_curr, max(days_credit) AS days_since_last_actv_credit, max(first_month) AS months_since_last_actv_credit
    FROM c GROUP BY 1""")
def last_active_age(v: Views) -> DataFrame:
    return _balance(v, ["days_since_last_actv_credit", "months_since_last_actv_credit"])


# ---- cards -------------------------------------------------------------------

CARD_COLUMNS = ["amt_balance", "amt_drawings", "cnt_drawings"]


def _stat_sql(stat: str, c: str, where: str) -> str:
    f = f" FILTER (WHERE {where})"
    if stat == "sum":
        total = f"coalesce(sum({c}){f}, 0)"
        return f"CASE WHEN count(*){f} > 0 THEN {total} END"
    name = {"mean": "avg", "std": "stddev_samp"}.get(stat, stat)
    return f"{name}({c}){f}"


def _profile_sql(where: str, tail: str) -> str:
    return ", ".join(
        f"CAST({_stat_sql(s, c, where)} AS DOUBLE) AS {c}_{s}{tail}" for c in CARD_COLUMNS for s in cards.STATS)


@query("six_stat_profile", "SELECT sk_id_prev, " + ", ".join(
    f"round({c}_{s}, 4) AS {c}_{s}" for c in CARD_COLUMNS for s in cards.STATS)
    + f" FROM (SELECT sk_id_prev, {_profile_sql('TRUE', '')} FROM cc GROUP BY 1)")
def six_stat_profile(v: Views) -> DataFrame:
    out = cards.six_stat_profile(v.cc, "sk_id_prev", CARD_COLUMNS)
    return rounded(out.select("sk_id_prev", *[F.col(c).cast("double").alias(c) for c in out.columns[1:]]))


def _ratio_sql(n: str, d: str, digits: int | None = 4) -> str:
    inf = "CAST('Infinity' AS DOUBLE)"
    plain = f"{n} / {d}" if digits is None else f"round({n} / {d}, {digits})"
    return f"CASE WHEN {d} IS NULL THEN NULL WHEN {d} <> 0 THEN {plain} WHEN {n} > 0 THEN {inf} WHEN {n} < 0 THEN -{inf} END"


@query("period_ratio_profile", "SELECT sk_id_prev, " + ", ".join(
    f'{_ratio_sql(f"{c}_{s}", f"{c}_{s}_{n}")} AS "part_all_{c}_{s}_to_{n}M"'
    for n in cards.PERIODS for c in CARD_COLUMNS for s in cards.STATS)
    + " FROM (SELECT sk_id_prev, " + ", ".join(
        [_profile_sql("TRUE", "")] + [_profile_sql(f"months_balance BETWEEN -{n} AND -1", f"_{n}") for n in cards.PERIODS])
    + " FROM cc GROUP BY 1)")
def period_ratio_profile(v: Views) -> DataFrame:
    return rounded(cards.period_ratio_profile(v.cc, "sk_id_prev", CARD_COLUMNS))


# ---- earlier applications and instalments ------------------------------------

LOAN_TYPES = ["Cash loans", "Consumer loans", "Revolving loans"]


@query("prev_by_contract_pivot", "SELECT sk_id_curr, " + ", ".join(
    f"""count(*) FILTER (WHERE name_contract_type = '{t}') AS "num_prev_{t.lower()}\"""" for t in LOAN_TYPES)
    + " FROM prev GROUP BY 1")
def prev_by_contract_pivot(v: Views) -> DataFrame:
    types = bureau.category_values(v.prev, "name_contract_type")
    return applications.previous_features(v.prev, [f"num_prev_{t.lower()}" for t in types], types)


@query("avg_pct_approved", """
    SELECT sk_id_curr, CASE WHEN count(*) FILTER (WHERE amt_application = 0 AND amt_credit > 0) > 0 THEN 0.0
      ELSE CAST(round(CAST(avg(CASE WHEN amt_application <> 0 THEN amt_credit / amt_application END) AS DECIMAL(18, 9)), 2) AS DOUBLE) END AS avg_pct_approved
    FROM prev GROUP BY 1""")
def avg_pct_approved(v: Views) -> DataFrame:
    return applications.previous_features(v.prev, ["avg_pct_approved"], [])


@query("inquiry_freq", "SELECT sk_id_curr, -CAST(trunc(avg(days_decision)) AS INT) AS avg_inq_freq FROM prev GROUP BY 1")
def inquiry_freq(v: Views) -> DataFrame:
    return applications.previous_features(v.prev, ["avg_inq_freq"], [])


@query("applications_by_daypart", """
    SELECT sk_id_curr, count(*) FILTER (WHERE h BETWEEN 5 AND 8) AS cnt_early_applications,
      count(*) FILTER (WHERE h BETWEEN 9 AND 18) AS cnt_daytime_applications,
      count(*) FILTER (WHERE h BETWEEN 19 AND 22) AS cnt_afterwork_applications,
      count(*) FILTER (WHERE h = 23 OR h < 5) AS cnt_late_applications
    FROM (SELECT sk_id_curr, hour_appr_process_start AS h FROM prev) GROUP BY 1""")
def applications_by_daypart(v: Views) -> DataFrame:
    names = [f"cnt_{p}_applications" for p in applications.DAY_PARTS]
    return applications.previous_features(v.prev, names, [])


@query("late_early_payments", """
    SELECT sk_id_curr, count(*) FILTER (WHERE days_entry_payment > days_instalment) AS cnt_late_payments,
      count(*) FILTER (WHERE days_entry_payment < days_instalment) AS early_payments FROM inst GROUP BY 1""")
def late_early_payments(v: Views) -> DataFrame:
    return applications.payment_features(v.inst, ["cnt_late_payments", "early_payments"])


@query("avg_pct_paid", """
    SELECT sk_id_curr, CASE WHEN count(*) FILTER (WHERE amt_instalment = 0 AND amt_payment > 0) > 0
      THEN CAST('Infinity' AS DOUBLE)
      ELSE CAST(round(CAST(avg(CASE WHEN amt_instalment <> 0 THEN amt_payment / amt_instalment END) AS DECIMAL(18, 9)), 3) AS DOUBLE) END AS avg_pct_instalment_paid
    FROM inst GROUP BY 1""")
def avg_pct_paid(v: Views) -> DataFrame:
    return applications.payment_features(v.inst, ["avg_pct_instalment_paid"])


# ---- clients -----------------------------------------------------------------

@query("group_mean_gap", """
    SELECT a.sk_id_curr, round(a.amt_income_total - m.mean_income, 4) AS composite_metric
    FROM app a LEFT JOIN (
      SELECT code_gender, name_education_type, avg(amt_income_total) AS mean_income FROM app
      WHERE target IS NOT NULL AND name_education_type IS NOT NULL GROUP BY 1, 2) m
    ON a.code_gender = m.code_gender AND a.name_education_type = m.name_education_type""")
def group_mean_gap(v: Views) -> DataFrame:
    gap = clients.group_mean_gap(
        v.app, ["code_gender", "name_education_type"], "amt_income_total", F.col("target").isNotNull())
    return rounded(gap.select("sk_id_curr", "composite_metric"))


@query("num_documents", """
    SELECT sk_id_curr, 1 + coalesce(flag_document_2, 0) + coalesce(flag_document_3, 0) AS num_documents FROM app""")
def num_documents(v: Views) -> DataFrame:
    app = v.app
    return app.select("sk_id_curr", fx.num_documents(app).alias("num_documents"))


@query("building_info", """
    SELECT sk_id_curr, CASE WHEN area_avg IS NULL AND area_mode IS NULL THEN 0 ELSE 1 END AS building_info FROM app""")
def building_info(v: Views) -> DataFrame:
    app = v.app
    return app.select("sk_id_curr", fx.building_info(app, n=2).alias("building_info"))


# ---- survey ------------------------------------------------------------------

@query("group_median_impute", """
    WITH m1 AS (SELECT status, median(income) AS med FROM hw WHERE status IS NOT NULL GROUP BY 1),
    fixed AS (SELECT h.row_id, h.status, CASE WHEN h.income < 0 AND h.status IS NOT NULL THEN m1.med ELSE h.income END AS income,
        h.age, h.date FROM hw h LEFT JOIN m1 ON m1.status = h.status),
    m2 AS (SELECT status, median(income) AS med FROM fixed WHERE status IS NOT NULL GROUP BY 1)
    SELECT f.row_id, f.status, round(CASE WHEN f.income IS NULL AND f.status IN ('Student', 'Pensioner', 'Working')
      THEN m2.med ELSE f.income END, 4) AS income, f.age, f.date
    FROM fixed f LEFT JOIN m2 ON m2.status = f.status""")
def group_median_impute(v: Views) -> DataFrame:
    return rounded(survey.group_median_impute(v.hw))


@query("daily_count_mean", """
    SELECT date, status, count(income) AS n, round(avg(income), 6) AS mean_value FROM hw WHERE status IS NOT NULL GROUP BY 1, 2
    UNION ALL SELECT date, NULL, count(income), round(avg(income), 6) FROM hw GROUP BY 1""")
def daily_count_mean(v: Views) -> DataFrame:
    return rounded(survey.daily_count_mean(v.hw), 6)


@query("weekday_counts", "SELECT CAST(isodow(date) - 1 AS INT) AS dow, count(income) AS cnt_daily FROM hw GROUP BY 1")
def weekday_counts(v: Views) -> DataFrame:
    return survey.weekday_counts(v.hw)


@query("weekday_status_pivot", "SELECT CAST(isodow(date) - 1 AS INT) AS dow, " + ", ".join(
    f"count(income) FILTER (WHERE status = '{s}') AS \"{s}\"" for s in survey.STATUSES)
    + " FROM hw WHERE status IS NOT NULL GROUP BY 1")
def weekday_status_pivot(v: Views) -> DataFrame:
    return survey.weekday_status_pivot(v.hw)


@query("group_share", """
    SELECT status, n, round(n / (SELECT CAST(count(income) AS DOUBLE) FROM hw WHERE status IS NOT NULL), 6) AS share
    FROM (SELECT status, count(income) AS n FROM hw WHERE status IS NOT NULL GROUP BY 1)""")
def group_share(v: Views) -> DataFrame:
    return rounded(survey.group_share(v.hw), 6)


@query("histogram", """
    WITH r AS (SELECT status AS s, min(income) AS lo, max(income) AS hi FROM hw WHERE status IS NOT NULL GROUP BY 1)
    SELECT status, bin, round(lo + (hi - lo) / 30 * bin, 4) AS lower, round(lo + (hi - lo) / 30 * (bin + 1), 4) AS upper,
      count(*) AS n
    FROM (SELECT status, lo, hi, CAST(least(floor((income - lo) * 30 / (hi - lo)), 29) AS INT) AS bin
          FROM hw JOIN r ON s = status WHERE income IS NOT NULL) GROUP BY status, bin, lo, hi""")
def histogram(v: Views) -> DataFrame:
    return rounded(survey.histogram(v.hw, "income", 30, "status"))


@query("histogram_auto", """
    WITH r AS (SELECT min(income) AS lo, max(income) AS hi, count(income) AS n,
        quantile_cont(income, 0.75) - quantile_cont(income, 0.25) AS iqr FROM hw),
    b AS (SELECT lo, hi, ceil((hi - lo) / least((hi - lo) / (log2(n) + 1), 2 * iqr / pow(n, 1.0 / 3))) AS k FROM r)
    SELECT bin, round(lo + (hi - lo) / k * bin, 4) AS lower, round(lo + (hi - lo) / k * (bin + 1), 4) AS upper, count(*) AS n
    FROM (SELECT lo, hi, k, CAST(least(floor((income - lo) * k / (hi - lo)), k - 1) AS INT) AS bin
          FROM hw, b WHERE income IS NOT NULL) GROUP BY bin, lo, hi, k""")
def histogram_auto(v: Views) -> DataFrame:
    return rounded(survey.histogram(v.hw, "income", "auto"))


@query("box_stats", """
    WITH q AS (SELECT status AS s, quantile_cont(income, 0.25) AS q1, quantile_cont(income, 0.5) AS q2,
        quantile_cont(income, 0.75) AS q3 FROM hw WHERE status IS NOT NULL GROUP BY 1),
    x AS (SELECT status, income, q1, q2, q3, income BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS inside
        FROM hw JOIN q ON s = status WHERE income IS NOT NULL)
    SELECT status, round(q1, 4) AS q1, round(q2, 4) AS q2, round(q3, 4) AS q3,
      round(min(income) FILTER (WHERE inside), 4) AS whisker_low, round(max(income) FILTER (WHERE inside), 4) AS whisker_high,
      count(*) FILTER (WHERE NOT inside) AS n_outliers
    FROM x GROUP BY status, q1, q2, q3""")
def box_stats(v: Views) -> DataFrame:
    return rounded(survey.box_stats(v.hw))


@query("group_cross_tab", """
    SELECT credit_type AS category, count(*) FILTER (WHERE target = 0) AS n0, count(*) FILTER (WHERE target = 1) AS n1,
      count(*) AS n, round(round(avg(target), 4) * 100, 2) AS default_pct
    FROM bur JOIN app USING (sk_id_curr) WHERE target IS NOT NULL GROUP BY 1""")
def group_cross_tab(v: Views) -> DataFrame:
    labelled = v.bur.join(v.app.select("sk_id_curr", "target"), "sk_id_curr")
    return stats.group_cross_tab(labelled, "credit_type")


