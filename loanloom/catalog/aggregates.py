"""Queries over plain aggregates and windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.core import whole_div
from ..operators import bureau, ordered, relational as rel
from ..plans.standin import Views
from .registry import query, rounded


@query("avg_income", "SELECT round(avg(amt_income_total), 4) AS average_income FROM app")
def avg_income(v: Views) -> DataFrame:
    return rounded(v.app.agg(F.avg("amt_income_total").alias("average_income")))


@query("min_max_age", """
    SELECT CAST(min(days_birth) // 365 AS BIGINT) AS min_age, CAST(max(days_birth) // 365 AS BIGINT) AS max_age FROM app""")
def min_max_age(v: Views) -> DataFrame:
    ends = v.app.agg(F.min("days_birth").alias("lo"), F.max("days_birth").alias("hi"))
    return ends.select(whole_div("lo", 365).alias("min_age"), whole_div("hi", 365).alias("max_age"))


@query("count_by", "SELECT code_gender, count(*) AS cnt FROM app GROUP BY ALL")
def count_by(v: Views) -> DataFrame:
    return v.app.groupBy("code_gender").agg(F.count(F.lit(1)).alias("cnt"))


@query("sum_count_avg_by", """
    SELECT flag_own_car, round(sum(amt_credit), 2) AS sum_credit, count(amt_credit) AS cnt_credit,
      round(avg(amt_credit), 4) AS avg_credit FROM app GROUP BY ALL""")
def sum_count_avg_by(v: Views) -> DataFrame:
    return rounded(v.app.groupBy("flag_own_car").agg(
        F.sum("amt_credit").alias("sum_credit"), F.count("amt_credit").alias("cnt_credit"),
        F.avg("amt_credit").alias("avg_credit")), 4, sum_credit=2)


@query("loans_per_client", """
    SELECT sk_id_curr, count(sk_id_bureau) AS count_loans_bki_history, round(sum(amt_credit_sum), 2) AS loans_sum
    FROM bur GROUP BY 1 ORDER BY 1 LIMIT 10""")
def loans_per_client(v: Views) -> DataFrame:
    return rounded(rel.top_k(rel.loan_totals(v.bur), [F.col("sk_id_curr")], 10), 2)


@query("having_count", """
    SELECT sk_id_curr, overdue_cnt FROM (
      SELECT sk_id_curr, count(*) FILTER (WHERE credit_day_overdue >= 61) AS overdue_cnt FROM bur GROUP BY 1)
    WHERE overdue_cnt >= 2""")
def having_count(v: Views) -> DataFrame:
    return rel.often_overdue(v.bur)


@query("active_overdue_rate_sql", """
    SELECT sk_id_curr, round(sum(amt_credit_sum_overdue) / sum(amt_credit_sum), 6) AS actv_overdue_rate
    FROM bur WHERE amt_credit_sum > 0 AND credit_active = 'Active' GROUP BY 1""")
def active_overdue_rate_sql(v: Views) -> DataFrame:
    return rounded(bureau.active_overdue_rates(v.bur), 6)


@query("closed_clean_count", """
    SELECT sk_id_curr, count(*) AS cnt FROM bur
    WHERE amt_credit_sum_overdue = 0 AND amt_credit_sum > 0 AND credit_active = 'Closed' GROUP BY 1""")
def closed_clean_count(v: Views) -> DataFrame:
    return bureau.closed_clean_count(v.bur)


@query("active_ratio", """
    SELECT sk_id_curr, CAST(round(CAST(count(*) FILTER (WHERE credit_active = 'Active') / CAST(count(*) AS DOUBLE) AS DECIMAL(18, 9)), 2) AS DOUBLE) AS active_ratio
    FROM bur GROUP BY 1""")
def active_ratio(v: Views) -> DataFrame:
    return bureau.active_ratio(v.bur)


@query("share_within_client", """
    SELECT c.sk_id_curr, c.credit_active, c.n AS cat_count, round(c.n / CAST(t.n AS DOUBLE), 6) AS credit_active_ratio
    FROM (SELECT sk_id_curr, credit_active, count(*) AS n FROM bur GROUP BY 1, 2) c
    JOIN (SELECT sk_id_curr, count(*) AS n FROM bur GROUP BY 1) t USING (sk_id_curr)""")
def share_within_client(v: Views) -> DataFrame:
    counts = v.bur.groupBy("sk_id_curr", "credit_active").agg(F.count(F.lit(1)).alias("cat_count"))
    total = F.sum("cat_count").over(Window.partitionBy("sk_id_curr")).cast("double")
    return rounded(counts.select("*", (F.col("cat_count") / total).alias("credit_active_ratio")), 6)


@query("avg_rank", """
    SELECT amt_credit, count(*) AS n, round(avg(place), 4) AS avg_rank FROM (
      SELECT amt_credit, row_number() OVER (ORDER BY amt_credit) AS place FROM app) GROUP BY 1""")
def avg_rank(v: Views) -> DataFrame:
    return rounded(ordered.average_ranks(v.app, "amt_credit"))
