"""Queries over scalar functions and column cleaning."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import client as fx
from ..functions.core import ratio
from ..operators import cleaning, survey
from ..plans.standin import Views
from .registry import query, rounded


@query("full_years", "SELECT sk_id_curr, CAST(floor(days_birth / 365.25) AS SMALLINT) AS age_years FROM app")
def full_years(v: Views) -> DataFrame:
    return v.app.select("sk_id_curr", fx.full_years("days_birth").alias("age_years"))


@query("id_change_age", """
    SELECT sk_id_curr, CAST(floor((days_birth + days_id_publish) / 365.25) AS SMALLINT) AS id_change_age FROM app""")
def id_change_age(v: Views) -> DataFrame:
    return v.app.select("sk_id_curr", fx.id_change_age().alias("id_change_age"))


@query("id_change_delay", """
    SELECT sk_id_curr, d AS id_age_change_diff, CAST(d > 0 AS INT) AS flag_late_id_change FROM (
      SELECT sk_id_curr, a - CASE WHEN a < 20 THEN 14 WHEN a < 45 THEN 20 ELSE 45 END AS d FROM (
        SELECT sk_id_curr, CAST(floor((days_birth + days_id_publish) / 365.25) AS INT) AS a FROM app))""")
def id_change_delay(v: Views) -> DataFrame:
    age = fx.id_change_age()
    return v.app.select(
        "sk_id_curr", fx.id_change_delay(age).alias("id_age_change_diff"),
        fx.late_id_change(age).alias("flag_late_id_change"))


@query("client_ratios", """
    SELECT sk_id_curr, round(amt_annuity / nullif(amt_income_total, 0), 6) AS annuity_to_income_rate,
      round(cnt_children / CAST(cnt_fam_members - cnt_children AS DOUBLE), 6) AS children_per_adult,
      round(amt_income_total / greatest(cnt_children, 1), 6) AS inc_per_child,
      round(amt_income_total / (cnt_fam_members - cnt_children), 6) AS inc_per_adult,
      round(round(amt_annuity / amt_credit * 100, 3), 6) AS annuity_rate
    FROM app""")
def client_ratios(v: Views) -> DataFrame:
    return rounded(v.app.select("sk_id_curr", *[c.alias(n) for n, c in fx.client_ratios().items()]), 6)


@query("source_presence_score", """
    SELECT sk_id_curr, round(0.30 * (ext_source_1 IS NOT NULL)::INT + 0.25 * (ext_source_2 IS NOT NULL)::INT
      + 0.45 * (ext_source_3 IS NOT NULL)::INT, 4)::DOUBLE AS weighted_ext_scores FROM app""")
def source_presence_score(v: Views) -> DataFrame:
    return rounded(v.app.select("sk_id_curr", fx.source_presence_score().alias("weighted_ext_scores")))


@query("weighted_sum", """
    SELECT sk_id_curr, round(ext_source_1 * 0.5::DOUBLE + ext_source_2 * 1.3::DOUBLE + ext_source_3 * 0.7::DOUBLE, 6) AS weighted_sum
    FROM app""")
def weighted_sum(v: Views) -> DataFrame:
    return rounded(v.app.select("sk_id_curr", fx.weighted_sum().alias("weighted_sum")), 6)


@query("fill_nulls", """
    SELECT sk_id_curr, coalesce(ext_source_1, -999) AS ext_source_1,
      round(coalesce(ext_source_2, (SELECT avg(ext_source_2) FROM app)), 6) AS ext_source_2,
      round(coalesce(ext_source_3, (SELECT median(ext_source_3) FROM app)), 6) AS ext_source_3,
      round(coalesce(amt_income_total, 0), 6) AS amt_income_total,
      coalesce(name_education_type, '<missing>') AS name_education_type
    FROM app""")
def fill_nulls(v: Views) -> DataFrame:
    df = v.app.select("sk_id_curr", "ext_source_1", "ext_source_2", "ext_source_3", "amt_income_total", "name_education_type")
    df = cleaning.fill_nulls(df, -999, columns=["ext_source_1", "name_education_type"])
    df = cleaning.fill_nulls(df, 0, columns=["amt_income_total"])
    df = cleaning.fill_nulls(df, "mean", columns=["ext_source_2"])
    return rounded(cleaning.fill_nulls(df, "median", columns=["ext_source_3"]), 6)


@query("replace_infinite", """
    SELECT sk_id_prev, CASE WHEN amt_application = 0 THEN -999 ELSE round(amt_credit / amt_application, 6) END AS pct_approve
    FROM prev""")
def replace_infinite(v: Views) -> DataFrame:
    df = v.prev.select("sk_id_prev", ratio("amt_credit", "amt_application", "inf").alias("pct_approve"))
    return rounded(cleaning.replace_infinite(df, ["pct_approve"], -999), 6)


@query("age_repair", "SELECT row_id, CASE WHEN coalesce(age, 0) = 0 THEN 26 ELSE age END AS age FROM hw")
def age_repair(v: Views) -> DataFrame:
    return v.hw.select("row_id", survey.age_repair().alias("age"))


@query("cast_columns", """
    SELECT row_id, CAST(trunc(income) AS INT) AS income, CAST(age AS SMALLINT) AS age, date FROM hw""")
def cast_columns(v: Views) -> DataFrame:
    text = v.hw.select("row_id", "income", "age", F.date_format("date", "yyyy-MM-dd").alias("date"))
    return cleaning.cast_columns(text, {"date": "date", "age": "smallint", "income": "int"})


@query("scalar_misc", """
    SELECT sk_id_prev, CAST(amt_credit AS FLOAT) AS credit_real, CAST(floor(amt_credit / 1000) AS BIGINT) AS thousands,
      abs(days_decision) AS days_ago, lower(name_contract_type) AS contract,
      regexp_replace(name_contract_type, '[^a-zA-Z0-9]', '_', 'g') AS contract_key,
      CASE WHEN hour_appr_process_start < 12 THEN 'am' ELSE 'pm' END AS half, amt_application IS NOT NULL AS has_application
    FROM prev""")
def scalar_misc(v: Views) -> DataFrame:
    return v.prev.select(
        "sk_id_prev", F.col("amt_credit").cast("float").alias("credit_real"),
        F.floor(F.col("amt_credit") / 1000).alias("thousands"), F.abs("days_decision").alias("days_ago"),
        F.lower("name_contract_type").alias("contract"),
        F.regexp_replace("name_contract_type", "[^a-zA-Z0-9]", "_").alias("contract_key"),
        F.when(F.col("hour_appr_process_start") < 12, "am").otherwise("pm").alias("half"),
        F.col("amt_application").isNotNull().alias("has_application"))


@query("json_fields", """
    SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events""")
def json_fields(v: Views) -> DataFrame:
    props = F.from_json("props", "k bigint")
    return v.table("events").select("event_id", props.getField("k").alias("k"))


