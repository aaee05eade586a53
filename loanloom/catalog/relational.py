"""Queries over filters, joins, ordering and sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators import bureau, relational as rel
from ..plans.features import features_train_test
from ..plans.standin import Views
from .registry import query, rounded


@query("select_all", "SELECT * FROM bur")
def select_all(v: Views) -> DataFrame:
    return v.bur.select("*")


@query("select_columns", "SELECT sk_id_curr, sk_id_bureau, credit_active, credit_currency FROM bur")
def select_columns(v: Views) -> DataFrame:
    return v.bur.select("sk_id_curr", "sk_id_bureau", "credit_active", "credit_currency")


@query("annuity_rate_sql", "SELECT sk_id_curr, round(amt_annuity / amt_credit, 6) AS annuity_rate FROM app")
def annuity_rate_sql(v: Views) -> DataFrame:
    return rounded(rel.annuity_rate(v.app), 6)


@query("monthly_burden", "SELECT sk_id_curr, round(amt_income_total / 12 / amt_annuity, 6) AS burden FROM app")
def monthly_burden(v: Views) -> DataFrame:
    return rounded(rel.monthly_burden(v.app), 6)


@query("income_per_family_member", """
    SELECT sk_id_curr, round(amt_income_total / cnt_fam_members, 4) AS income_per_family_member FROM app""")
def income_per_family_member(v: Views) -> DataFrame:
    return rounded(rel.income_per_family_member(v.app))


@query("flip_sign", """
    SELECT sk_id_prev, sk_id_curr, -days_instalment AS days_instalment, -days_entry_payment AS days_entry_payment,
           amt_instalment, round(amt_payment, 4) AS amt_payment FROM inst""")
def flip_sign(v: Views) -> DataFrame:
    flipped = rel.flip_sign(v.inst, ["days_instalment", "days_entry_payment"])
    return flipped.withColumn("amt_payment", F.round("amt_payment", 4))


@query("owners_full_years_top10", """
    SELECT sk_id_curr, CAST(days_birth // 365 AS BIGINT) AS full_years_age FROM app
    WHERE flag_own_car AND flag_own_realty ORDER BY full_years_age, sk_id_curr LIMIT 10""")
def owners_full_years_top10(v: Views) -> DataFrame:
    return rel.owners_full_years(v.app)


@query("above_avg_income", """
    SELECT * FROM app WHERE amt_income_total / cnt_fam_members >=
      2 * (SELECT avg(amt_income_total / cnt_fam_members) FROM app)""")
def above_avg_income(v: Views) -> DataFrame:
    return rel.above_average_income(v.app)


@query("cap_values", """
    SELECT sk_id_curr, CASE WHEN amt_income_total > 200000 THEN 200000 ELSE amt_income_total END AS amt_income_total,
      CASE WHEN cnt_children > 2 THEN 2 ELSE cnt_children END AS cnt_children FROM app""")
def cap_values(v: Views) -> DataFrame:
    chosen = v.app.select("sk_id_curr", "amt_income_total", "cnt_children")
    return rel.cap_values(chosen, {"amt_income_total": 200_000, "cnt_children": 2})


def application_rows(v: Views) -> DataFrame:
    """Applications with the microloan counts the fraud rules read."""
    names = ["Microloan", "cnt_closed_Microloan", "cnt_overdue_Microloan"]
    counts = bureau.credit_features(v.bur, None, names, types=["Microloan"])
    base = v.app.select(
        "sk_id_curr", "flag_cont_mobile", "flag_email", "flag_phone", "days_birth", "days_employed", "amt_credit",
        "amt_income_total")
    return rel.assemble_features(base, [counts], "sk_id_curr")


_RULES_SQL = """
    WITH micro AS (
      SELECT sk_id_curr, count(*) FILTER (WHERE credit_type = 'Microloan') AS Microloan,
        count(*) FILTER (WHERE credit_type = 'Microloan' AND credit_active = 'Closed') AS cnt_closed_Microloan,
        count(*) FILTER (WHERE credit_type = 'Microloan'
          AND (amt_credit_max_overdue > 0 OR amt_credit_sum_overdue > 0)) AS cnt_overdue_Microloan
      FROM bur GROUP BY sk_id_curr),
    marked AS (
      SELECT sk_id_curr, flag_cont_mobile, flag_email, flag_phone, days_birth, days_employed, amt_credit,
        amt_income_total, Microloan, cnt_closed_Microloan, cnt_overdue_Microloan,
        coalesce(greatest(flag_cont_mobile, flag_email, flag_phone) <= 0, FALSE) AS r1,
        coalesce((days_birth - days_employed) / 365.0 < 18, FALSE) AS r2,
        coalesce(cnt_closed_Microloan = 0 AND Microloan > 1, FALSE) AS r3,
        coalesce(cnt_closed_Microloan = 0 AND cnt_overdue_Microloan >= 1, FALSE) AS r4,
        coalesce(amt_credit > 20 * amt_income_total, FALSE) AS r5
      FROM app LEFT JOIN micro USING (sk_id_curr))
"""


@query("fraud_rules", _RULES_SQL + """
    SELECT * EXCLUDE (r1, r2, r3, r4, r5) FROM marked WHERE NOT (r1 OR r2 OR r3 OR r4 OR r5)""")
def fraud_rules(v: Views) -> DataFrame:
    return rel.drop_fraud(application_rows(v))


@query("fraud_rule_hits", _RULES_SQL + " UNION ALL ".join(
    f"SELECT '{name}' AS rule, count(*) AS hits FROM marked WHERE {cond}" for name, cond in (
        ("no_contacts", "r1"), ("employed_before_18", "r2"), ("only_open_microloans", "r3"),
        ("only_overdue_microloans", "r4"), ("credit_over_20_incomes", "r5"),
        ("any_rule", "r1 OR r2 OR r3 OR r4 OR r5"))))
def fraud_rule_hits(v: Views) -> DataFrame:
    return rel.fraud_rule_hits(application_rows(v))


@query("drop_null_rows", "SELECT * FROM hw WHERE status IS NOT NULL")
def drop_null_rows(v: Views) -> DataFrame:
    return rel.drop_null_rows(v.hw, ["status"])


@query("drop_where", "SELECT * FROM hw WHERE income IS NOT NULL OR status IS NULL OR status <> 'Businessman'")
def drop_where(v: Views) -> DataFrame:
    return rel.drop_where(v.hw, (F.col("status") == "Businessman") & F.col("income").isNull())


@query("in_list_filter", "SELECT * FROM bur_bal WHERE status IS NULL OR (status <> 'X' AND status <> 'C' AND status <> '5')")
def in_list_filter(v: Views) -> DataFrame:
    return rel.in_list(v.bur_bal, "status", ["X", "C", "5"], negate=True)


@query("distinct_keys", "SELECT sk_id_curr FROM bur GROUP BY sk_id_curr")
def distinct_keys(v: Views) -> DataFrame:
    return rel.distinct_keys(v.bur, "sk_id_curr")


# ---- joins -------------------------------------------------------------------

@query("join_inner_all", "SELECT a.*, b.* EXCLUDE (sk_id_curr) FROM app a JOIN bur b USING (sk_id_curr)")
def join_inner_all(v: Views) -> DataFrame:
    return rel.join_all(v.app, v.bur, "sk_id_curr")


@query("join_inner_select", """
    SELECT sk_id_curr, code_gender, sk_id_bureau, amt_credit_sum FROM bur JOIN app USING (sk_id_curr)""")
def join_inner_select(v: Views) -> DataFrame:
    return rel.join_select(v.app, v.bur, "sk_id_curr", ["sk_id_curr", "code_gender", "sk_id_bureau", "amt_credit_sum"])


@query("join_aggregated", """
    SELECT a.sk_id_curr, any_value(code_gender) AS code_gender, count(sk_id_bureau) AS count_loans_bki_history,
      round(sum(amt_credit_sum), 2) AS loans_sum
    FROM app a JOIN bur b ON a.sk_id_curr = b.sk_id_curr GROUP BY a.sk_id_curr""")
def join_aggregated(v: Views) -> DataFrame:
    return rounded(rel.join_aggregated(v.app, v.bur), 2)


@query("cross_join_total", """
    SELECT name_education_type, round(count(*) / sum(CAST(count(*) AS DOUBLE)) OVER (), 6) AS rate
    FROM app GROUP BY name_education_type""")
def cross_join_total(v: Views) -> DataFrame:
    return rounded(rel.category_shares(v.app, "name_education_type", "sk_id_curr"), 6)


@query("anti_join_no_history", """
    SELECT bur.* FROM bur LEFT JOIN (SELECT DISTINCT sk_id_bureau AS known FROM bur_bal) ON known = sk_id_bureau
    WHERE known IS NULL""")
def anti_join_no_history(v: Views) -> DataFrame:
    return rel.without_match(v.bur, v.bur_bal, "sk_id_bureau")


@query("older_without_history", """
    SELECT app.* FROM app LEFT JOIN (SELECT DISTINCT sk_id_curr AS known FROM cc)
      ON known = sk_id_curr WHERE known IS NULL AND days_birth >= 61 * 365""")
def older_without_history(v: Views) -> DataFrame:
    return rel.older_without_history(v.app, v.cc, "sk_id_curr")


@query("semi_join_overdue", """
    SELECT app.* FROM app JOIN (
      SELECT sk_id_curr AS k, sum(CASE WHEN credit_day_overdue > 60 THEN 1 ELSE 0 END) AS late FROM bur GROUP BY 1)
    ON k = sk_id_curr WHERE late >= 2 AND code_gender <> 'M'""")
def semi_join_overdue(v: Views) -> DataFrame:
    return rel.women_often_overdue(v.app, v.bur)


@query("overdue_top7", """
    WITH totals AS (
      SELECT sk_id_curr AS k, sum(amt_credit_sum) AS all_credit, sum(amt_credit_sum_overdue) AS all_overdue,
        sum(amt_credit_sum) FILTER (WHERE credit_active = 'Active' AND amt_credit_sum > 0) AS act_credit,
        sum(amt_credit_sum_overdue) FILTER (WHERE credit_active = 'Active' AND amt_credit_sum > 0) AS act_overdue
      FROM bur GROUP BY 1)
    SELECT app.*, round(all_credit, 2) AS sum_all_credit, round(all_overdue, 2) AS sum_all_overdue,
      round(act_credit, 2) AS sum_actv_credit, round(act_overdue, 2) AS sum_actv_overdue,
      round(act_overdue / act_credit, 6) AS actv_overdue_rate
    FROM app JOIN totals ON k = sk_id_curr
    WHERE code_gender = 'M' AND act_credit IS NOT NULL ORDER BY all_overdue DESC, sk_id_curr LIMIT 7""")
def overdue_top7(v: Views) -> DataFrame:
    top = rel.overdue_leaders(v.app, v.bur)
    places = {"sum_all_credit": 2, "sum_all_overdue": 2, "sum_actv_credit": 2, "sum_actv_overdue": 2, "actv_overdue_rate": 6}
    return top.select(*[F.round(c, places[c]).alias(c) if c in places else c for c in top.columns])


@query("assemble_features", """
    WITH b AS (SELECT sk_id_curr, max(amt_credit_sum_overdue) AS max_overdue_amt,
                 count(*) FILTER (WHERE credit_type = 'Microloan') AS Microloan FROM bur GROUP BY 1),
    p AS (SELECT sk_id_curr, -CAST(trunc(avg(days_decision)) AS INT) AS avg_inq_freq FROM prev GROUP BY 1),
    i AS (SELECT sk_id_curr, count(*) FILTER (WHERE days_entry_payment > days_instalment) AS cnt_late_payments,
                 count(*) FILTER (WHERE days_entry_payment < days_instalment) AS early_payments FROM inst GROUP BY 1),
    c AS (SELECT sk_id_prev, max(amt_balance) AS amt_balance_max, avg(cnt_drawings) AS cnt_drawings_mean FROM cc GROUP BY 1),
    k AS (SELECT sk_id_curr, round(avg(amt_balance_max), 4) AS amt_balance_max, round(avg(cnt_drawings_mean), 4) AS cnt_drawings_mean
          FROM c JOIN prev USING (sk_id_prev) GROUP BY 1)
    SELECT sk_id_curr, target, CAST(floor(days_birth / 365.25) AS SMALLINT) AS age_years,
      1 + flag_document_2 + flag_document_3 AS num_documents, max_overdue_amt, Microloan, avg_inq_freq,
      cnt_late_payments, early_payments, amt_balance_max, cnt_drawings_mean
    FROM app LEFT JOIN b USING (sk_id_curr) LEFT JOIN p USING (sk_id_curr) LEFT JOIN i USING (sk_id_curr)
    LEFT JOIN k USING (sk_id_curr)""")
def assemble_features(v: Views) -> DataFrame:
    whole = features_train_test(v.app, v.bur, v.bur_bal, v.cc, v.prev, v.inst)
    return rounded(whole.select(
        "sk_id_curr", "target", "age_years", "num_documents", "max_overdue_amt", "Microloan", "avg_inq_freq",
        "cnt_late_payments", "early_payments", "amt_balance_max", "cnt_drawings_mean"))


@query("bridge_keys", """
    SELECT l.*, (SELECT any_value(sk_id_curr) FROM bur WHERE bur.sk_id_bureau = l.sk_id_bureau) AS sk_id_curr
    FROM bur_bal l""")
def bridge_keys(v: Views) -> DataFrame:
    return rel.bridge_keys(v.bur_bal, v.bur, "sk_id_bureau", ["sk_id_curr"])


@query("attach_target", """
    SELECT p.* EXCLUDE (amt_credit), round(p.amt_credit, 4) AS amt_credit, a.target
    FROM prev p JOIN app a ON p.sk_id_curr = a.sk_id_curr AND a.target IN (0, 1)""")
def attach_target(v: Views) -> DataFrame:
    return rel.attach_target(v.prev, v.app).withColumn("amt_credit", F.round("amt_credit", 4))


@query("max_per_client_join", """
    SELECT a.sk_id_curr, a.target, max(sk_id_prev) AS sk_id_prev, max(days_instalment) AS days_instalment,
      max(days_entry_payment) AS days_entry_payment, max(amt_instalment) AS amt_instalment,
      round(max(amt_payment), 4) AS amt_payment
    FROM app a LEFT JOIN inst i ON i.sk_id_curr = a.sk_id_curr AND i.sk_id_prev IN (SELECT sk_id_prev FROM prev)
    GROUP BY 1, 2""")
def max_per_client_join(v: Views) -> DataFrame:
    best = rel.max_per_client(v.app, v.prev, v.inst)
    return best.withColumn("amt_payment", F.round("amt_payment", 4))


@query("semi_join_active", """
    SELECT bur_bal.* FROM bur_bal JOIN bur USING (sk_id_bureau) WHERE credit_active = 'Active'""")
def semi_join_active(v: Views) -> DataFrame:
    return rel.semi_join_where(v.bur_bal, v.bur, "sk_id_bureau", F.col("credit_active") == "Active")


# ---- ordering and sets -------------------------------------------------------

@query("order_by", """
    SELECT sk_id_curr, amt_income_total FROM app ORDER BY amt_income_total DESC NULLS LAST, sk_id_curr""")
def order_by(v: Views) -> DataFrame:
    return v.app.select("sk_id_curr", "amt_income_total").orderBy(F.desc_nulls_last("amt_income_total"), "sk_id_curr")


@query("limit_k", "SELECT * FROM scored ORDER BY sk_id_curr LIMIT 1000")
def limit_k(v: Views) -> DataFrame:
    return rel.top_k(v.scored, [F.col("sk_id_curr")], 1000)


@query("top_k", """
    SELECT sk_id_bureau, sk_id_curr, amt_credit_sum FROM bur
    ORDER BY amt_credit_sum DESC NULLS LAST, sk_id_bureau LIMIT 10""")
def top_k(v: Views) -> DataFrame:
    chosen = v.bur.select("sk_id_bureau", "sk_id_curr", "amt_credit_sum")
    return rel.top_k(chosen, [F.desc_nulls_last("amt_credit_sum"), F.col("sk_id_bureau")], 10)


@query("union_all", "SELECT sk_id_curr, target, amt_credit FROM app")
def union_all(v: Views) -> DataFrame:
    chosen = v.app.select("sk_id_curr", "target", "amt_credit")
    return rel.union_all(chosen.filter("target IS NOT NULL"), chosen.filter("target IS NULL").drop("target"))


@query("key_set_difference", "SELECT sk_id_bureau FROM bur_bal EXCEPT SELECT sk_id_bureau FROM bur")
def key_set_difference(v: Views) -> DataFrame:
    return rel.key_set_difference(v.bur_bal, v.bur, "sk_id_bureau")


@query("column_concat", "SELECT sk_id_curr, ext_source_1, ext_source_2, ext_source_3, target FROM app")
def column_concat(v: Views) -> DataFrame:
    features = v.app.select("sk_id_curr", "ext_source_1", "ext_source_2", "ext_source_3")
    return rel.column_concat(features, v.app.select("sk_id_curr", "target"), "sk_id_curr")


