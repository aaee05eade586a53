"""Client features on hand-made rows: missing values, zeros, empty groups, infinities."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from loanloom.functions import client as fx
from loanloom.functions.core import ratio
from loanloom.operators import applications, bureau, cards, cleaning, clients, relational as rel, survey
from loanloom.plans import features

INF = math.inf


def test_ratio(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 0.0), (-1.0, 0.0), (0.0, 0.0), (None, 1.0)], "n double, d double")
    got = df.select(ratio("n", "d").alias("a"), ratio("n", "d", "inf").alias("b"), ratio("n", "d", 7).alias("c")).collect()
    assert [r["a"] for r in got] == [0.5, None, None, None, None]
    assert [r["b"] for r in got] == [0.5, INF, -INF, None, None]
    assert [r["c"] for r in got] == [0.5, 7.0, 7.0, None, None]


CREDITS = [
    # client, credit, active, type, days, sum, overdue, max overdue
    (1, 10, "Active", "Microloan", -100, 0.0, 5.0, None),
    (1, 11, "Closed", "Microloan", -50, 100.0, 0.0, 3.0),
    (2, 20, "Closed", "Car loan", -10, None, None, None),
    (3, 30, "Active", "Car loan", -30, 0.0, 0.0, 0.0),
    (3, 31, "Active", "Microloan", -20, None, None, 1.0),
    (4, 40, "Active", "Car loan", -5, 200.0, 50.0, 0.0),
]
BALANCE = [
    (10, -1, "0"), (10, -2, "1"), (10, -3, "5"), (11, -4, "C"), (11, -9, "C"), (11, -2, "X"),
    (30, -7, None), (30, -8, "2"), (99, -1, "C"),
]


@pytest.fixture(scope="module")
def credits(spark):
    return spark.createDataFrame(
        CREDITS, "sk_id_curr int, sk_id_bureau int, credit_active string, credit_type string, days_credit int, "
                 "amt_credit_sum double, amt_credit_sum_overdue double, amt_credit_max_overdue double")


@pytest.fixture(scope="module")
def balance(spark):
    return spark.createDataFrame(BALANCE, "sk_id_bureau int, months_balance int, status string")


def by_client(df):
    return {r["sk_id_curr"]: r.asDict() for r in df.collect()}


@pytest.mark.parametrize("parts", [1, 17])
def test_credit_features(credits, balance, parts):
    got = by_client(bureau.credit_features(credits.repartition(parts), balance.repartition(parts)))
    assert set(got) == {1, 2, 3, 4}
    assert got[1]["max_overdue_amt"] == 5.0 and got[1]["min_overdue_amt"] == 5.0
    assert got[2]["max_overdue_amt"] is None and got[2]["min_overdue_amt"] == 0.0
    # overdue over nothing is an infinity that becomes 0; nothing over nothing stays missing
    assert got[1]["actv_overdue_rate"] == 0.0
    assert got[2]["actv_overdue_rate"] is None and got[3]["actv_overdue_rate"] is None
    assert got[4]["actv_overdue_rate"] == 0.25
    assert (got[1]["Microloan"], got[1]["Car loan"]) == (2, 0)
    assert got[1]["cnt_overdue_Microloan"] == 2 and got[4]["cnt_overdue_Car loan"] == 1 and got[2]["cnt_overdue_Car loan"] == 0
    assert got[1]["cnt_closed_Microloan"] == 1
    assert (got[1]["cnt_open_credits"], got[1]["cnt_closed_credits"], got[1]["cnt_credits"]) == (2, 2, 6)
    # a row without a status is a row but not an open month
    assert (got[3]["cnt_open_credits"], got[3]["cnt_closed_credits"], got[3]["cnt_credits"]) == (1, None, 2)
    assert got[1]["cnt_overdue_1_dpd"] == 1 and got[1]["cnt_overdue_5_dpd"] == 1 and got[4]["cnt_overdue_1_dpd"] == 0
    assert got[1]["rate_5_dpd"] == pytest.approx(1 / 6) and got[4]["rate_5_dpd"] is None
    assert got[1]["diff_last_closed_credit"] == -120
    assert (got[1]["days_since_last_actv_credit"], got[1]["months_since_last_actv_credit"]) == (-50, -3)
    assert got[3]["months_since_last_actv_credit"] == -8 and got[2]["months_since_last_actv_credit"] is None


def test_credit_shares(credits):
    ratios = {r[0]: r[1] for r in bureau.active_ratio(credits).collect()}
    assert ratios == {1: 0.5, 2: 0.0, 3: 1.0, 4: 1.0}
    assert [tuple(r) for r in bureau.active_overdue_rates(credits).collect()] == [(4, 0.25)]
    assert [tuple(r) for r in bureau.closed_clean_count(credits).collect()] == [(1, 1)]


@pytest.mark.parametrize("limit", [10**6, 4])
def test_card_profiles_match_pandas(spark, limit):
    rng = np.random.default_rng(3)
    rows = [(int(rng.integers(1, 6)), -int(rng.integers(1, 7)), float(rng.integers(0, 9)), None if rng.random() < 0.3 else float(rng.normal())) for _ in range(80)]
    rows += [(9, -5, 1.0, None), (8, -1, 0.0, 2.0)]
    pdf = pd.DataFrame(rows, columns=["sk_id_prev", "months_balance", "a", "b"])
    df = spark.createDataFrame(rows, "sk_id_prev int, months_balance int, a double, b double")
    got = cards.period_ratio_profile(df, "sk_id_prev", ["a", "b"], limit=limit, with_profile=True).toPandas().set_index("sk_id_prev").sort_index()
    kinds = ["min", "max", "median", "mean", "sum", "std"]
    whole = pdf.drop(columns="months_balance").groupby("sk_id_prev").agg(kinds)
    whole.columns = whole.columns.map("_".join)
    pd.testing.assert_frame_equal(got[list(whole.columns)], whole.sort_index(), check_dtype=False, check_index_type=False)
    for n in (1, 3):
        part = pdf[pdf["months_balance"] >= -n].drop(columns="months_balance").groupby("sk_id_prev").agg(kinds)
        part.columns = part.columns.map("_".join)
        want = (whole / part.reindex(whole.index)).sort_index()
        want.columns = [f"part_all_{c}_to_{n}M" for c in want.columns]
        pd.testing.assert_frame_equal(got[list(want.columns)], want, check_dtype=False, check_index_type=False)


def test_previous_features(spark):
    rows = [
        (1, 1, "Cash loans", 100.0, 0.0, -10, 4), (1, 2, "Cash loans", 50.0, 100.0, -15, 5),
        (2, 3, "Consumer loans", 50.0, 100.0, -3, 23), (3, 4, None, 0.0, 0.0, -1, None),
    ]
    df = spark.createDataFrame(rows, "sk_id_curr int, sk_id_prev int, name_contract_type string, amt_credit double, "
                                     "amt_application double, days_decision int, hour_appr_process_start int")
    got = by_client(applications.previous_features(df))
    assert got[1]["num_prev_cash loans"] == 2 and got[2]["num_prev_cash loans"] == 0
    assert got[1]["avg_pct_approved"] == 0.0 and got[2]["avg_pct_approved"] == 0.5 and got[3]["avg_pct_approved"] is None
    assert got[1]["avg_inq_freq"] == 12
    assert (got[1]["cnt_late_applications"], got[1]["cnt_early_applications"], got[2]["cnt_late_applications"]) == (1, 1, 1)
    assert by_client(applications.previous_features(df, fill=True))[3]["avg_pct_approved"] == 0.0


def test_payment_features(spark):
    rows = [(1, 1, -10, -8, 100.0, 50.0), (1, 1, -10, -12, 0.0, 10.0), (2, 2, -5, -5, 3.0, 1.0), (3, 3, None, -1, None, 1.0)]
    df = spark.createDataFrame(rows, "sk_id_curr int, sk_id_prev int, days_instalment int, days_entry_payment int, "
                                     "amt_instalment double, amt_payment double")
    got = by_client(applications.payment_features(df))
    assert (got[1]["cnt_late_payments"], got[1]["early_payments"], got[1]["avg_pct_instalment_paid"]) == (1, 1, INF)
    assert (got[2]["cnt_late_payments"], got[2]["early_payments"], got[2]["avg_pct_instalment_paid"]) == (0, 0, 0.333)
    assert got[3]["avg_pct_instalment_paid"] is None
    assert by_client(applications.payment_features(df, fill=True))[3]["avg_pct_instalment_paid"] == 0.0


def test_client_scalars(spark):
    rows = [(1, 18000, -3000, 2, 3, 100.0, 50.0, 200.0, None, 0.5), (2, 7305, 0, 0, 0, 80.0, 0.0, 0.0, None, None)]
    df = spark.createDataFrame(
        rows, "sk_id_curr int, days_birth int, days_id_publish int, cnt_children int, cnt_fam_members int, "
              "amt_income_total double, amt_annuity double, amt_credit double, flag_document_1 int, area_avg double")
    age = fx.id_change_age()
    got = df.select(
        fx.full_years("days_birth").alias("years"), age.alias("age"), fx.id_change_delay(age).alias("delay"),
        fx.late_id_change(age).alias("late"), fx.num_documents(df).alias("docs"), fx.building_info(df, n=1).alias("home"),
        *[c.alias(n) for n, c in fx.client_ratios().items()]).collect()
    a, b = got
    assert (a["years"], a["age"], a["delay"], a["late"]) == (49, 41, 21, 1)
    assert (b["years"], b["age"], b["delay"], b["late"]) == (20, 20, 0, 0)
    assert (a["docs"], a["home"], b["home"]) == (1, 1, 0)
    assert (a["children_per_adult"], a["inc_per_child"], a["inc_per_adult"], a["annuity_rate"]) == (2.0, 50.0, 100.0, 25.0)
    assert (b["children_per_adult"], b["inc_per_child"], b["inc_per_adult"], b["annuity_rate"]) == (None, 80.0, INF, None)


def test_group_mean_gap_uses_labelled_rows(spark):
    df = spark.createDataFrame(
        [(1, "M", "x", 10.0, 1), (2, "M", "x", 20.0, 0), (3, "M", "x", 99.0, None), (4, "F", None, 5.0, 1)],
        "id int, g string, e string, v double, target int")
    got = {r["id"]: r["composite_metric"] for r in clients.group_mean_gap(df, ["g", "e"], "v", F.col("target").isNotNull()).collect()}
    assert got == {1: -5.0, 2: 5.0, 3: 84.0, 4: None}


def test_fraud_rules_keep_unknown_rows(spark):
    rows = [
        (1, 0, 0, 0, 20000, 100, 1.0, 1.0, 0, 0, 0), (2, None, 0, 0, 20000, 100, 1.0, 1.0, 0, 0, 0),
        (3, 1, 0, 0, 7000, 1000, 1.0, 1.0, 0, 0, 0), (4, 1, 0, 0, 20000, 100, 1.0, 1.0, 2, 0, 0),
        (5, 1, 0, 0, 20000, 100, 1.0, 1.0, 1, 0, 1), (6, 1, 0, 0, 20000, 100, 21.0, 1.0, 0, 0, 0),
        (7, 1, 0, 0, 20000, 100, 20.0, 1.0, 1, 0, 0), (8, 1, 0, 0, None, None, None, None, None, None, None),
    ]
    df = spark.createDataFrame(
        rows, "id int, flag_cont_mobile int, flag_email int, flag_phone int, days_birth int, days_employed int, "
              "amt_credit double, amt_income_total double, Microloan int, cnt_closed_Microloan int, cnt_overdue_Microloan int")
    assert sorted(r["id"] for r in rel.drop_fraud(df).collect()) == [2, 7, 8]
    assert rel.drop_fraud(df, apply=False).count() == 8
    hits = {r["rule"]: r["hits"] for r in rel.fraud_rule_hits(df).collect()}
    assert list(hits.values()) == [1, 1, 1, 1, 1, 5]


def test_null_rules_of_filters(spark):
    df = spark.createDataFrame([("X",), ("0",), (None,)], "status string")
    assert sorted(map(str, (r[0] for r in rel.in_list(df, "status", ["X"], negate=True).collect()))) == ["0", "None"]
    assert [r[0] for r in rel.in_list(df, "status", ["X"]).collect()] == ["X"]
    assert rel.drop_where(df, F.col("status") == "X").count() == 2
    caps = spark.createDataFrame([(1,), (20,), (None,)], "n int")
    assert [r[0] for r in rel.cap_values(caps, {"n": 15}).collect()] == [1, 15, None]


def test_cleaning_fills(spark):
    df = spark.createDataFrame([(1, 1.0, None), (2, None, "a"), (3, 4.0, "b")], "id int, x double, t string")
    assert [r["x"] for r in cleaning.fill_nulls(df, "mean", columns=["x"]).orderBy("id").collect()] == [1.0, 2.5, 4.0]
    assert [r["x"] for r in cleaning.fill_nulls(df, "median", columns=["x"]).orderBy("id").collect()] == [1.0, 2.5, 4.0]
    filled = cleaning.fill_nulls(df).orderBy("id").collect()
    assert [(r["x"], r["t"]) for r in filled] == [(1.0, "<missing>"), (-999.0, "a"), (4.0, "b")]
    whole = spark.createDataFrame([(1,), (2,), (None,)], "n int")
    assert cleaning.fill_nulls(whole, "mean").filter("n = 1.5").count() == 1
    odd = spark.createDataFrame([(INF,), (-INF,), (1.0,)], "x double")
    assert [r[0] for r in cleaning.replace_infinite(odd, ["x"], -999).collect()] == [-999.0, -999.0, 1.0]


def test_one_hot_policies(spark):
    df = spark.createDataFrame([(1, "a", True), (2, "b", False), (3, None, True)], "id int, c string, f boolean")
    assert cleaning.one_hot(df, ["c", "f"]).columns == ["id", "c_a", "c_b", "c_nan", "f_false", "f_true"]
    assert cleaning.one_hot(df, ["c", "f"], "first").columns == ["id", "c_b", "c_nan", "f_true"]
    assert cleaning.one_hot(df, ["c", "f"], "if_binary").columns == ["id", "c_a", "c_b", "c_nan", "f_true"]
    row = cleaning.one_hot(df, ["c"]).filter("id = 3").first()
    assert (row["c_a"], row["c_b"], row["c_nan"]) == (0, 0, 1)


def test_standardize_uses_population_deviation(spark):
    df = spark.createDataFrame([(float(v), 5.0) for v in range(4)], "x double, same double")
    got = cleaning.standardize(df, ["x", "same"]).toPandas()
    x = np.arange(4.0)
    assert got["x"].to_numpy() == pytest.approx((x - x.mean()) / x.std())
    assert (got["same"] == 0).all()


def test_survey_cleaning(spark):
    rows = [("Student", 10.0, 0), ("Student", None, None), ("Businessman", None, 40), (None, 5.0, 30), ("Working", -7.0, 20), ("Working", 9.0, 21)]
    df = spark.createDataFrame(rows, "status string, income double, age int")
    got = sorted(tuple(r) for r in survey.clean_survey(df).collect())
    assert got == [("Student", 10, 26), ("Student", 10, 26), ("Working", 1, 20), ("Working", 9, 21)]


def test_whole_pipeline(spark):
    """Raw tables to a cleaned table: nothing lost but fraud, nothing missing."""
    from loanloom.plans.standin import Views

    v = Views(spark, "/root/testdata/sf0.001")
    whole = features.features_train_test(v.app, v.bur, v.bur_bal, v.cc, v.prev, v.inst)
    assert whole.count() == v.app.count()
    chosen = whole.select(
        "sk_id_curr", "target", "code_gender", "name_education_type", "amt_income_total", "amt_credit", "cnt_children",
        "days_birth", "days_employed", "flag_cont_mobile", "flag_email", "flag_phone", "Microloan", "cnt_closed_Microloan",
        "cnt_overdue_Microloan", "avg_pct_instalment_paid", "Car loan")
    clean = features.clean_table(chosen).toPandas()
    assert "car_loan" in clean.columns and 0 < len(clean) <= len(chosen.toPandas())
    assert clean.drop(columns="target").notna().all().all() and not np.isinf(clean["avg_pct_instalment_paid"]).any()
    base = features.clean_table(chosen, baseline=True)
    assert base.count() == v.app.count() and "Car loan" in base.columns


def test_bucketed_feature_sets_join_without_exchange(spark):
    from loanloom.plans.features import assemble_bucketed, features_train_test
    from loanloom.plans.standin import Views

    v = Views(spark, "/root/testdata/sf0.001")
    sources = (v.app, v.bur, v.bur_bal, v.cc, v.prev, v.inst)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        whole = assemble_bucketed(*sources, 4)
        plan = whole._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and plan.count("SortMergeJoin") == 4
        plain = features_train_test(*sources)
        assert whole.columns == plain.columns and whole.count() == plain.count() == v.app.count()
        assert whole.exceptAll(plain).count() < whole.count()  # sums of another order may differ in a last bit
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_sources_selected_side_by_side_are_selected_alike(spark):
    import numpy as np

    from loanloom.plans import selection

    rng = np.random.default_rng(8)
    rows = [(i, int(rng.random() < 0.4), float(rng.normal() + (i % 2)), float(rng.integers(0, 9)), "ab"[i % 2]) for i in range(400)]
    table = spark.createDataFrame(rows, "sk_id_curr int, target int, x double, z double, c string")
    presets = {"one": selection.Preset(), "two": selection.Preset(bootstrap=False, rule="any")}
    both = selection.select_from_sources({"one": table, "two": table.filter("z > 2")}, presets, iterations=50)
    for name, part in (("one", table), ("two", table.filter("z > 2"))):
        alone = selection.significant_features(part, presets[name], 50)
        found = both.filter(F.col("source") == name).select(alone.columns)
        assert sorted(map(tuple, found.collect())) == sorted(map(tuple, alone.collect())) and alone.count() >= 3
