"""Readers, writers and the log parser."""

import json

import pytest
from pyspark.sql import functions as F

from loanloom.catalog.registry import QUERIES
from loanloom.operators import cleaning, quality
from loanloom.sources import logs, tables


def test_log_files(spark, tmp_path):
    amount = "AmtCredit(CREDIT_CURRENCY='currency 1', AMT_CREDIT_MAX_OVERDUE=None, AMT_CREDIT_SUM=1.5e3, " \
             "AMT_CREDIT_SUM_DEBT=0.0, AMT_CREDIT_SUM_LIMIT=nope, AMT_CREDIT_SUM_OVERDUE=-2.0, AMT_ANNUITY=7)"
    tricky = r"""AmtCredit(CREDIT_CURRENCY='it\'s, (odd)=1', AMT_CREDIT_SUM=2.0)"""
    quoted = '''AmtCredit(CREDIT_CURRENCY="it's", AMT_CREDIT_SUM=3.0)'''
    def credit(i, printed):
        return {"type": "bureau", "data": {"CREDIT_TYPE": "Microloan", "record": {
            "SK_ID_CURR": i, "SK_ID_BUREAU": 10 + i, "CREDIT_ACTIVE": "Active", "DAYS_CREDIT": -5, "CREDIT_DAY_OVERDUE": 0,
            "DAYS_CREDIT_ENDDATE": 1.0, "DAYS_ENDDATE_FACT": None, "CNT_CREDIT_PROLONG": 0, "DAYS_CREDIT_UPDATE": -1,
            "AmtCredit": printed}}}
    def record(month):
        return {"CNT_INSTALMENT_FUTURE": 3, "MONTHS_BALANCE": month, "SK_DPD": 0, "SK_DPD_DEF": 0,
                "PosCashBalanceIDs": f"PosCashBalanceIDs(SK_ID_PREV=7, SK_ID_CURR=8, NAME_CONTRACT_STATUS={'None' if month == -2 else repr('Active')})"}
    lines = [credit(1, amount), credit(2, tricky), credit(3, quoted),
             {"type": "POS_CASH_balance", "data": {"CNT_INSTALMENT": 12, "records": [record(-1), record(-2)]}},
             {"type": "POS_CASH_balance", "data": {"CNT_INSTALMENT": 6, "records": []}}, {"type": "else"}]
    path = tmp_path / "in.log"
    path.write_text("\n".join(json.dumps(x) for x in lines) + "\n{broken\n")
    text = logs.read_log(spark, str(path))
    routed = logs.log_scan_route(text)
    counts = {r["route"]: r["count"] for r in routed.groupBy("route").count().collect()}
    assert counts == {"bureau": 3, "pos_cash": 2, "rejected": 2}
    a, b, c = logs.log_bureau_flatten(routed).orderBy("sk_id_curr").collect()
    assert len(a) == 17
    assert (a["credit_currency"], a["amt_credit_max_overdue"], a["amt_credit_sum"], a["amt_credit_sum_limit"], a["amt_annuity"]) == \
        ("currency 1", None, 1500.0, None, 7.0)
    assert (a["credit_type"], a["days_enddate_fact"], a["amt_credit_sum_overdue"]) == ("Microloan", None, -2.0)
    assert (b["credit_currency"], b["amt_credit_sum"]) == ("it's, (odd)=1", 2.0)
    assert (c["credit_currency"], c["amt_credit_sum"], c["amt_annuity"]) == ("it's", 3.0, None)
    rows = logs.log_poscash_explode(routed).orderBy(F.desc("months_balance")).collect()
    assert [(r["cnt_instalment"], r["months_balance"], r["sk_id_prev"], r["name_contract_status"]) for r in rows] == \
        [(12, -1, 7, "Active"), (12, -2, 7, None)]
    logs.log_export(text, str(tmp_path / "a"), str(tmp_path / "b"))
    assert spark.read.option("header", True).csv(str(tmp_path / "a")).columns[0] == "SK_ID_CURR"
    assert spark.read.option("header", True).csv(str(tmp_path / "b")).count() == 2


def test_printed_fields_are_searched_once(spark):
    texts = [r"R(XK='x', K='a\'b')", "R(K='')", 'R(K="it\'s")', "R(K=None)", r"R(K='open\')", "R(XK=3, K=4)", "R(K=4.5x)", ""]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").repartition(1)
    found = rows.select("i", logs.printed_field("t", "K", "string").alias("s"), logs.printed_field("t", "K", "bigint").alias("n"))
    assert [(r["s"], r["n"]) for r in found.orderBy("i").collect()] == [
        ("a'b", None), ("", None), ("it's", None), (None, None), (None, None), (None, 4), (None, None), (None, None)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("regexp_extract") == 2


def test_log_functions_take_a_stream(spark, tmp_path):
    """Parsing is row by row, so the same functions serve a stream of log files."""
    (tmp_path / "x.log").write_text('{"type": "bureau", "data": {"CREDIT_TYPE": "c", "record": {"SK_ID_CURR": 5}}}\n')
    stream = logs.log_bureau_flatten(logs.log_scan_route(spark.readStream.text(str(tmp_path))))
    run = stream.writeStream.format("memory").queryName("credits_in").trigger(availableNow=True).option(
        "checkpointLocation", tables.new_path(spark, "stream")).start()
    run.awaitTermination(60)
    assert [r["sk_id_curr"] for r in spark.table("credits_in").collect()] == [5]


def test_csv_reader(spark, tmp_path):
    (tmp_path / "t.csv").write_text("Unnamed: 0,STATUS,Income\n0,a,1.5\n1,,NaN\n")
    df = tables.scan_csv(spark, str(tmp_path / "t.csv"), drop=["Unnamed: 0"])
    assert df.columns == ["status", "income"]
    assert [tuple(r) for r in df.collect()] == [("a", 1.5), (None, None)]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1.0, 2), (3.0, 4)], "x double, id int")
    path = tables.sink_feature_file(df, str(tmp_path / "f"), "id", "csv")
    assert spark.read.option("header", True).csv(path).columns == ["id", "x"]
    tables.sink_table_replace(df, "sink_test", str(tmp_path / "t"))
    assert tables.sink_table_replace(df.filter("id = 2"), "sink_test", str(tmp_path / "t")).count() == 1
    back = tables.materialized(df)
    assert back.schema == df.schema and back.count() == 2


def test_narrow_types(spark):
    rows = [(0, 5, 1.0, 0.5, 70000, "Y", "t", 3.5), (1, 6, 2.0, 40000.5, 1, "N", "Y", -3.5), (None, None, None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "flag long, small long, whole double, frac double, big long, yn string, t string, near double")
    plan = cleaning.narrow_type_plan(df)
    assert plan == {"flag": "boolean", "small": "smallint", "whole": "smallint", "frac": "float", "big": "int",
                    "yn": "boolean", "t": "string", "near": "float"}
    assert cleaning.narrow_type_plan(df, reference_order=True)["near"] == "smallint"
    row = cleaning.narrow_types(df, plan).first()
    assert (row["flag"], row["yn"], row["t"]) == (False, True, "t")


def test_names(spark):
    df = spark.createDataFrame([(1, 2)], "`Cash loans-A` int, `B c` int")
    assert cleaning.snake_case_columns(df).columns == ["cash_loans_a", "b_c"]
    assert cleaning.snake_case_columns(df, "punctuation").columns == ["Cash loans_A", "B c"]
    with pytest.raises(ValueError):
        cleaning.snake_case_columns(spark.createDataFrame([(1, 2)], "`a b` int, a_b int"))


def test_checks(spark):
    a = spark.createDataFrame([(1, 1.0), (2, 1.0), (3, None)], "id int, x double")
    b = spark.createDataFrame([(1,), (1,), (9,), (None,)], "id int")
    got = {(r["table_name"], r["column_name"]): r["is_unique"] for r in quality.unique_columns({"a": a, "b": b}).collect()}
    assert got == {("a", "id"): True, ("a", "x"): False, ("b", "id"): False}
    check = quality.fk_subset_check({"b_in_a": (b, a, "id"), "a_in_a": (a, a, "id")})
    assert {tuple(r) for r in check.collect()} == {("b_in_a", 1, False), ("a_in_a", 0, True)}
    assert quality.fk_drop_orphans(b, a, "id").count() == 2
    assert quality.filled_columns(a, 0.7) == (["id"], []) and quality.filled_columns(a, 0.5)[0] == ["id", "x"]
    profile = {r["column_name"]: r for r in quality.table_profile(a).collect()}
    assert profile["id"]["q50"] == 2.0 and profile["x"]["n_missing"] == 1 and profile["x"]["std"] == 0.0


def test_a_table_is_replaced_as_a_whole_or_not_at_all(spark, tmp_path):
    name, path = "replaced_table", str(tmp_path / "t")
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    rows = spark.range(100).withColumn("v", F.col("id") * 2)
    assert tables.sink_table_replace(rows, name, path).count() == 100
    bad = rows.withColumn("v", F.when(F.col("id") == 70, F.raise_error(F.lit("no"))).otherwise(F.col("v")).cast("long"))
    with pytest.raises(Exception, match="no"):
        tables.sink_table_replace(bad, name, path)
    assert spark.table(name).agg(F.sum("v")).first()[0] == 9900
    for left in (50, 20):  # from itself, twice
        assert tables.sink_table_replace(spark.table(name).filter(f"id < {left}"), name, path).count() == left
    assert len(list((tmp_path / "t").glob("version-*"))) == 1
    other = tables.sink_table_replace(spark.table(name).select("id", F.lit("x").alias("w")), name, path)
    assert other.columns == ["id", "w"] and other.count() == 20
    assert tables.sink_table_replace(other.limit(0), name, path).count() == 0
    spark.sql(f"DROP TABLE {name}")


def test_bucketed_tables_join_without_exchange(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        a = tables.bucketed(spark.range(1000).withColumn("x", F.col("id") % 7), "id", 4)
        b = tables.bucketed(spark.range(0, 2000, 2).withColumn("y", F.lit(1)), "id", 4)
        joined = a.join(b, "id", "left")
        assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
        assert joined.count() == 1000 and joined.filter("y = 1").count() == 500
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_the_log_that_is_routed_is_written_compressed(spark, tmp_path, monkeypatch):
    folder = tmp_path / "data"
    spark.range(300).selectExpr(
        "id AS o_orderkey", "id % 40 AS o_custkey", "'O' AS o_orderstatus", "CAST(id AS DOUBLE) AS o_totalprice", "'1-URGENT' AS o_orderpriority",
    ).write.parquet(f"{folder}/orders.parquet")
    spark.range(900).selectExpr(
        "id % 300 AS l_orderkey", "id AS l_partkey", "id % 7 AS l_suppkey", "CAST(1 AS DOUBLE) AS l_extendedprice", "CAST(0 AS DOUBLE) AS l_discount", "'O' AS l_linestatus",
    ).write.parquet(f"{folder}/lineitem.parquet")
    monkeypatch.setattr(tables, "new_path", lambda spark, name: str(tmp_path / name))
    counts = {r["route"]: r["n"] for r in QUERIES["log_scan_route"](spark, str(folder)).collect()}
    assert counts == {"bureau": 300, "pos_cash": 900, "rejected": 43}
    lines = spark.read.text(str(tmp_path / "log"))
    plain = lines.selectExpr("sum(octet_length(value) + 1)").first()[0]
    assert lines.count() == 1243 and sum(f.stat().st_size for f in (tmp_path / "log").glob("part-*")) < plain / 2
