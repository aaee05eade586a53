"""Lending tables derived from the driver's test tables.

Each view is a source and an ordered mapping of column to SQL expression that
Spark and DuckDB both accept, so a query and its check read the same table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

_LINES = "lineitem JOIN orders ON l_orderkey = o_orderkey"

VIEWS: dict[str, tuple[str, dict[str, str]]] = {
    "app": ("customer", {
        "sk_id_curr": "c_custkey",
        "target": "CASE WHEN c_custkey % 5 = 4 THEN NULL WHEN c_acctbal + (c_custkey % 7) * 400 < 3000 THEN 1 ELSE 0 END",
        "code_gender": "CASE WHEN c_nationkey % 2 = 0 THEN 'M' ELSE 'F' END",
        "name_education_type": "CASE WHEN c_custkey % 29 = 0 THEN NULL ELSE c_mktsegment END",
        "amt_income_total": "CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE 20000 + (c_acctbal + 1000) * 40 END",
        "amt_credit": "CAST(50000 + (c_custkey % 97) * 100000 AS DOUBLE)",
        "amt_annuity": "CAST(50000 + (c_custkey % 97) * 100000 AS DOUBLE) / (10 + c_custkey % 20)",
        "cnt_children": "CAST(c_custkey % 4 AS INT)",
        "cnt_fam_members": "CAST(c_custkey % 4 + 1 + c_custkey % 2 AS INT)",
        "days_birth": "CAST(7300 + (c_custkey * 37) % 18000 AS INT)",
        "days_employed": "CAST((c_custkey * 53) % 9000 AS INT)",
        "days_id_publish": "CAST(-((c_custkey * 11) % 6000) AS INT)",
        "flag_own_car": "c_custkey % 3 = 0",
        "flag_own_realty": "c_custkey % 2 = 0",
        "flag_cont_mobile": "CAST(CASE WHEN c_custkey % 6 = 0 THEN 0 ELSE 1 END AS INT)",
        "flag_email": "CAST(c_custkey % 2 AS INT)",
        "flag_phone": "CAST(CASE WHEN c_custkey % 3 = 0 THEN 0 ELSE 1 END AS INT)",
        "flag_document_2": "CAST(c_custkey % 2 AS INT)",
        "flag_document_3": "CAST(c_custkey % 3 % 2 AS INT)",
        "ext_source_1": "CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE CAST(c_custkey % 100 AS DOUBLE) / 100 END",
        "ext_source_2": "CASE WHEN c_custkey % 31 = 0 THEN NULL ELSE CAST((c_custkey * 3) % 101 AS DOUBLE) / 100 END",
        "ext_source_3": "CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE CAST((c_custkey * 9) % 100 AS DOUBLE) / 100 END",
        "area_avg": "CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_acctbal END",
        "area_mode": "CASE WHEN c_custkey % 2 = 0 THEN NULL ELSE c_acctbal END",
    }),
    "bur": ("orders", {
        "sk_id_curr": "o_custkey",
        "sk_id_bureau": "o_orderkey",
        "credit_active": "CASE o_orderstatus WHEN 'O' THEN 'Active' WHEN 'F' THEN 'Closed' ELSE 'Sold' END",
        "credit_type": "CASE o_orderpriority WHEN '1-URGENT' THEN 'Microloan' WHEN '2-HIGH' THEN 'Car loan' "
                       "WHEN '3-MEDIUM' THEN 'Consumer credit' WHEN '4-NOT SPECIFIED' THEN 'Mortgage' ELSE 'Credit card' END",
        "credit_currency": "CASE WHEN o_orderkey % 50 = 0 THEN 'currency 2' ELSE 'currency 1' END",
        "days_credit": "CAST(-((o_orderkey * 31) % 2900) - 1 AS INT)",
        "credit_day_overdue": "CAST(CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 120 ELSE 0 END AS INT)",
        "amt_credit_sum": "CASE WHEN o_orderkey % 17 = 0 THEN NULL WHEN o_orderkey % 19 = 0 THEN CAST(0 AS DOUBLE) ELSE o_totalprice END",
        "amt_credit_sum_overdue": "CAST(CASE WHEN o_orderkey % 9 = 0 THEN (o_orderkey % 120) * 10 ELSE 0 END AS DOUBLE)",
        "amt_credit_max_overdue": "CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE "
                                  "CAST(CASE WHEN o_orderkey % 4 = 0 THEN o_orderkey % 200 ELSE 0 END AS DOUBLE) END",
    }),
    "bur_bal": ("lineitem", {
        "sk_id_bureau": "CASE WHEN l_partkey % 50 = 0 THEN -l_orderkey - 1 ELSE l_orderkey END",
        "months_balance": "CAST(-(l_suppkey % 60) - 1 AS INT)",
        "status": "CASE l_partkey % 8 WHEN 6 THEN 'C' WHEN 7 THEN 'X' ELSE CAST(l_partkey % 8 AS VARCHAR(2)) END",
    }),
    "cc": ("events", {
        "sk_id_prev": "user_id",
        "sk_id_curr": "(user_id * 3) % 150",
        "months_balance": "CAST(-(event_id % 12) - 1 AS INT)",
        "name_contract_status": "event_type",
        "amt_balance": "value",
        "amt_drawings": "CASE WHEN event_id % 11 = 0 THEN NULL ELSE value * (event_id % 4) END",
        "cnt_drawings": "CAST(event_id % 6 AS INT)",
    }),
    "prev": ("orders", {
        "sk_id_prev": "o_orderkey",
        "sk_id_curr": "o_custkey",
        "name_contract_type": "CASE o_orderstatus WHEN 'O' THEN 'Cash loans' WHEN 'F' THEN 'Consumer loans' ELSE 'Revolving loans' END",
        "amt_application": "CASE WHEN o_orderkey % 23 = 0 THEN CAST(0 AS DOUBLE) ELSE o_totalprice END",
        "amt_credit": "o_totalprice * (8 + o_orderkey % 5) / 10",
        "days_decision": "CAST(-((o_orderkey * 17) % 2900) - 1 AS INT)",
        "hour_appr_process_start": "CAST((o_orderkey * 7) % 24 AS INT)",
    }),
    "inst": (_LINES, {
        "sk_id_prev": "l_orderkey",
        "sk_id_curr": "o_custkey",
        "days_instalment": "CAST(-(l_partkey % 900) - 1 AS INT)",
        "days_entry_payment": "CAST(-(l_partkey % 900) - 1 + (l_suppkey % 7 - 4) AS INT)",
        "amt_instalment": "CASE WHEN l_partkey % 101 = 0 THEN CAST(0 AS DOUBLE) ELSE l_extendedprice END",
        "amt_payment": "l_extendedprice * (1 - l_discount)",
    }),
    "pos": (_LINES, {
        "cnt_instalment": "CAST(12 + l_partkey % 24 AS INT)",
        "cnt_instalment_future": "CAST(l_partkey % 12 AS INT)",
        "months_balance": "CAST(-(l_suppkey % 60) - 1 AS INT)",
        "sk_id_prev": "l_orderkey",
        "sk_id_curr": "o_custkey",
        "name_contract_status": "CASE l_linestatus WHEN 'O' THEN 'Active' ELSE 'Completed' END",
        "sk_dpd": "CAST(CASE WHEN l_partkey % 9 = 0 THEN l_partkey % 30 ELSE 0 END AS INT)",
        "sk_dpd_def": "0",
    }),
    "hw": ("customer", {
        "row_id": "c_custkey",
        "status": "CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'Working' WHEN 'BUILDING' THEN 'Businessman' "
                  "WHEN 'FURNITURE' THEN 'Pensioner' WHEN 'HOUSEHOLD' THEN 'Student' ELSE NULL END",
        "income": "CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE c_acctbal END",
        "age": "CASE WHEN c_custkey % 9 = 0 THEN NULL WHEN c_custkey % 10 = 0 THEN 0 ELSE CAST(18 + c_custkey % 60 AS INT) END",
        "date": "DATE '2023-01-01' + CAST(c_custkey % 180 AS INT)",
    }),
    "scored": ("customer", {
        "sk_id_curr": "c_custkey",
        "target": "CAST(c_custkey % 5 % 2 AS INT)",
        "proba_a": "CAST((c_custkey * 7919) % 1000 AS DOUBLE) / 1000",
        "proba_b": "CAST((c_custkey * 104729) % 1000 AS DOUBLE) / 1000",
        "age_years": "CAST(20 + (c_custkey * 7) % 50 AS INT)",
        "days_employed": "CAST((c_custkey * 53) % 4000 AS INT)",
        "amt_income_total": "CAST(((c_custkey * 41) % 300) * 1000 AS DOUBLE)",
        "amt_credit": "CAST(c_custkey % 10 AS DOUBLE)",
        "car_loan": "CAST(c_custkey % 3 AS INT)",
        "mortgage": "CAST(c_custkey % 4 AS INT)",
        "ext_source_2": "CAST(c_custkey % 2 AS DOUBLE)",
        "microloan": "CAST(c_custkey % 5 AS INT)",
    }),
}


def columns(view: str) -> list[str]:
    return list(VIEWS[view][1])


def view_sql(view: str) -> str:
    source, cells = VIEWS[view]
    return f"SELECT {', '.join(f'{e} AS {c}' for c, e in cells.items())} FROM {source}"


class Views:
    """The stand-in views, or the driver's own tables, of one data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name not in VIEWS:
            raise AttributeError(name)
        source, cells = VIEWS[name]
        if source == _LINES:
            frame = self.table("lineitem").join(
                self.table("orders"), F.col("l_orderkey") == F.col("o_orderkey")
            )
        else:
            frame = self.table(source)
        return frame.selectExpr(*[f"{e} AS {c}" for c, e in cells.items()])
