"""Nested JSON log lines to flat tables.

A line is ``{"type": ..., "data": ...}``. Credits arrive one per line, cash
balances as an array of records; both hold a text field in the printed form of
a record, ``Name(KEY=value, KEY='text')``, which is parsed, never evaluated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .tables import materialized

BUREAU, POSCASH = "bureau", "POS_CASH_balance"
# Field names and types of the log records, in output order.
RECORD_FIELDS = {
    "SK_ID_CURR": "bigint", "SK_ID_BUREAU": "bigint", "CREDIT_ACTIVE": "string", "DAYS_CREDIT": "int",
    "CREDIT_DAY_OVERDUE": "int", "DAYS_CREDIT_ENDDATE": "double", "DAYS_ENDDATE_FACT": "double",
    "CNT_CREDIT_PROLONG": "int", "DAYS_CREDIT_UPDATE": "int",
}
AMOUNT_FIELDS = {
    "CREDIT_CURRENCY": "string", "AMT_CREDIT_MAX_OVERDUE": "double", "AMT_CREDIT_SUM": "double",
    "AMT_CREDIT_SUM_DEBT": "double", "AMT_CREDIT_SUM_LIMIT": "double", "AMT_CREDIT_SUM_OVERDUE": "double",
    "AMT_ANNUITY": "double",
}
POSCASH_IDS = {"SK_ID_PREV": "bigint", "SK_ID_CURR": "bigint", "NAME_CONTRACT_STATUS": "string"}


def _struct(fields: dict[str, str]) -> str:
    return ", ".join(f"{k}: {t}" for k, t in fields.items())


POSCASH_RECORD = "CNT_INSTALMENT_FUTURE: int, MONTHS_BALANCE: int, PosCashBalanceIDs: string, SK_DPD: int, SK_DPD_DEF: int"
LINE_SCHEMA = (
    "type string, data struct<CREDIT_TYPE: string, "
    f"record: struct<{_struct(RECORD_FIELDS)}, AmtCredit: string>, "
    f"CNT_INSTALMENT: int, records: array<struct<{POSCASH_RECORD}>>>, _corrupt string"
)


def printed_field(text: str | Column, key: str, dtype: str) -> Column:
    """One value out of a printed record; None and unreadable numbers are missing."""
    text = F.col(text) if isinstance(text, str) else text
    # the key is found as a plain text, then it has to begin a word; nullif evaluates its input once
    begin = rf"{key}(?<=\b{key})="
    if dtype != "string":
        raw = F.regexp_extract(text, rf"{begin}([^,)]+)", 1)
        return F.nullif(F.nullif(raw, F.lit("")), F.lit("None")).try_cast(dtype)  # a cast that fails is slow
    opened = rf"""{begin}('(?:[^'\\]++|\\.)*+(?=')|"(?:[^"\\]++|\\.)*+(?="))"""  # with the first quote, without the last
    raw = F.nullif(F.regexp_extract(text, opened, 1), F.lit(""))
    return F.regexp_replace(F.substr(raw, F.lit(2)), r"\\(.)", "$1")


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """Log lines as text; a ``value`` column, from files or any other frame that has one."""
    return spark.read.text(path)


def parse_log(lines: DataFrame) -> DataFrame:
    """``(type, data, _corrupt)``; unreadable lines keep their text in ``_corrupt``."""
    parsed = F.from_json("value", LINE_SCHEMA, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    # as a generated row the parsed line cannot be copied into every filter
    # above it, so each line is parsed once
    return lines.select(F.explode(F.array(parsed)).alias("line")).select("line.*")


def log_scan_route(lines: DataFrame) -> DataFrame:
    """Parsed lines with their ``route``: ``bureau``, ``pos_cash`` or ``rejected``.

    Unreadable lines and lines of another type are rejected; one scan serves
    every route.
    """
    fine, kind = F.col("_corrupt").isNull(), F.col("type")
    route = F.when(fine & (kind == BUREAU), "bureau").when(fine & (kind == POSCASH), "pos_cash").otherwise("rejected")
    return parse_log(lines).withColumn("route", route)


def log_bureau_flatten(routed: DataFrame) -> DataFrame:
    """Credits, 17 columns with lower-case names."""
    record, amounts = "data.record", F.col("data.record.AmtCredit")
    return routed.filter(F.col("route") == "bureau").select(
        *[F.col(f"{record}.{k}").alias(k.lower()) for k in RECORD_FIELDS],
        F.col("data.CREDIT_TYPE").alias("credit_type"),
        *[printed_field(amounts, k, t).alias(k.lower()) for k, t in AMOUNT_FIELDS.items()],
    )


def log_poscash_explode(routed: DataFrame) -> DataFrame:
    """Cash balances, one row per record of a line, 8 columns with lower-case names."""
    balances = routed.filter(F.col("route") == "pos_cash")
    rows = balances.select(F.col("data.CNT_INSTALMENT").alias("cnt_instalment"), F.explode("data.records").alias("r"))
    ids = F.col("r.PosCashBalanceIDs")
    return rows.select(
        "cnt_instalment",
        F.col("r.CNT_INSTALMENT_FUTURE").alias("cnt_instalment_future"),
        F.col("r.MONTHS_BALANCE").alias("months_balance"),
        *[printed_field(ids, k, t).alias(k.lower()) for k, t in POSCASH_IDS.items()],
        F.col("r.SK_DPD").alias("sk_dpd"),
        F.col("r.SK_DPD_DEF").alias("sk_dpd_def"),
    )


def log_export(lines: DataFrame, bureau_path: str, poscash_path: str) -> None:
    """Write both tables as CSV with upper-case headers; the text is parsed once."""
    routed = materialized(log_scan_route(lines), "log")
    for table, path in ((log_bureau_flatten(routed), bureau_path), (log_poscash_explode(routed), poscash_path)):
        table.toDF(*[c.upper() for c in table.columns]).write.mode("overwrite").option("header", True).csv(path)
