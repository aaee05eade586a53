"""Queries over readers and writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..operators import bureau, cleaning
from ..operators.lookup import dealt
from ..plans.standin import Views, columns
from ..sources import logs, tables
from .registry import query


@query("scan_csv", "SELECT row_id, status, income, age, date FROM hw")
def scan_csv(v: Views) -> DataFrame:
    path = tables.new_path(v.spark, "survey-csv")
    hw = v.hw
    junk = F.col("row_id").alias("Index")
    hw.select(junk, *[F.col(c).alias(c.upper()) for c in hw.columns]).write.option("header", True).csv(path)
    schema = "Index long, ROW_ID long, STATUS string, INCOME double, AGE int, DATE date"
    return tables.scan_csv(v.spark, path, schema, drop=["Index"])


@query("scan_table", "SELECT * FROM customer")
def scan_table(v: Views) -> DataFrame:
    return tables.scan_table(v.spark, "customer", v.folder)


_SCANNED = ("app", "bur", "bur_bal", "cc", "prev", "inst", "pos", "hw")


def _cells(view: str) -> str:
    known = " + ".join(f"count({c})" for c in columns(view))
    return f"SELECT '{view}' AS name, count(*) AS n_rows, {known} AS n_known FROM {view}"


@query("scan_every_table", " UNION ALL ".join(_cells(t) for t in _SCANNED))
def scan_every_table(v: Views) -> DataFrame:
    out = None
    for name in _SCANNED:
        frame = getattr(v, name)
        known = sum((F.count(F.col(c)) for c in frame.columns), F.lit(0))
        part = frame.agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("n_rows"), known.cast("long").alias("n_known"))
        out = part if out is None else out.unionByName(part)
    return out


_SQL_TEXT = """
    SELECT c_mktsegment, n_name, count(*) AS orders, round(sum(o_totalprice), 2) AS total, max(l.lines) AS most_lines
    FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey
      JOIN (SELECT l_orderkey, count(*) AS lines FROM lineitem GROUP BY l_orderkey) l ON l_orderkey = o_orderkey
    GROUP BY c_mktsegment, n_name HAVING count(*) > 3"""


@query("sql_over_views", _SQL_TEXT)
def sql_over_views(v: Views) -> DataFrame:
    tables.register_views(v.spark, v.folder, ["customer", "nation", "orders", "lineitem"])
    return v.spark.sql(_SQL_TEXT)


@query("sink_feature_file", """
    SELECT sk_id_curr, max(amt_credit_sum_overdue) AS max_overdue_amt FROM bur GROUP BY sk_id_curr""")
def sink_feature_file(v: Views) -> DataFrame:
    features = bureau.credit_features(v.bur, None, ["max_overdue_amt"], types=[])
    path = tables.sink_feature_file(features, tables.new_path(v.spark, "features"), "sk_id_curr")
    return v.spark.read.parquet(path)


@query("sink_table_replace", """
    SELECT sk_id_curr, target, ext_source_1, ext_source_2, ext_source_3 FROM app WHERE target IS NOT NULL""")
def sink_table_replace(v: Views) -> DataFrame:
    kept = v.app.select("sk_id_curr", "target", "ext_source_1", "ext_source_2", "ext_source_3")
    path = tables.new_path(v.spark, "features-table")
    tables.sink_table_replace(kept, "features_train_test", path)
    return tables.sink_table_replace(kept.filter("target IS NOT NULL"), "features_train_test", path)


# ---- logs built from the credit and cash balance views -----------------------

def _printed(name: str, fields: dict[str, Column]) -> Column:
    parts = []
    for key, value in fields.items():
        parts += [F.lit(f"{', ' if parts else ''}{key}="), F.coalesce(value.cast("string"), F.lit("None"))]
    return F.concat(F.lit(f"{name}("), *parts, F.lit(")"))


def _quoted(c: str) -> Column:
    return F.concat(F.lit("'"), F.col(c), F.lit("'"))


def credit_lines(bur: DataFrame) -> DataFrame:
    none = F.lit(None).cast("string")
    amounts = _printed("AmtCredit", {
        "CREDIT_CURRENCY": _quoted("credit_currency"),
        "AMT_CREDIT_MAX_OVERDUE": F.col("amt_credit_max_overdue"),
        "AMT_CREDIT_SUM": F.col("amt_credit_sum"),
        "AMT_CREDIT_SUM_DEBT": none,
        "AMT_CREDIT_SUM_LIMIT": F.lit(0.0),
        "AMT_CREDIT_SUM_OVERDUE": F.col("amt_credit_sum_overdue"),
        "AMT_ANNUITY": none,
    })
    record = F.struct(
        F.col("sk_id_curr").alias("SK_ID_CURR"), F.col("sk_id_bureau").alias("SK_ID_BUREAU"),
        F.col("credit_active").alias("CREDIT_ACTIVE"), F.col("days_credit").alias("DAYS_CREDIT"),
        F.col("credit_day_overdue").alias("CREDIT_DAY_OVERDUE"),
        (F.col("days_credit") + 365).cast("double").alias("DAYS_CREDIT_ENDDATE"),
        F.lit(None).cast("double").alias("DAYS_ENDDATE_FACT"), F.lit(0).alias("CNT_CREDIT_PROLONG"),
        (F.col("days_credit") + 10).alias("DAYS_CREDIT_UPDATE"), amounts.alias("AmtCredit"),
    )
    data = F.struct(F.col("credit_type").alias("CREDIT_TYPE"), record.alias("record"))
    return dealt(bur).select(F.to_json(F.struct(F.lit(logs.BUREAU).alias("type"), data.alias("data"))).alias("value"))


def balance_lines(pos: DataFrame) -> DataFrame:
    """Two records per line: the row itself and the month before it."""
    ids = _printed("PosCashBalanceIDs", {
        "SK_ID_PREV": F.col("sk_id_prev"), "SK_ID_CURR": F.col("sk_id_curr"),
        "NAME_CONTRACT_STATUS": _quoted("name_contract_status"),
    })

    def record(shift: int) -> Column:
        return F.struct(
            F.col("cnt_instalment_future").alias("CNT_INSTALMENT_FUTURE"),
            (F.col("months_balance") - shift).alias("MONTHS_BALANCE"), ids.alias("PosCashBalanceIDs"),
            F.col("sk_dpd").alias("SK_DPD"), F.col("sk_dpd_def").alias("SK_DPD_DEF"),
        )

    data = F.struct(F.col("cnt_instalment").alias("CNT_INSTALMENT"), F.array(record(0), record(1)).alias("records"))
    return dealt(pos).select(F.to_json(F.struct(F.lit(logs.POSCASH).alias("type"), data.alias("data"))).alias("value"))


@query("log_scan_route", """
    SELECT 'bureau' AS route, count(*) AS n FROM bur
    UNION ALL SELECT 'pos_cash', count(*) FROM pos
    UNION ALL SELECT 'rejected', count(*) FROM bur WHERE sk_id_bureau % 7 = 0""")
def log_scan_route(v: Views) -> DataFrame:
    path = tables.new_path(v.spark, "log")
    broken = v.bur.filter("sk_id_bureau % 7 = 0").select(
        F.when(F.col("sk_id_bureau") % 2 == 0, F.concat(F.lit('{"type": "bureau", "data": '), F.col("sk_id_bureau")))
        .otherwise(F.lit('{"type": "other", "data": {}}')).alias("value")
    )
    credit_lines(v.bur).unionByName(balance_lines(v.pos)).unionByName(broken).write.text(path, compression="snappy")
    routed = logs.log_scan_route(logs.read_log(v.spark, path))
    return routed.groupBy("route").agg(F.count(F.lit(1)).alias("n"))


@query("log_bureau_flatten", """
    SELECT sk_id_curr, sk_id_bureau, credit_active, days_credit, credit_day_overdue,
           CAST(days_credit + 365 AS DOUBLE) AS days_credit_enddate, CAST(NULL AS DOUBLE) AS days_enddate_fact,
           0 AS cnt_credit_prolong, days_credit + 10 AS days_credit_update, credit_type, credit_currency,
           amt_credit_max_overdue, amt_credit_sum, CAST(NULL AS DOUBLE) AS amt_credit_sum_debt,
           CAST(0 AS DOUBLE) AS amt_credit_sum_limit, amt_credit_sum_overdue, CAST(NULL AS DOUBLE) AS amt_annuity
    FROM bur""")
def log_bureau_flatten(v: Views) -> DataFrame:
    return logs.log_bureau_flatten(logs.log_scan_route(credit_lines(v.bur)))


@query("log_poscash_explode", """
    SELECT cnt_instalment, cnt_instalment_future, months_balance - s.shift AS months_balance, sk_id_prev,
           sk_id_curr, name_contract_status, sk_dpd, sk_dpd_def
    FROM pos, (VALUES (0), (1)) AS s(shift)""")
def log_poscash_explode(v: Views) -> DataFrame:
    return logs.log_poscash_explode(logs.log_scan_route(balance_lines(v.pos)))


@query("log_export", """
    SELECT 'bureau' AS file, count(*) AS n, count(amt_credit_sum) AS n_known FROM bur
    UNION ALL SELECT 'pos_cash', 2 * count(*), 2 * count(sk_dpd) FROM pos""")
def log_export(v: Views) -> DataFrame:
    lines = credit_lines(v.bur).unionByName(balance_lines(v.pos))
    a, b = tables.new_path(v.spark, "bureau-csv"), tables.new_path(v.spark, "pos-csv")
    logs.log_export(lines, a, b)

    def summary(path: str, name: str, column: str) -> DataFrame:
        table = v.spark.read.option("header", True).csv(path)
        return table.agg(F.count(F.lit(1)).alias("n"), F.count(column).alias("n_known")).select(
            F.lit(name).alias("file"), "n", "n_known")

    return summary(a, "bureau", "AMT_CREDIT_SUM").unionByName(summary(b, "pos_cash", "SK_DPD"))


@query("labelled_split", """
    SELECT sk_id_curr, CASE WHEN target IS NULL THEN 'test' ELSE 'train' END AS part, target = 1 AS target FROM app""")
def labelled_split(v: Views) -> DataFrame:
    train, test = cleaning.labelled_split(v.app.select("sk_id_curr", "target"), cast="boolean")
    return train.withColumn("part", F.lit("train")).unionByName(
        test.withColumn("part", F.lit("test")), allowMissingColumns=True)


_TEXT = {"code_gender", "name_education_type"}
_BOOL = {"flag_own_car", "flag_own_realty"}


def _narrow_sql(view: str) -> str:
    parts = []
    for c in columns(view):
        if c in _BOOL:
            rule = "'boolean'"
        elif c in _TEXT:
            rule = f"CASE WHEN count(DISTINCT {c}) = 2 AND bool_and({c} IN ('Y', 'N')) THEN 'boolean' ELSE 'string' END"
        else:
            rule = f"""CASE WHEN min({c}) = 0 AND max({c}) = 1 AND count(DISTINCT {c}) = 2 THEN 'boolean'
                WHEN NOT bool_and({c} = round({c})) THEN 'float'
                WHEN min({c}) >= -32768 AND max({c}) <= 32767 THEN 'smallint' ELSE 'int' END"""
        parts.append(f"SELECT '{c}' AS column_name, max(x) AS new_type FROM (SELECT {rule} AS x FROM {view})"
                     if c not in _BOOL else f"SELECT '{c}' AS column_name, 'boolean' AS new_type")
    return " UNION ALL ".join(parts)


@query("narrow_types", _narrow_sql("app"))
def narrow_types(v: Views) -> DataFrame:
    return cleaning.narrow_type_table(v.app)


@query("bool_from_text", "SELECT sk_id_curr, flag_own_car, flag_own_realty FROM app")
def bool_from_text(v: Views) -> DataFrame:
    flags = ["flag_own_car", "flag_own_realty"]
    text = v.app.select("sk_id_curr", *[F.col(c).cast("int").cast("string").alias(c) for c in flags])
    return cleaning.bool_from_text(text, flags)


TYPES = ["Car loan", "Consumer credit", "Credit card", "Microloan", "Mortgage"]


@query("snake_case_columns", "SELECT sk_id_curr, " + ", ".join(
    f"count(*) FILTER (WHERE credit_active = 'Closed' AND credit_type = '{t}') AS cnt_closed_{t.lower().replace(' ', '_')}"
    for t in TYPES) + " FROM bur GROUP BY sk_id_curr")
def snake_case_columns(v: Views) -> DataFrame:
    return cleaning.snake_case_columns(bureau.type_count_features(v.bur, "cnt_closed_"))


