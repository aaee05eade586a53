"""The whole feature table and its cleaning, checked column by column at full width."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.core import col, is_categorical
from ..operators import cards
from ..plans.features import assemble_bucketed, clean_table, features_train_test
from ..plans.standin import Views, columns
from ..sources.tables import materialized
from .features import CARD_COLUMNS, LOAN_TYPES, _DPD, _profile_sql, _ratio_sql
from .registry import ORACLES, query
from .sources import TYPES, _BOOL, _TEXT

DIGITS = {"weighted_ext_scores": 4, "composite_metric": 4}  # of the check texts; 6 for all other fractions

# the check text of a feature query, and what an absent value becomes where a set fills its gaps
_PARTS: list[tuple[str, list[str], bool]] = [
    ("num_documents", ["num_documents"], False), ("full_years", ["age_years"], False), ("id_change_age", ["id_change_age"], False),
    ("id_change_delay", ["id_age_change_diff", "flag_late_id_change"], False),
    ("client_ratios", ["annuity_to_income_rate", "children_per_adult", "inc_per_child", "inc_per_adult", "annuity_rate"], False),
    ("source_presence_score", ["weighted_ext_scores"], False), ("group_mean_gap", ["composite_metric"], False),
    ("late_early_payments", ["cnt_late_payments", "early_payments"], True), ("avg_pct_paid", ["avg_pct_instalment_paid"], True),
    ("max_overdue", ["max_overdue_amt"], False), ("min_nonzero_overdue", ["min_overdue_amt"], False), ("active_overdue_rate", ["actv_overdue_rate"], False),
    ("count_by_type_pivot", list(TYPES), False), ("overdue_by_type_pivot", [f"cnt_overdue_{t}" for t in TYPES], False),
    ("closed_by_type_pivot", [f"cnt_closed_{t}" for t in TYPES], False), ("open_month_count", ["cnt_open_credits"], False),
    ("closed_month_count", ["cnt_closed_credits"], False), ("dpd_pivot", [f"cnt_overdue_{d}_dpd" for d in _DPD], False),
    ("balance_row_count", ["cnt_credits"], False),
    ("status_rates", ["rate_closed_credits", "rate_open_credits", *[f"rate_{d}_dpd" for d in _DPD]], False),
    ("last_closed_days", ["diff_last_closed_credit"], False),
    ("last_active_age", ["days_since_last_actv_credit", "months_since_last_actv_credit"], False),
    ("prev_by_contract_pivot", [f"num_prev_{t.lower()}" for t in LOAN_TYPES], True), ("avg_pct_approved", ["avg_pct_approved"], True),
    ("inquiry_freq", ["avg_inq_freq"], True), ("applications_by_daypart", [f"cnt_{p}_applications" for p in ("early", "daytime", "afterwork", "late")], True),
]
_CARDS = [f"{c}_{s}" for c in CARD_COLUMNS for s in cards.STATS] + [
    f"part_all_{c}_{s}_to_{n}M" for n in cards.PERIODS for c in CARD_COLUMNS for s in cards.STATS]


def _quoted(c: str) -> str:
    return f'"{c}"'


def _part_sql(name: str, names: list[str], filled: bool) -> str:
    cells = ", ".join(f"coalesce({_quoted(c)}, 0) AS {_quoted(c)}" if filled else _quoted(c) for c in names)
    return f"LEFT JOIN (SELECT sk_id_curr, {cells} FROM ({ORACLES[name]})) USING (sk_id_curr)"


_CARDS_SQL = (
    "SELECT sk_id_curr, " + ", ".join(f"avg({_quoted(c)}) AS {_quoted(c)}" for c in _CARDS) + " FROM (SELECT *, " + ", ".join(
        f'{_ratio_sql(f"{c}_{s}", f"{c}_{s}_{n}", None)} AS "part_all_{c}_{s}_to_{n}M"' for n in cards.PERIODS for c in CARD_COLUMNS for s in cards.STATS)
    + " FROM (SELECT sk_id_prev, " + ", ".join(
        [_profile_sql("TRUE", "")] + [_profile_sql(f"months_balance BETWEEN -{n} AND -1", f"_{n}") for n in cards.PERIODS])
    + " FROM cc GROUP BY 1)) JOIN (SELECT sk_id_prev, sk_id_curr FROM prev) USING (sk_id_prev) WHERE sk_id_curr IS NOT NULL GROUP BY 1")
_FEATURES = [n for _, names, _ in _PARTS for n in names] + ["building_info"] + _CARDS
_COLUMNS = [*columns("app"), *_FEATURES]
_NUMBERS = [c for c in _COLUMNS if c not in _TEXT | _BOOL]
# fewer than 30 of the columns named like parts of a building are missing, as there are only two
_WHOLE = ("whole AS MATERIALIZED (SELECT * REPLACE (" + ", ".join(
    f"round({_quoted(c)}, 6) AS {_quoted(c)}" for c in (*_CARDS, "amt_income_total", "amt_credit", "amt_annuity", "ext_source_1", "ext_source_2", "ext_source_3", "area_avg", "area_mode"))
    + ") FROM (SELECT *, 1 AS building_info FROM app " + " ".join(_part_sql(*p) for p in _PARTS)
    + f" LEFT JOIN ({_CARDS_SQL}) USING (sk_id_curr)))")


def _cell_sql(c: str) -> str:
    return f"CAST({f'length({_quoted(c)})' if c in _TEXT else f'CAST({_quoted(c)} AS INT)' if c in _BOOL else _quoted(c)} AS DOUBLE) AS {_quoted(c)}"


def _sums_sql(table: str, names: dict[str, str]) -> str:
    """Rows (column_name, n_known, n_infinite, total) of a table; ``names`` are the columns and what they are called."""
    called = "CASE column_name " + " ".join(f"WHEN '{c}' THEN '{n}'" for c, n in names.items()) + " END"
    return (
        f"SELECT {called} AS column_name, count(value) AS n_known, count(*) FILTER (WHERE isinf(value)) AS n_infinite, "
        "round(CAST(coalesce(sum(CASE WHEN NOT isinf(value) THEN CAST(value AS DECIMAL(38, 6)) END), 0) AS DOUBLE), 3) AS total "
        f"FROM (SELECT {', '.join(_cell_sql(c) for c in names)} FROM {table}) "
        f"UNPIVOT INCLUDE NULLS (value FOR column_name IN ({', '.join(_quoted(c) for c in names)})) GROUP BY 1")


def column_sums(df: DataFrame) -> DataFrame:
    """(column_name, n_known, n_infinite, total) of every column in one aggregate; texts count their characters.

    Totals are sums of decimals, so the order of rows does not matter.
    """
    parts = []
    for i, (c, kind) in enumerate(df.dtypes):
        x = F.char_length(col(c)) if kind == "string" else col(c).cast("int") if is_categorical(kind) else col(c)
        x = x.cast("double")
        endless = F.abs(x) == float("inf")
        total = F.sum(F.when(~endless, x.cast("decimal(38,6)")))
        parts.append(F.struct(
            F.lit(c).alias("column_name"), F.count(x).alias("n_known"), F.count(F.when(endless, 1)).alias("n_infinite"),
            F.round(F.coalesce(total.cast("double"), F.lit(0.0)), 3).alias("total")).alias(f"_{i}"))
    return df.agg(*parts).select(F.explode(F.array(*[f"_{i}" for i in range(len(parts))])).alias("r")).select("r.*")


def _to_digits(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(col(c), DIGITS.get(c, 6)).alias(c) if t == "double" else col(c) for c, t in df.dtypes])


@query("assemble_full", f"WITH {_WHOLE} {_sums_sql('whole', {c: c for c in _COLUMNS})}")
def assemble_full(v: Views) -> DataFrame:
    """Every column of the assembled table, from feature sets kept bucketed by client."""
    buckets = int(v.spark.conf.get("spark.sql.shuffle.partitions"))
    return column_sums(_to_digits(assemble_bucketed(v.app, v.bur, v.bur_bal, v.cc, v.prev, v.inst, buckets)))


_LIMITED = [c for c in _NUMBERS if c not in ("sk_id_curr", "target")]
_CAPS = {"amt_income_total": 500_000, "cnt_children": 15}


def _cleaned_sql(c: str) -> str:
    if c in ("sk_id_curr", "target") or c in _BOOL:
        return _quoted(c)
    if c in _TEXT:
        return f"coalesce({_quoted(c)}, '<missing>') AS {_quoted(c)}"
    x = f"CASE WHEN NOT outside THEN {_quoted(c)} END"
    if c == "days_employed":
        x = f"-({x})"
    if c in _CAPS:
        x = f"CASE WHEN ({x}) > {_CAPS[c]} THEN {_CAPS[c]} ELSE ({x}) END"
    x = f"coalesce({x}, -999)"
    if c == "avg_pct_instalment_paid":
        x = f"CASE WHEN isinf({x}) THEN -999 ELSE {x} END"
    return f"{x} AS {_quoted(c)}"


_CLEANED = f"""{_WHOLE},
    q AS (SELECT target IS NULL AS half, {', '.join(
        f'CASE WHEN count({_quoted(c)}) = count(*) THEN quantile_cont({_quoted(c)}, {p}) END AS {_quoted(f"{c} {p}")}' for c in _LIMITED for p in (0.05, 0.95))}
      FROM whole GROUP BY 1),
    marked AS (SELECT whole.*, {' OR '.join(
        f'coalesce({_quoted(c)} < {_quoted(f"{c} 0.05")} - 1.5::DOUBLE * ({_quoted(f"{c} 0.95")} - {_quoted(f"{c} 0.05")})'
        f' OR {_quoted(c)} > {_quoted(f"{c} 0.95")} + 1.5::DOUBLE * ({_quoted(f"{c} 0.95")} - {_quoted(f"{c} 0.05")}), FALSE)' for c in _LIMITED)} AS outside
      FROM whole JOIN q ON (target IS NULL) = half),
    cleaned AS (SELECT {', '.join(_cleaned_sql(c) for c in _COLUMNS)} FROM marked),
    kept AS (SELECT * FROM cleaned WHERE NOT (
      (flag_cont_mobile <= 0 AND flag_email <= 0 AND flag_phone <= 0) OR (days_birth - days_employed) / 365.0::DOUBLE < 18
      OR ("cnt_closed_Microloan" = 0 AND "Microloan" > 1) OR ("cnt_closed_Microloan" = 0 AND "cnt_overdue_Microloan" >= 1)
      OR amt_credit > amt_income_total * 20))"""


def _snake(c: str) -> str:
    return "".join(x if x.isascii() and x.isalnum() else "_" for x in c).lower()


@query("clean_full", f"WITH {_CLEANED} {_sums_sql('kept', {c: _snake(c) for c in _COLUMNS})}")
def clean_full(v: Views) -> DataFrame:
    """Every column of the cleaned table: limits, signs, caps, filled gaps, fraud rules and names."""
    whole = features_train_test(v.app, v.bur, v.bur_bal, v.cc, v.prev, v.inst)
    return column_sums(clean_table(materialized(_to_digits(whole), "assembled")))
