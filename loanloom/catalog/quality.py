"""Queries over the checks."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators import quality
from ..plans.standin import Views, columns
from .registry import query, rounded
from .sources import _BOOL, _TEXT


_TABLES = ("app", "bur", "bur_bal", "cc", "prev", "inst", "pos")


@query("unique_columns", " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, '{c}' AS column_name, count(*) AS n_rows, count(*) - count({c}) AS n_missing, "
    f"count(DISTINCT {c}) = count(*) AS is_unique FROM {t}"
    for t in _TABLES for c in columns(t)))
def unique_columns(v: Views) -> DataFrame:
    return quality.unique_columns({t: getattr(v, t) for t in _TABLES})


RELATIONS = {
    "bur_in_app": ("bur", "app", "sk_id_curr"),
    "prev_in_app": ("prev", "app", "sk_id_curr"),
    "bur_bal_in_bur": ("bur_bal", "bur", "sk_id_bureau"),
    "cc_in_prev": ("cc", "prev", "sk_id_prev"),
    "inst_in_prev": ("inst", "prev", "sk_id_prev"),
    "pos_in_prev": ("pos", "prev", "sk_id_prev"),
}


@query("fk_subset_check", " UNION ALL ".join(
    f"SELECT '{name}' AS relation, count(DISTINCT {key}) AS n_orphans, count(DISTINCT {key}) = 0 AS ok "
    f"FROM {child} WHERE {key} NOT IN (SELECT {key} FROM {parent})"
    for name, (child, parent, key) in RELATIONS.items()))
def fk_subset_check(v: Views) -> DataFrame:
    return quality.fk_subset_check({
        n: (getattr(v, child), getattr(v, parent), key) for n, (child, parent, key) in RELATIONS.items()
    })


@query("fk_drop_orphans", """
    SELECT b.* FROM bur_bal b WHERE EXISTS (SELECT 1 FROM bur WHERE bur.sk_id_bureau = b.sk_id_bureau)""")
def fk_drop_orphans(v: Views) -> DataFrame:
    return quality.fk_drop_orphans(v.bur_bal, v.bur, "sk_id_bureau")


def _kind(c: str) -> str:
    return "categorical" if c in _TEXT | _BOOL else "numerical"


IGNORED = ("sk_id_curr", "target")


@query("null_ratio_select", "SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, round(count({c}) / CAST(count(*) AS DOUBLE), 4) AS share, '{_kind(c)}' AS kind FROM app"
    for c in columns("app") if c not in IGNORED) + ") WHERE share >= 0.7")
def null_ratio_select(v: Views) -> DataFrame:
    return rounded(quality.null_ratio_select(v.app, 0.7, IGNORED))


@query("column_kinds", "SELECT * FROM (VALUES " + ", ".join(
    f"('{c}', '{_kind(c)}')" for c in columns("app") if c not in IGNORED) + ") AS t(column_name, kind)")
def column_kinds(v: Views) -> DataFrame:
    return quality.column_kinds_table(v.app, IGNORED)


PROFILED = [c for c in columns("app") if _kind(c) == "numerical"]


@query("table_profile", " UNION ALL ".join(f"""
    SELECT '{c}' AS column_name, count({c}) AS n, count(*) - count({c}) AS n_missing,
      round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, round(CAST(min({c}) AS DOUBLE), 4) AS min,
      round(CAST(quantile_cont({c}, 0.25) AS DOUBLE), 4) AS q25, round(CAST(quantile_cont({c}, 0.5) AS DOUBLE), 4) AS q50,
      round(CAST(quantile_cont({c}, 0.75) AS DOUBLE), 4) AS q75, round(CAST(max({c}) AS DOUBLE), 4) AS max
    FROM app""" for c in PROFILED))
def table_profile(v: Views) -> DataFrame:
    return rounded(quality.table_profile(v.app, PROFILED))


@query("null_count", """
    SELECT status, count(*) - count(income) AS income_missing, count(*) - count(age) AS age_missing
    FROM hw GROUP BY status""")
def null_count(v: Views) -> DataFrame:
    return quality.null_count(v.hw, ["income", "age"], by="status")


@query("distinct_values", "SELECT DISTINCT status FROM hw")
def distinct_values(v: Views) -> DataFrame:
    return quality.distinct_values(v.hw, "status")
