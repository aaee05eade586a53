"""Filters, joins and ordering on the lending tables; every operator takes frames and names."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.core import col, holds, ratio, whole_div

DAYS = 365


# ---- projections and filters -------------------------------------------------

def flip_sign(df: DataFrame, columns: list[str]) -> DataFrame:
    flipped = set(columns)
    return df.select(*[(-col(c)).alias(c) if c in flipped else col(c) for c in df.columns])


def with_ratio(df: DataFrame, key: str, num: Column, den: str, name: str) -> DataFrame:
    return df.select(key, ratio(num, den).alias(name))


def annuity_rate(df: DataFrame, key: str = "sk_id_curr") -> DataFrame:
    return with_ratio(df, key, col("amt_annuity"), "amt_credit", "annuity_rate")


def monthly_burden(df: DataFrame, key: str = "sk_id_curr") -> DataFrame:
    return with_ratio(df, key, col("amt_income_total") / 12, "amt_annuity", "burden")


def income_per_family_member(df: DataFrame, key: str = "sk_id_curr") -> DataFrame:
    return with_ratio(df, key, col("amt_income_total"), "cnt_fam_members", "income_per_family_member")


def owners_full_years(df: DataFrame, k: int = 10, key: str = "sk_id_curr") -> DataFrame:
    """Youngest clients that own both a car and a home, by full years of 365 days."""
    owners = df.filter(holds(col("flag_own_car")) & holds(col("flag_own_realty")))
    years = owners.select(key, whole_div("days_birth", DAYS).alias("full_years_age"))
    return years.orderBy("full_years_age", key).limit(k)


def above_average_income(df: DataFrame, k: float = 2.0) -> DataFrame:
    """Clients whose income per family member is at least ``k`` times its average."""
    per_member = ratio("amt_income_total", "cnt_fam_members")
    average = df.select(F.avg(per_member)).scalar()
    return df.filter(per_member / average >= k)


def cap_values(df: DataFrame, limits: dict[str, float]) -> DataFrame:
    """Values above a limit become the limit; missing values stay missing."""
    def capped(name: str, dtype: str) -> Column:
        if name not in limits:
            return col(name)
        hi = F.lit(limits[name]).cast(dtype)
        return F.when(col(name) > hi, hi).otherwise(col(name)).alias(name)
    return df.select(*[capped(c, t) for c, t in df.dtypes])


def drop_null_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.dropna(subset=columns)


def drop_where(df: DataFrame, condition: Column) -> DataFrame:
    """Rows for which the condition is not known to be true."""
    return df.filter(~holds(condition))


def in_list(df: DataFrame, column: str, values: list, negate: bool = False) -> DataFrame:
    """IN keeps only listed values; NOT IN also keeps missing ones."""
    listed = holds(col(column).isin(values))
    return df.filter(~listed if negate else listed)


def distinct_keys(df: DataFrame, key: str) -> DataFrame:
    return df.select(key).distinct()


def fraud_rules() -> dict[str, Column]:
    """The five rules that mark an application as fraud."""
    no_contact = (col("flag_cont_mobile") <= 0) & (col("flag_email") <= 0) & (col("flag_phone") <= 0)
    no_closed = col("cnt_closed_microloan") == 0
    return {
        "no_contacts": no_contact,
        "employed_before_18": (col("days_birth") - col("days_employed")) / DAYS < 18,
        "only_open_microloans": no_closed & (col("microloan") > 1),
        "only_overdue_microloans": no_closed & (col("cnt_overdue_microloan") >= 1),
        "credit_over_20_incomes": col("amt_credit") > col("amt_income_total") * 20,
    }


def drop_fraud(df: DataFrame, rules: dict[str, Column] | None = None, apply: bool = True) -> DataFrame:
    """Applications that no rule marks; ``apply=False`` keeps everything."""
    if not apply:
        return df
    rules = fraud_rules() if rules is None else rules
    return df.filter(~reduce(Column.__or__, [holds(r) for r in rules.values()]))


def fraud_rule_hits(df: DataFrame, rules: dict[str, Column] | None = None) -> DataFrame:
    """``(rule, hits)`` for each rule and for all together, in one pass."""
    rules = fraud_rules() if rules is None else rules
    marks = {name: holds(r) for name, r in rules.items()}
    marks["any_rule"] = reduce(Column.__or__, marks.values())
    counts = df.agg(*[F.count(F.when(m, 1)).alias(n) for n, m in marks.items()])
    cells = F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).alias("hits")) for n in marks])
    return counts.select(F.explode(cells).alias("r")).select("r.*")


# ---- joins -------------------------------------------------------------------

def join_all(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Inner join; right columns that also exist on the left get a ``_right`` ending."""
    taken = {c.lower() for c in left.columns} - {key}
    renamed = right.select(*[col(c).alias(f"{c}_right" if c.lower() in taken else c) for c in right.columns])
    return left.join(renamed, key, "inner")


def join_select(left: DataFrame, right: DataFrame, key: str, columns: list[str]) -> DataFrame:
    return left.join(right, key, "inner").select(*columns)


def loan_totals(credits: DataFrame, key: str = "sk_id_curr") -> DataFrame:
    return credits.groupBy(key).agg(
        F.count("sk_id_bureau").alias("count_loans_bki_history"), F.sum("amt_credit_sum").alias("loans_sum")
    )


def join_aggregated(clients: DataFrame, credits: DataFrame, key: str = "sk_id_curr") -> DataFrame:
    """Clients with the number and sum of their credits; credits are reduced before the join."""
    totals = loan_totals(credits, key)
    return clients.select(key, "code_gender").join(totals, key, "inner")


def category_shares(df: DataFrame, column: str, key: str) -> DataFrame:
    """Share of each category in the whole table (the total is a one-value subquery)."""
    total = df.select(F.count(col(key)).cast("double")).scalar()
    counts = df.groupBy(column).agg(F.count(col(key)).alias("_n"))
    return counts.select(column, (F.col("_n") / total).alias("rate")).orderBy(F.desc("rate"), column)


def older_without_history(df: DataFrame, history: DataFrame, key: str, years: int = 60) -> DataFrame:
    """Clients older than ``years`` full years of 365 days that the history does not know."""
    return df.filter(whole_div("days_birth", DAYS) > years).join(history.select(key).distinct(), key, "left_anti")


def without_match(df: DataFrame, other: DataFrame, key: str) -> DataFrame:
    return df.join(other.select(key).distinct(), key, "left_anti")


def often_overdue(credits: DataFrame, days: int = 61, n: int = 2, key: str = "sk_id_curr") -> DataFrame:
    """``(client, overdue count)`` of clients with at least ``n`` credits overdue ``days`` or more."""
    late = credits.filter(F.col("credit_day_overdue") >= days)
    return late.groupBy(key).agg(F.count("credit_day_overdue").alias("overdue_cnt")).filter(F.col("overdue_cnt") >= n)


def women_often_overdue(clients, credits, days: int = 61, n: int = 2, key: str = "sk_id_curr") -> DataFrame:
    return clients.filter(F.col("code_gender") == "F").join(often_overdue(credits, days, n, key), key, "left_semi")


def overdue_leaders(clients: DataFrame, credits: DataFrame, k: int = 7, key: str = "sk_id_curr") -> DataFrame:
    """Men with the largest total overdue and the sums of their active and of all credits.

    Both sums come from one aggregate over the credits.
    """
    counted = (F.col("credit_active") == "Active") & (F.col("amt_credit_sum") > 0)
    sums = credits.groupBy(key).agg(
        F.sum("amt_credit_sum").alias("sum_all_credit"),
        F.sum("amt_credit_sum_overdue").alias("sum_all_overdue"),
        F.sum(F.when(counted, F.col("amt_credit_sum"))).alias("sum_actv_credit"),
        F.sum(F.when(counted, F.col("amt_credit_sum_overdue"))).alias("sum_actv_overdue"),
    ).filter(F.col("sum_actv_credit").isNotNull())
    rate = ratio("sum_actv_overdue", "sum_actv_credit").alias("actv_overdue_rate")
    men = clients.filter(F.col("code_gender") == "M")
    joined = men.join(sums.select("*", rate), key, "inner")
    return joined.orderBy(F.desc("sum_all_overdue"), key).limit(k)


def assemble_features(base: DataFrame, features: list[DataFrame], key: str) -> DataFrame:
    """Left-join feature sets that hold one row per key; all sides hash on the same key."""
    for f in features:
        base = base.join(f, key, "left")
    return base


def bridge_keys(child: DataFrame, bridge: DataFrame, key: str, bring: list[str], how: str = "left") -> DataFrame:
    """Bring parent keys to a child table."""
    return child.join(bridge.select(key, *bring), key, how)


def attach_target(child: DataFrame, clients: DataFrame, key: str = "sk_id_curr", how: str = "left") -> DataFrame:
    joined = child.join(clients.select(key, "target"), key, how)
    return joined.filter(F.col("target").isNotNull()) if how == "left" else joined


def max_per_client(clients: DataFrame, known: DataFrame, payments: DataFrame, key: str = "sk_id_curr") -> DataFrame:
    """Column-wise maximum of the payments of known applications, left-joined to the clients."""
    # the maximum per (client, application) is taken first, so a frequent
    # application or client reaches the join as few rows
    columns = [c for c in payments.columns if c not in (key, "sk_id_prev")]
    reduced = payments.groupBy(key, "sk_id_prev").agg(*[F.max(col(c)).alias(c) for c in columns])
    kept = reduced.join(known.select("sk_id_prev"), "sk_id_prev", "left_semi")
    best = kept.groupBy(key).agg(F.max("sk_id_prev").alias("sk_id_prev"), *[F.max(col(c)).alias(c) for c in columns])
    return clients.select(key, "target").join(best, key, "left")


def semi_join_where(child: DataFrame, parent: DataFrame, key: str, where: Column) -> DataFrame:
    return child.join(parent.filter(where).select(key), key, "left_semi")


# ---- ordering and sets -------------------------------------------------------

def top_k(df: DataFrame, order: list[Column], k: int) -> DataFrame:
    return df.orderBy(*order).limit(k)


def union_all(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b, allowMissingColumns=True)


def key_set_difference(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Distinct keys of ``a`` that ``b`` lacks."""
    return a.select(key).distinct().join(b.select(key), key, "left_anti")


def column_concat(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Columns side by side, matched by key and never by position."""
    return a.join(b, key, "inner")
