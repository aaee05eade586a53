"""Queries over feature tests, splits and resampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.special import log_cdf_texts
from ..operators import cards, sampling, stats
from ..operators.sampling import MIXER, POISSON_CDF, WORD
from ..plans import selection
from ..plans.features import clean_table, features_train_test
from ..plans.standin import Views
from ..sources.tables import materialized
from .registry import query, rounded

TESTED = ["amt_credit", "amt_income_total", "days_employed", "ext_source_2"]


# ---- SQL twins of the hash and of the resampling weights ---------------------

def word_sql(id_sql: str, salt: int | str, word: int = 0) -> str:
    return f"CAST('0x' || substr(md5({id_sql} || '#{salt}'), {1 + 8 * word}, 8) AS BIGINT)"


def _mixed(source: str, x: str, keep: str, tag: str) -> str:
    """CTEs that mix column ``x`` of ``source`` into column ``u`` of ``<tag>2``."""
    def step(c: str) -> str:
        return f"(xor({c} >> 16, {c}) * {MIXER}) % {WORD}"

    return (
        f"{tag}0 AS (SELECT {keep}, {step(x)} AS y FROM {source}), "
        f"{tag}1 AS (SELECT {keep}, {step('y')} AS z FROM {tag}0), "
        f"{tag}2 AS (SELECT {keep}, xor(z >> 16, z) AS u FROM {tag}1)"
    )


def weights_sql(source: str, id_sql: str, keep: str, iterations: int, seed: int) -> str:
    """CTE list ending in ``wt``: kept columns, iter and weight w of every row and iteration."""
    cuts = " + ".join(f"CAST(v.u >= {int(p * WORD)} AS INT)" for p in POISSON_CDF)
    return (
        f"hs AS (SELECT {keep}, {word_sql(id_sql, seed, 0)} AS a, {word_sql(id_sql, seed, 1)} AS b FROM {source}), "
        f"it AS (SELECT {keep}, a, CAST(i AS INT) AS iter, (b + i) % {WORD} AS s FROM hs, range({iterations}) AS r(i)), "
        f"{_mixed('it', 's', f'{keep}, a, iter', 'p')}, "
        f"q AS (SELECT {keep}, iter, xor(a, u) AS x FROM p2), "
        f"{_mixed('q', 'x', f'{keep}, iter', 'g')}, "
        f"wt AS (SELECT {keep}, iter, {cuts} AS w FROM g2 v)"
    )


# ---- tests -------------------------------------------------------------------

@query("t_test", " UNION ALL ".join(f"""
    SELECT '{c}' AS feature, round((m0 - m1) / sqrt(((n0 - 1) * v0 + (n1 - 1) * v1) / (n0 + n1 - 2) * (1 / n0 + 1 / n1)), 4) AS t_stat,
      n0 + n1 - 2 AS dof
    FROM (SELECT CAST(count(x) FILTER (WHERE target = 0) AS DOUBLE) AS n0, CAST(count(x) FILTER (WHERE target = 1) AS DOUBLE) AS n1,
        avg(x) FILTER (WHERE target = 0) AS m0, avg(x) FILTER (WHERE target = 1) AS m1,
        var_samp(x) FILTER (WHERE target = 0) AS v0, var_samp(x) FILTER (WHERE target = 1) AS v1
      FROM (SELECT CAST({c} AS DOUBLE) AS x, target FROM app))""" for c in TESTED))
def t_test(v: Views) -> DataFrame:
    return rounded(stats.t_test(v.app, TESTED).select("feature", "t_stat", "dof"))


@query("mann_whitney", " UNION ALL ".join(f"""
    SELECT '{c}' AS feature, u AS u_stat, round(z, 4) AS z_stat, CAST(z > 1.959963984540054 AS INT) AS significant FROM (
      SELECT u, (greatest(u, n0 * n1 - u) - n0 * n1 / 2 - 0.5) / sqrt(n0 * n1 / 12 * (n0 + n1 + 1 - ties / ((n0 + n1) * (n0 + n1 - 1)))) AS z
      FROM (SELECT sum(r) FILTER (WHERE target = 0) - n0 * (n0 + 1) / 2 AS u, n0, n1, sum(k * k - 1.0) AS ties FROM (
        SELECT target, rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0::DOUBLE AS r,
          CAST(count(*) OVER (PARTITION BY {c}) AS DOUBLE) AS k,
          CAST(count(*) FILTER (WHERE target = 0) OVER () AS DOUBLE) AS n0,
          CAST(count(*) FILTER (WHERE target = 1) OVER () AS DOUBLE) AS n1
        FROM app WHERE target IS NOT NULL AND {c} IS NOT NULL) GROUP BY n0, n1))""" for c in TESTED))
def mann_whitney(v: Views) -> DataFrame:
    return rounded(stats.mann_whitney(v.app, TESTED).select("feature", "u_stat", "z_stat", "significant"))


_MOST, _LEAST = log_cdf_texts("a", "q")


@query("anderson_darling", " UNION ALL ".join(f"""
    SELECT '{c}' AS feature, target, n AS rows, round(CASE WHEN n < 42 THEN 0 ELSE a2 END, 4) AS a2_stat,
      CASE WHEN n < 42 THEN 0 ELSE critical END AS critical, n < 42 AS skipped, n < 42 OR a2 <= critical AS normal
    FROM (SELECT target, n, -n - sum((2 * i - 1) * (CASE WHEN z >= 0 THEN most ELSE least_ END)
          + (2 * (n - i) + 1) * (CASE WHEN z >= 0 THEN least_ ELSE most END)) / n AS a2,
        round(1.092 / (1 + 4.0::DOUBLE / n - 25.0::DOUBLE / (n * n)), 3) AS critical
      FROM (SELECT *, {_MOST} AS most, {_LEAST} AS least_ FROM (SELECT *, abs(z) AS a, z * z AS q FROM (
        SELECT x.target, n, row_number() OVER (PARTITION BY x.target ORDER BY v) AS i, (v - mean) / sd AS z
        FROM (SELECT target, CAST({c} AS DOUBLE) AS v FROM app WHERE target IS NOT NULL AND {c} IS NOT NULL) x
        JOIN (SELECT target, avg({c}) AS mean, stddev_samp({c}) AS sd, count({c}) AS n FROM app GROUP BY 1) m ON m.target = x.target)))
      GROUP BY target, n)""" for c in TESTED))
def anderson_darling(v: Views) -> DataFrame:
    return rounded(stats.anderson_darling(v.app, TESTED))


CATEGORIES = ["code_gender", "name_education_type", "flag_own_car"]


def _chi2_sql(feature: str) -> str:
    return f"""
    SELECT '{feature}' AS feature, round(sum((o - e) * (o - e) / e), 4) AS chi2_stat, CAST(any_value(cats) - 1 AS INT) AS dof,
      CAST(sum((o - e) * (o - e) / e) >= CASE any_value(cats) - 1 WHEN 1 THEN 3.841459 WHEN 4 THEN 9.487729 END AS INT) AS significant
    FROM (SELECT c, t, o, sum(o) OVER (PARTITION BY c) * sum(o) OVER (PARTITION BY t) / sum(o) OVER () AS e, cats
      FROM (SELECT c, t, CAST(count(a.x) AS DOUBLE) AS o, max(cats) AS cats
        FROM (SELECT DISTINCT {feature} AS c, count(*) OVER () AS cats FROM (SELECT DISTINCT {feature} FROM app WHERE {feature} IS NOT NULL)) k
        CROSS JOIN (VALUES (0), (1)) AS v(t)
        LEFT JOIN (SELECT {feature} AS f, target AS y, 1 AS x FROM app) a ON a.f = k.c AND a.y = v.t
        GROUP BY c, t))"""


@query("chi_squared", " UNION ALL ".join(_chi2_sql(f) for f in CATEGORIES))
def chi_squared(v: Views) -> DataFrame:
    found = stats.chi_squared(v.app, CATEGORIES)
    return rounded(found.select("feature", "chi2_stat", "dof", "significant"))


BOOTSTRAPPED = ["amt_credit", "ext_source_2"]


@query("bootstrap_diff", f"""
    WITH src AS (SELECT sk_id_curr, target, amt_credit, ext_source_2 FROM app WHERE target IS NOT NULL),
    {weights_sql('src', 'sk_id_curr', 'target, amt_credit, ext_source_2', 1000, 123)},
    m AS ({' UNION ALL '.join(f'''SELECT '{c}' AS feature, target, iter,
        sum(w * {c}) / sum(CASE WHEN {c} IS NOT NULL THEN w END) AS mean FROM wt GROUP BY target, iter''' for c in BOOTSTRAPPED)}),
    o AS (SELECT feature, target, mean, row_number() OVER (PARTITION BY feature, target ORDER BY mean) AS k FROM m),
    d AS (SELECT feature, k, max(mean) FILTER (WHERE target = 1) - max(mean) FILTER (WHERE target = 0) AS diff FROM o GROUP BY 1, 2),
    e AS (SELECT feature, diff, row_number() OVER (PARTITION BY feature ORDER BY diff) - 1 AS place FROM d),
    f AS (SELECT feature, round(max(diff) FILTER (WHERE place = 25), 3) AS ci_low, round(max(diff) FILTER (WHERE place = 975), 3) AS ci_high
        FROM e GROUP BY 1)
    SELECT *, CASE WHEN 0.001 BETWEEN ci_low AND ci_high OR abs(ci_low) <= 0.001 OR abs(ci_high) <= 0.001 THEN 0 ELSE 1 END AS significant
    FROM f""")
def bootstrap_diff(v: Views) -> DataFrame:
    return stats.bootstrap_diff(v.app, "sk_id_curr", BOOTSTRAPPED)


@query("ci_verdict", """
    SELECT sk_id_curr, CASE WHEN (lo <= 0.001 AND hi >= 0.001) OR least(abs(lo), abs(hi)) <= 0.001 THEN 0 ELSE 1 END AS verdict
    FROM (SELECT sk_id_curr, round(proba_a - 0.5, 3) AS lo, round(proba_a - 0.5 + proba_b / 10, 3) AS hi FROM scored)""")
def ci_verdict(v: Views) -> DataFrame:
    lo = F.round(F.col("proba_a") - 0.5, 3)
    hi = F.round(F.col("proba_a") - 0.5 + F.col("proba_b") / 10, 3)
    return v.scored.select("sk_id_curr", stats.ci_verdict(lo, hi).alias("verdict"))


@query("bootstrap_ci_by_group", f"""
    WITH src AS (SELECT row_id, status, income FROM hw WHERE status IS NOT NULL),
    {weights_sql('src', 'row_id', 'status, income', 10_000, 123)},
    m AS (SELECT status, iter, sum(w * income) / sum(CASE WHEN income IS NOT NULL THEN w END) AS mean FROM wt GROUP BY 1, 2)
    SELECT status, round(quantile_cont(r, 0.025), 4) AS ci_low, round(quantile_cont(r, 0.975), 4) AS ci_high,
      round(avg(mean), 4) AS boot_mean
    FROM (SELECT status, mean, CAST(round(CAST(mean AS DECIMAL(18, 9)), 2) AS DOUBLE) AS r FROM m) GROUP BY 1""")
def bootstrap_ci_by_group(v: Views) -> DataFrame:
    return rounded(stats.bootstrap_ci_by_group(v.hw, "row_id", "status", "income"))


@query("bootstrap_model_gap", f"""
    WITH {weights_sql('scored', 'sk_id_curr', 'proba_a', 10_000, 123)},
    ma AS (SELECT iter, sum(w * proba_a) / sum(w) AS a FROM wt GROUP BY 1),
    second AS (WITH {weights_sql('scored', 'sk_id_curr', 'proba_b', 10_000, 124)}
      SELECT iter, sum(w * proba_b) / sum(w) AS b FROM wt GROUP BY 1),
    g AS (SELECT a, b, a - b AS gap FROM ma JOIN second USING (iter))
    SELECT round(avg(a), 6) AS mean_a, round(avg(b), 6) AS mean_b, round(quantile_cont(gap, 0.025), 6) AS ci_low,
      round(quantile_cont(gap, 0.975), 6) AS ci_high,
      CAST(quantile_cont(gap, 0.025) > 0 OR quantile_cont(gap, 0.975) < 0 AS INT) AS significant FROM g""")
def bootstrap_model_gap(v: Views) -> DataFrame:
    return rounded(stats.bootstrap_model_gap(v.scored, "sk_id_curr", "proba_a", "proba_b"), 6)


@query("feature_vote", """
    SELECT credit_type AS feature, round(avg(CAST(credit_active = 'Active' AS INT)), 6) AS share,
      CAST(2 * count(*) FILTER (WHERE credit_active = 'Active') > count(*) AS INT) AS keep FROM bur GROUP BY 1""")
def feature_vote(v: Views) -> DataFrame:
    votes = v.bur.select(F.col("credit_type").alias("feature"), (F.col("credit_active") == "Active").cast("int").alias("vote"))
    return rounded(stats.feature_vote(votes), 6)


@query("significant_features")
def significant_features(v: Views) -> DataFrame:
    """All seven source selections, at the reference's 1000 resamples."""
    profiles = cards.six_stat_profile(v.cc, "sk_id_prev", ["amt_balance", "amt_drawings", "cnt_drawings"])
    tables = selection.source_tables(v.app, v.bur, v.bur_bal, profiles, v.prev, v.inst, v.pos)
    return selection.select_from_sources(tables)


@query("compose_features")
def compose_features(v: Views) -> DataFrame:
    """Assembly of every feature, then the selection over all of them."""
    whole = features_train_test(v.app, v.bur, v.bur_bal, v.cc, v.prev, v.inst)
    return selection.compose_features(whole)


@query("clean_features")
def clean_features(v: Views) -> DataFrame:
    """Assembly, then the whole cleaning with the fraud filter."""
    whole = features_train_test(v.app, v.bur, v.bur_bal, v.cc, v.prev, v.inst)
    return clean_table(materialized(whole, "assembled"))


LIMITED = ["amt_credit", "amt_annuity", "days_employed", "ext_source_1"]
_WHOLE = LIMITED[:3]
_LIMITS = "WITH q AS (SELECT " + ", ".join(
    f"quantile_cont({c}, 0.05) AS {c}_l, quantile_cont({c}, 0.75) AS {c}_h" for c in _WHOLE) + " FROM app)"
_COEF = 0.25


def _bounds(c: str) -> tuple[str, str]:
    return f"{c}_l - {_COEF} * ({c}_h - {c}_l)", f"{c}_h + {_COEF} * ({c}_h - {c}_l)"


@query("find_outliers", _LIMITS + " UNION ALL ".join(f"""
    SELECT '{c}' AS column_name, round(any_value({_bounds(c)[0]}), 4) AS lower_limit, round(any_value({_bounds(c)[1]}), 4) AS upper_limit,
      count(*) FILTER (WHERE {c} < {_bounds(c)[0]} OR {c} > {_bounds(c)[1]}) AS n_outliers FROM app, q""" for c in _WHOLE)
    + " UNION ALL SELECT 'ext_source_1', NULL, NULL, 0")
def find_outliers(v: Views) -> DataFrame:
    return rounded(stats.find_outliers(v.app, LIMITED, 0.05, 0.75, _COEF))


_INSIDE = " AND ".join(f"{c} BETWEEN {_bounds(c)[0]} AND {_bounds(c)[1]}" for c in _WHOLE)


@query("drop_outliers", _LIMITS + f"""
    SELECT sk_id_curr, amt_credit, round(amt_annuity, 4) AS amt_annuity, days_employed, ext_source_1 FROM app, q WHERE {_INSIDE}""")
def drop_outliers(v: Views) -> DataFrame:
    df = v.app.select("sk_id_curr", *LIMITED)
    limits = stats.find_outliers(df, LIMITED, 0.05, 0.75, _COEF)
    return rounded(stats.drop_outliers(df, limits))


@query("null_outliers", _LIMITS + "SELECT sk_id_curr, " + ", ".join(
    f"CASE WHEN {_INSIDE} THEN {f'round({c}, 4)' if c != 'days_employed' else c} END AS {c}" for c in LIMITED) + " FROM app, q")
def null_outliers(v: Views) -> DataFrame:
    df = v.app.select("sk_id_curr", *LIMITED)
    limits = stats.find_outliers(df, LIMITED, 0.05, 0.75, _COEF)
    return rounded(stats.drop_outliers(df, limits, "null"))


# ---- splits ------------------------------------------------------------------

@query("random_split", f"""
    SELECT sk_id_curr, CASE WHEN {word_sql('sk_id_curr', 42)} < {round(0.3 * WORD)} THEN 'test' ELSE 'train' END AS split FROM app""")
def random_split(v: Views) -> DataFrame:
    return sampling.random_split(v.app.select("sk_id_curr"), "sk_id_curr")


_RANKED = f"""
    WITH h AS (SELECT sk_id_curr, target, {word_sql('sk_id_curr', 123)} AS word FROM app),
    r AS (SELECT sk_id_curr, target, row_number() OVER (PARTITION BY target ORDER BY word, sk_id_curr) AS place,
        count(*) OVER (PARTITION BY target) AS n FROM h)
"""


@query("stratified_split", _RANKED + """
    SELECT sk_id_curr, target, CASE WHEN target IS NULL THEN NULL WHEN place <= floor(n * 0.6::DOUBLE) THEN 'train'
      WHEN place <= floor(n * 0.8::DOUBLE) THEN 'validation' ELSE 'test' END AS split FROM r""")
def stratified_split(v: Views) -> DataFrame:
    ratios = {"train": 0.6, "validation": 0.2, "test": 0.2}
    return sampling.stratified_split(v.app.select("sk_id_curr", "target"), "sk_id_curr", "target", ratios)


@query("stratified_sample", _RANKED + """
    SELECT sk_id_curr, target FROM r WHERE target IS NOT NULL AND place <= floor(n * 0.03::DOUBLE)""")
def stratified_sample(v: Views) -> DataFrame:
    return sampling.stratified_sample(v.app.select("sk_id_curr", "target"), "sk_id_curr", "target", 0.03)


@query("stratified_folds", _RANKED + """
    SELECT sk_id_curr, target, CASE WHEN target IS NOT NULL THEN CAST(place > floor(n * 0.2::DOUBLE) AS INT)
      + CAST(place > floor(n * 0.4::DOUBLE) AS INT) + CAST(place > floor(n * 0.6::DOUBLE) AS INT)
      + CAST(place > floor(n * 0.8::DOUBLE) AS INT) END AS fold FROM r""")
def stratified_folds(v: Views) -> DataFrame:
    return sampling.stratified_folds(v.app.select("sk_id_curr", "target"), "sk_id_curr", "target", 5)


@query("resample", f"""
    WITH src AS (SELECT * FROM app WHERE target IS NOT NULL),
    {weights_sql('src', 'sk_id_curr', 'sk_id_curr, target', 1, 123)}
    SELECT sk_id_curr, target, CAST(unnest(range(1, w + 1)) AS INT) AS copy FROM wt""")
def resample(v: Views) -> DataFrame:
    return sampling.resample(v.app.select("sk_id_curr", "target"), "sk_id_curr", "target")


