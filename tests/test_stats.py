"""Feature tests against direct computations on small tables."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from loanloom.functions import special
from loanloom.operators import ordered, stats
from loanloom.plans import selection


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(900):
        t = None if i % 10 == 0 else int(i % 4 == 0)
        normal = float(rng.normal(loc=0.0 if not t else 0.4))
        tied = float(rng.integers(0, 6) + (t or 0))
        flat = float(rng.random())
        rows.append((i, t, normal, None if i % 13 == 0 else tied, flat, "ab"[int(rng.random() < 0.5)], str(rng.integers(0, 3) + (t or 0))))
    schema = "id int, target int, normal double, tied double, flat double, c string, d string"
    return spark.createDataFrame(rows, schema).repartition(5).cache()


def labelled(table, c):
    pdf = table.toPandas()
    pdf = pdf[pdf["target"].notna() & pdf[c].notna()]
    return pdf[pdf["target"] == 0][c].to_numpy(), pdf[pdf["target"] == 1][c].to_numpy()


def test_tail_probabilities():
    assert special.two_sided_student(2.0, 10) == pytest.approx(0.07338803477074039, rel=1e-10)
    assert special.two_sided_student(1.959963984540054, 1e7) == pytest.approx(0.05, rel=1e-5)
    assert special.chi2_tail(7.814727903251179, 3) == pytest.approx(0.05, rel=1e-10)
    assert special.chi2_tail(1.0, 1) == pytest.approx(math.erfc(math.sqrt(0.5)), rel=1e-12)
    assert special.two_sided_normal(1.959963984540054) == pytest.approx(0.05, rel=1e-10)


def test_normal_distribution_as_column_arithmetic(spark):
    import duckdb

    texts = special.log_cdf_texts("a", "q")
    points = [0.0, 1e-9, 0.3, 1.0, 2.0, 2.4999, 2.5, 2.5001, 3.0, 5.0, 6.0, 9.0, 20.0, 37.0]
    rows = spark.createDataFrame([(x, x * x) for x in points], "a double, q double").selectExpr("a", f"{texts[0]} AS most", f"{texts[1]} AS least").collect()
    for a, most, least in rows:
        assert least == pytest.approx(math.log(math.erfc(a / math.sqrt(2)) / 2), rel=1e-11)
        assert most == pytest.approx(math.log1p(-math.erfc(a / math.sqrt(2)) / 2), rel=1e-12, abs=1.2e-16)
        assert duckdb.sql(f"SELECT {texts[0]}, {texts[1]} FROM (SELECT {a!r}::DOUBLE AS a, {a * a!r}::DOUBLE AS q)").fetchall()[0] == pytest.approx((most, least), rel=1e-11, abs=1.2e-16)
    far = spark.sql("SELECT 40e0 AS a, 1600e0 AS q").selectExpr(texts[1]).first()[0]
    assert far == pytest.approx(-804.608442013754, rel=1e-12)


def test_t_test(table):
    got = {r["feature"]: r for r in stats.t_test(table, ["normal", "tied", "flat"]).collect()}
    for c in got:
        a, b = labelled(table, c)
        pooled = ((len(a) - 1) * a.var(ddof=1) + (len(b) - 1) * b.var(ddof=1)) / (len(a) + len(b) - 2)
        t = (a.mean() - b.mean()) / math.sqrt(pooled * (1 / len(a) + 1 / len(b)))
        assert got[c]["t_stat"] == pytest.approx(t)
        assert got[c]["significant"] == int(got[c]["p_value"] < 0.05)
    assert got["tied"]["significant"] == 1


@pytest.mark.parametrize("limit", [10**6, 10])
def test_mann_whitney(table, monkeypatch, limit):
    monkeypatch.setattr(stats, "GROUP_ROWS", limit)
    monkeypatch.setattr(ordered, "SLICE_ROWS", 40)
    got = {r["feature"]: r for r in stats.mann_whitney(table, ["normal", "tied", "flat"]).collect()}
    for c in got:
        a, b = labelled(table, c)
        u = sum((x > b).sum() + (x == b).sum() / 2 for x in a)
        assert got[c]["u_stat"] == pytest.approx(u)
        n1, n2 = len(a), len(b)
        _, k = np.unique(np.concatenate([a, b]), return_counts=True)
        n = n1 + n2
        s = math.sqrt(n1 * n2 / 12 * (n + 1 - (k**3 - k).sum() / (n * (n - 1))))
        z = (max(u, n1 * n2 - u) - n1 * n2 / 2 - 0.5) / s
        assert got[c]["z_stat"] == pytest.approx(z)
        assert got[c]["p_value"] == pytest.approx(min(1.0, math.erfc(z / math.sqrt(2))))


@pytest.mark.parametrize("limit", [10**6, 10])
def test_anderson_darling(table, monkeypatch, limit):
    monkeypatch.setattr(stats, "GROUP_ROWS", limit)
    monkeypatch.setattr(ordered, "SLICE_ROWS", 40)
    for r in stats.anderson_darling(table, ["normal", "tied", "flat"]).collect():
        x = np.sort(labelled(table, r["feature"])[r["target"]])
        n = len(x)
        w = (x - x.mean()) / x.std(ddof=1)
        i = np.arange(1, n + 1)
        low, high = (np.log([math.erfc(s * v / math.sqrt(2)) / 2 for v in w]) for s in (-1, 1))
        a2 = -n - np.sum((2 * i - 1) / n * (low + high[::-1]))
        assert r["a2_stat"] == pytest.approx(a2, rel=1e-9)
        assert not r["skipped"] and r["normal"] == (a2 <= r["critical"])
    normal = {r["feature"]: r["normal"] for r in stats.normal_features(table, ["normal", "flat"]).collect()}
    assert normal == {"normal": True, "flat": False}


def test_anderson_darling_needs_no_python(table):
    plan = stats.anderson_darling(table, ["normal", "flat"])._jdf.queryExecution().toString()
    assert "ArrowEvalPython" not in plan and "BatchEvalPython" not in plan


def test_small_groups_count_as_normal(table):
    few = table.filter("id < 60")
    rows = stats.anderson_darling(few, ["flat"]).collect()
    small = [r for r in rows if r["rows"] < 42]
    assert small and all(r["skipped"] and r["normal"] and r["a2_stat"] == 0 for r in small)


@pytest.mark.parametrize("mode", ["standard", "reference"])
def test_chi_squared(table, mode):
    got = {r["feature"]: r for r in stats.chi_squared(table, ["c", "d"], table=mode).collect()}
    pdf = table.toPandas().dropna(subset=["target"])
    for c in got:
        rows = []
        for _, part in pdf.groupby(c):
            n0, n1 = int((part["target"] == 0).sum()), int((part["target"] == 1).sum())
            pct = round(round(n1 / (n0 + n1), 4) * 100, 2)
            rows.append([n0, n1] if mode == "standard" else [n0, n1, n0 + n1, pct])
        o = np.array(rows, dtype=float)
        e = o.sum(1, keepdims=True) * o.sum(0, keepdims=True) / o.sum()
        assert got[c]["chi2_stat"] == pytest.approx(((o - e) ** 2 / e).sum(), rel=1e-6)
        assert got[c]["dof"] == (o.shape[0] - 1) * (o.shape[1] - 1)
    assert got["d"]["significant"] == 1


def test_verdict(spark):
    cases = [(-1.0, 1.0, 0), (0.5, 0.9, 1), (-0.9, -0.5, 1), (-0.9, 0.0, 0), (0.001, 0.9, 0), (0.002, 0.9, 1), (-0.9, -0.001, 0)]
    df = spark.createDataFrame(cases, "lo double, hi double, want int")
    assert df.filter(stats.ci_verdict("lo", "hi") != F.col("want")).count() == 0


def test_vote_rules(spark):
    votes = spark.createDataFrame([("a", 1), ("a", 0), ("b", 1), ("b", 1), ("c", 0), ("c", 0)], "feature string, vote int")
    def kept(rule):
        return {r["feature"] for r in stats.feature_vote(votes, rule).filter("keep = 1").collect()}
    assert kept(">") == {"b"} and kept(">=") == {"a", "b"} and kept("any") == {"a", "b"}


def test_bootstrap_finds_the_shift(table):
    got = {r["feature"]: r for r in stats.bootstrap_diff(table, "id", ["tied", "flat"], iterations=400).collect()}
    a, b = labelled(table, "tied")
    assert got["tied"]["ci_low"] <= b.mean() - a.mean() + 0.01 and got["tied"]["ci_high"] >= b.mean() - a.mean() - 0.01
    assert got["tied"]["significant"] == 1
    wide = {r["feature"]: r for r in stats.bootstrap_diff(table, "id", ["tied", "flat"], iterations=400, paired="independent").collect()}
    assert wide["flat"]["ci_high"] - wide["flat"]["ci_low"] > got["flat"]["ci_high"] - got["flat"]["ci_low"]


def test_group_interval_covers_the_mean(table):
    rows = stats.bootstrap_ci_by_group(table, "id", "c", "flat", 300).collect()
    means = {r["c"]: r["m"] for r in table.groupBy("c").agg(F.avg("flat").alias("m")).collect()}
    for r in rows:
        assert r["ci_low"] < means[r["c"]] < r["ci_high"]


def test_outliers(spark):
    rows = [(i, float(i % 10), 5.0 if i % 2 else None) for i in range(100)] + [(100, 500.0, 1.0)]
    df = spark.createDataFrame(rows, "id int, x double, holes double")
    limits = stats.find_outliers(df, ["x", "holes"])
    got = {r["column_name"]: r for r in limits.collect()}
    x = df.toPandas()["x"]
    q1, q3 = np.quantile(x, [0.25, 0.75])
    assert (got["x"]["lower_limit"], got["x"]["upper_limit"]) == (q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1))
    assert got["x"]["n_outliers"] == 1 and got["holes"]["lower_limit"] is None
    assert stats.drop_outliers(df, limits).count() == 100
    kept = stats.drop_outliers(df, limits, "null")
    assert kept.count() == 101
    assert kept.filter("id = 100").first().asDict() == {"id": 100, "x": None, "holes": None}


def test_selection(table):
    preset = selection.Preset(fill="median", ignore=("id", "target"), row_id="id")
    rows = selection.significant_features(table, preset, iterations=200).collect()
    tests = {(r["feature"], r["test"]) for r in rows}
    assert ("normal", "t_test") in tests and ("flat", "mann_whitney") in tests and ("d", "chi_squared") in tests
    keep = {r["feature"]: r["keep"] for r in rows}
    assert keep["tied"] == 1 and keep["d"] == 1


def test_selection_runs_its_tests_once(table):
    """Votes are read twice, by the vote and by the result; the resamples behind them are not drawn again."""
    preset = selection.Preset(fill="median", ignore=("id", "target"), row_id="id")
    found = selection.significant_features(table, preset, iterations=20)
    assert "MapInPandas" not in found._jdf.queryExecution().executedPlan().toString()
