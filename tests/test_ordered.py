"""Ranks and quantiles against numpy, with and without slices."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loanloom.operators import cards, ordered, survey


@pytest.fixture(scope="module")
def skewed(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(6000):
        key = "hot" if i % 3 else f"k{i % 50}"
        x = float(rng.choice([0.0, 1.0, rng.normal(), rng.lognormal(3, 2)]))
        rows.append((i, key, None if i % 17 == 0 else x, float(i % 7)))
    return spark.createDataFrame(rows, "id int, k string, x double, y double").repartition(7).cache()


@pytest.mark.parametrize("limit", [1_000_000, 100])
@pytest.mark.parametrize("parts", [1, 17])
def test_group_quantiles(skewed, monkeypatch, limit, parts):
    monkeypatch.setattr(ordered, "SLICE_ROWS", 200)
    probs = [0.0, 0.05, 0.5, 0.75, 1.0]
    got = ordered.exact_quantiles(skewed.repartition(parts), ["k"], ["x", "y"], probs, limit)
    pdf = skewed.toPandas()
    rows = {r["k"]: r for r in got.collect()}
    assert set(rows) == set(pdf["k"])
    for k, part in pdf.groupby("k"):
        for c in ("x", "y"):
            assert rows[k][c] == pytest.approx(np.quantile(part[c].dropna(), probs))


@pytest.mark.parametrize("limit", [1_000_000, 10])
def test_global_quantiles(skewed, monkeypatch, limit):
    monkeypatch.setattr(ordered, "SLICE_ROWS", 50)
    row = ordered.exact_quantiles(skewed, [], ["x"], [0.25, 0.5], limit).first()
    assert row["x"] == pytest.approx(np.quantile(skewed.toPandas()["x"].dropna(), [0.25, 0.5]))


@pytest.mark.parametrize("limit", [1_000_000, 10])
def test_average_ranks(skewed, monkeypatch, limit):
    monkeypatch.setattr(ordered, "SLICE_ROWS", 100)
    by_key = ordered.average_ranks(skewed, "x", ["k"], 500).toPandas().set_index(["k", "x"])["avg_rank"]
    pdf = skewed.toPandas().dropna(subset=["x"])
    for (k, x), rank in by_key.items():
        assert rank == pdf[(pdf["k"] == k) & (pdf["x"] < x)].shape[0] + (pdf[(pdf["k"] == k) & (pdf["x"] == x)].shape[0] + 1) / 2
    got = {r["x"]: (r["n"], r["avg_rank"]) for r in ordered.average_ranks(skewed, "x", (), limit).collect()}
    x = skewed.toPandas()["x"].dropna()
    ranks = x.rank()
    assert len(got) == x.nunique()
    for value, rank in zip(x, ranks):
        assert got[value][1] == rank
    assert sum(n for n, _ in got.values()) == len(x)


def test_slices_split_a_large_group(skewed):
    source = skewed.filter("k = 'hot' AND x IS NOT NULL")
    counted = source.groupBy("k", "x").agg(F.count(F.lit(1)).alias("n"))
    cuts = ordered.slice_cuts(counted, source, ["k"], "x", 16, source.count(), 100)
    sizes = [r["count"] for r in ordered._with_slice(counted, ["k"], "x", cuts, 16).groupBy("_slice").count().collect()]
    assert len(sizes) > 8 and max(sizes) < counted.count() / 4


def test_slice_count():
    assert ordered.slice_count(1) == 2
    assert ordered.slice_count(5_000_000) == 16
    assert ordered.slice_count(10**13) == 1 << 25


def test_impute_and_box(spark):
    rows = [("a", 1.0), ("a", -5.0), ("a", 3.0), ("a", None), ("Student", 10.0), ("Student", None), (None, None)]
    df = spark.createDataFrame(rows, "status string, income double")
    got = sorted(((r[0], r[1]) for r in survey.group_median_impute(df).collect()), key=str)
    # the negative takes the median that includes it; only listed groups are filled
    assert got == sorted([("a", 1.0), ("a", 1.0), ("a", 3.0), ("a", None), ("Student", 10.0), ("Student", 10.0), (None, None)], key=str)
    box = spark.createDataFrame([("g", float(v)) for v in [1, 2, 3, 4, 100]], "status string, income double")
    r = survey.box_stats(box).first()
    assert (r["q1"], r["q2"], r["q3"], r["whisker_low"], r["whisker_high"], r["n_outliers"]) == (2, 3, 4, 1, 4, 1)


def test_auto_bins_matches_numpy():
    x = np.random.default_rng(0).normal(size=500)
    q = np.quantile(x, [0.25, 0.75])
    assert survey.auto_bins(len(x), x.min(), x.max(), q[1] - q[0]) == len(np.histogram_bin_edges(x, "auto")) - 1


@pytest.fixture(scope="module")
def holes(spark):
    rows = [(k, x) for k in ("a", None, "void") for x in [3.0, 1.0, 2.0, 2.0, None] for _ in range(9)]
    return spark.createDataFrame([(k, None if k == "void" else x) for k, x in rows], "k string, x double")


def test_both_plans_keep_null_keys_and_empty_groups(holes, monkeypatch):
    monkeypatch.setattr(ordered, "SLICE_ROWS", 5)

    def quantiles(limit):
        return sorted((tuple(r) for r in ordered.exact_quantiles(holes, ["k"], ["x"], [0.25, 0.5], limit).collect()), key=str)

    def ranks(limit):
        return sorted((tuple(r) for r in ordered.average_ranks(holes, "x", ["k"], limit).collect()), key=str)

    assert quantiles(10**6) == quantiles(1) and len(quantiles(1)) == 3
    assert ranks(10**6) == ranks(1) and {r[0] for r in ranks(1)} == {"a", None}
    void = holes.filter("k = 'void'")
    assert [tuple(r) for r in ordered.exact_quantiles(void, [], ["x"], [0.5], 1).collect()] == [(None,)]


def test_profiles_keep_keys_without_values(holes):
    cells = holes.filter("k IS NOT NULL").withColumn("months_balance", F.lit(-1))
    for profile in (cards.six_stat_profile, cards.period_ratio_profile):
        one = sorted((tuple(r) for r in profile(cells, "k", ["x"]).collect()), key=str)
        assert one == sorted((tuple(r) for r in profile(cells, "k", ["x"], limit=1).collect()), key=str) and len(one) == 2
