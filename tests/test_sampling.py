"""Splits and resampling do not depend on how rows are partitioned."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loanloom.operators import sampling


@pytest.fixture(scope="module")
def people(spark):
    return spark.range(3001).select(
        F.col("id"), F.when(F.col("id") % 11 == 0, None).when(F.col("id") % 5 == 0, 1).otherwise(0).alias("y"),
        (F.col("id") % 37).cast("double").alias("x"))


def as_map(df, column):
    return {r["id"]: r[column] for r in df.collect()}


@pytest.mark.parametrize("parts", [1, 17])
def test_split_and_folds(people, parts):
    base = people.coalesce(1)
    split = sampling.stratified_split(people.repartition(parts), "id", "y", {"train": 0.8, "test": 0.2})
    assert as_map(split, "split") == as_map(sampling.stratified_split(base, "id", "y", {"train": 0.8, "test": 0.2}), "split")
    for r in split.groupBy("y").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("split") == "train", 1)).alias("k")).collect():
        assert r["k"] == (0 if r["y"] is None else int(r["n"] * 0.8))
    folds = sampling.stratified_folds(people.repartition(parts), "id", "y", 5)
    for y in (0, 1):
        sizes = [r["count"] for r in folds.filter(F.col("y") == y).groupBy("fold").count().collect()]
        assert len(sizes) == 5 and max(sizes) - min(sizes) <= 1
    assert folds.filter("y IS NULL AND fold IS NOT NULL").count() == 0


def test_sample_share(people):
    got = sampling.stratified_sample(people, "id", "y", 0.03).groupBy("y").count().collect()
    whole = {r["y"]: r["count"] for r in people.groupBy("y").count().collect()}
    assert {r["y"]: r["count"] for r in got} == {y: int(n * 0.03) for y, n in whole.items() if y is not None and int(n * 0.03)}


def test_random_split_share(people):
    n = sampling.random_split(people, "id", 0.3).filter("split = 'test'").count()
    assert abs(n / 3001 - 0.3) < 0.03


def test_weights_agree_and_look_like_poisson(people):
    df = people.select("id", sampling.hash_word("id", 7, 0).alias("a"), sampling.hash_word("id", 7, 1).alias("b"))
    for i in (0, 3):
        df = sampling.with_poisson_weight(df, "id", 7, i, f"w{i}")
    df = df.toPandas()
    w = sampling.poisson_weights(
        df["a"].to_numpy().astype(np.uint64), df["b"].to_numpy().astype(np.uint64), np.array([0, 3], dtype=np.uint64))
    assert (w[0] == df["w0"]).all() and (w[1] == df["w3"]).all()
    assert abs(w.mean() - 1) < 0.05 and abs(w.var() - 1) < 0.1
    assert abs(np.corrcoef(w[0], w[1])[0, 1]) < 0.06


@pytest.mark.parametrize("parts", [1, 17])
def test_bootstrap_sums(people, parts):
    got = sampling.bootstrap_sums(people.repartition(parts), "id", "y", ["x"], 60).toPandas()
    assert len(got) == 120
    one = got[(got["grp"] == "1") & (got["iter"] == 3)].iloc[0]
    weighted = sampling.with_poisson_weight(people.filter("y = 1"), "id", 123, 3, "w")
    want = weighted.select(F.sum("w").alias("w"), F.sum(F.col("w") * F.col("x")).alias("wx")).first()
    assert (one["sw"], one["swx"]) == (want["w"], want["wx"])


def test_bootstrap_moves_no_row_by_its_id(people, tmp_path, monkeypatch):
    from loanloom.operators import lookup

    people.write.parquet(str(tmp_path / "p"))
    table = people.sparkSession.read.parquet(str(tmp_path / "p"))
    small = sampling.bootstrap_sums(table, "id", "y", ["x"], 5)
    assert "RoundRobinPartitioning" in small._jdf.queryExecution().toString()
    monkeypatch.setattr(lookup, "SPLIT_BYTES", 1)
    large = sampling.bootstrap_sums(table, "id", "y", ["x"], 5)
    plan = large._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "hashpartitioning(grp" in plan
    key = lambda r: (r["grp"], r["iter"])
    for a, b in zip(sorted(small.collect(), key=key), sorted(large.collect(), key=key)):
        assert key(a) == key(b) and a["sw"] == b["sw"] and abs(a["swx"] - b["swx"]) < 1e-9 * (1 + abs(b["swx"]))


def test_a_seed_for_each_column(people):
    both = people.select("id", "y", "x", F.col("x").alias("z"))
    rows = sampling.bootstrap_sums(both, "id", "y", ["x", "z"], 9, [5, 6]).collect()
    for column, seed in (("x", 5), ("z", 6)):
        alone = {(r["grp"], r["iter"]): (r["sw"], r["swx"]) for r in sampling.bootstrap_sums(both, "id", "y", [column], 9, seed).collect()}
        for r in rows:
            if r["feature"] == column:
                assert r["sw"] == alone[r["grp"], r["iter"]][0] and abs(r["swx"] - alone[r["grp"], r["iter"]][1]) < 1e-9 * (1 + abs(r["swx"]))


def test_resample_keeps_size_in_expectation(people):
    again = sampling.resample(people, "id")
    assert abs(again.count() / 3001 - 1) < 0.08
    assert again.groupBy("id").count().filter("count > 1").count() > 500


def test_an_infinite_value_counts_only_where_drawn(spark):
    df = spark.createDataFrame([(i, "g", float("inf") if i == 3 else 1.0) for i in range(20)], "id long, g string, x double")
    sums = sampling.bootstrap_sums(df, "id", "g", ["x"], 12).toPandas()
    a, b = df.filter("id = 3").select(sampling.hash_word("id", 123, 0), sampling.hash_word("id", 123, 1)).first()
    drawn = sampling.poisson_weights(np.array([a], dtype=np.uint64), np.array([b], dtype=np.uint64), np.arange(12, dtype=np.uint64))
    assert 0 < (drawn > 0).sum() < 12
    for _, r in sums.iterrows():
        assert np.isinf(r["swx"]) == (drawn[r["iter"], 0] > 0) and not np.isnan(r["swx"])
