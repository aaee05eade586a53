"""Metrics against direct computation; learners by invariants."""

import numpy as np
import pytest

from loanloom.catalog import models as queries
from loanloom.operators import lookup, models, ordered

INPUTS = models.Inputs("id", "target", ["x", "z"], ["c"])


@pytest.fixture(scope="module")
def people(spark):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(1200):
        x, z = float(rng.normal()), float(rng.normal())
        y = int(x + 0.5 * z + rng.normal() > 0.8)
        rows.append((i, None if i % 15 == 0 else y, x, None if i % 20 == 0 else z, "pq"[int(x > 1)] if i % 9 else None))
    return spark.createDataFrame(rows, "id int, target int, x double, z double, c string").cache()


@pytest.fixture(scope="module")
def scores(spark):
    rng = np.random.default_rng(4)
    rows = [(i, int(rng.random() < 0.3), float(rng.integers(0, 40)) / 40, float(rng.random())) for i in range(500)]
    return spark.createDataFrame(rows, "id int, y int, a double, b double").cache()


def auc_of(pdf, score):
    pos, neg = pdf[pdf["y"] == 1][score].to_numpy(), pdf[pdf["y"] == 0][score].to_numpy()
    return np.mean([(p > neg).mean() + (p == neg).mean() / 2 for p in pos])


@pytest.mark.parametrize("limit", [10**6, 10])
def test_auc_and_curve(scores, monkeypatch, limit):
    monkeypatch.setattr(models, "GROUP_ROWS", limit)
    monkeypatch.setattr(ordered, "SLICE_ROWS", 30)
    pdf = scores.toPandas()
    for s in ("a", "b"):
        assert models.roc_auc(scores, "y", s).first()[0] == pytest.approx(auc_of(pdf, s))
    curve = models.roc_curve(scores, "y", "a").toPandas()
    for _, r in curve.iterrows():
        above = pdf[pdf["a"] >= r["threshold"]]
        assert r["tpr"] == pytest.approx((above["y"] == 1).sum() / (pdf["y"] == 1).sum())
        assert r["fpr"] == pytest.approx((above["y"] == 0).sum() / (pdf["y"] == 0).sum())


def test_confusion_parity_and_bagging(scores):
    cells = {r["cell"]: r for r in models.confusion_delta(scores, "y", "a", "b").collect()}
    assert sum(r["model_a"] for r in cells.values()) == 500 and sum(r["delta"] for r in cells.values()) == 0
    assert models.score_parity(scores, "a", "a").first()["all_equal"] and not models.score_parity(scores, "a", "b").first()["all_equal"]
    row = models.bag_average(scores, ["a", "b"]).first()
    assert row["bagging"] == pytest.approx((row["a"] + row["b"]) / 2)


def test_balanced_weights(people):
    table = models.model_table(people, INPUTS).toPandas()
    sums = table.groupby("label")["class_weight"].sum()
    assert sums[0.0] == pytest.approx(sums[1.0]) and len(table) == people.filter("target IS NOT NULL").count()


@pytest.mark.parametrize("train", [
    lambda d: models.train_logistic(d, INPUTS), lambda d: models.train_tree(d, INPUTS, maxDepth=4),
    lambda d: models.train_forest(d, INPUTS, numTrees=10, maxDepth=4),
    lambda d: models.train_boosted_mllib(d, INPUTS, maxIter=5, maxDepth=3)])
def test_learners_rank_better_than_chance(people, train, tmp_path):
    from pyspark.ml import PipelineModel

    model = train(people)
    scored = models.score_table(model, people, INPUTS)
    assert scored.count() == 1200 and scored.filter("proba < 0 OR proba > 1 OR proba IS NULL").count() == 0
    judged = scored.join(people.select("id", "target"), "id")
    assert models.roc_auc(judged, "target", "proba").first()[0] > 0.7
    model.save(str(tmp_path / "m"))
    again = models.score_table(PipelineModel.load(str(tmp_path / "m")), people, INPUTS, "again").join(scored, "id")
    assert models.score_parity(again, "proba", "again").first()["all_equal"]
    top = models.feature_importance(model, models.model_table(people, INPUTS, labelled=False)).collect()
    assert len(top) >= 3 and [r["importance"] for r in top] == sorted((r["importance"] for r in top), reverse=True)


def test_draws():
    draws = models.draw_params(models.SPACES["forest"], 50)
    assert draws == models.draw_params(models.SPACES["forest"], 50)
    assert all(100 <= d["numTrees"] <= 200 and d["numTrees"] % 5 == 0 and 0.03 <= d["featureSubsetStrategy"] <= 0.2 for d in draws)


@pytest.mark.parametrize("how", ["folds", "holdout"])
def test_search(people, how):
    trials, model = models.hyperparameter_search(people, INPUTS, "tree", n=2, how=how, k=3)
    rows = trials.collect()
    assert len(rows) == 2 and all(0.6 < r["roc_auc"] <= 1 for r in rows)
    assert models.score_table(model, people, INPUTS).count() == 1200


def test_ensembles(people):
    bases = {"base_rf": models.forest(numTrees=8, maxDepth=4), "base_boosted": models.boosted(maxIter=4, maxDepth=3)}
    blended = models.blend(people, INPUTS, bases)
    stacked = models.stack_oof(people, INPUTS, bases, k=3)
    for out, names in ((blended, ["base_rf", "base_boosted", "blending", "bagging"]), (stacked, ["base_rf", "base_boosted", "stacking"])):
        assert out.columns == ["id", "target", *names]
        assert 200 < out.count() < 260
        for n in names:
            assert models.roc_auc(out, "target", n).first()[0] > 0.65


def test_source_weights(people):
    weights = models.fitted_source_weights(people, models.Inputs("id", "target", ["x", "z"]), maxIter=4)
    assert weights["x"] > weights["z"] and sum(weights.values()) == pytest.approx(1, abs=0.011)


def test_many_rows_of_one_small_file_go_to_several_tasks(spark, tmp_path):
    spark.range(2 * lookup.TASK_ROWS + 10).repartition(1).selectExpr("id", "CAST(id % 2 AS INT) AS y", "CAST(id % 9 AS DOUBLE) AS x").write.parquet(str(tmp_path / "one"))
    one = spark.read.parquet(str(tmp_path / "one"))
    assert one.rdd.getNumPartitions() == 1
    table = models.model_table(one, models.Inputs("id", "y", ["x"]))
    assert table.rdd.getNumPartitions() == min(2, spark.sparkContext.defaultParallelism) == 2
    assert table.agg({"id": "sum", "*": "count"}).first() == one.agg({"id": "sum", "*": "count"}).first()
    few = one.limit(lookup.TASK_ROWS)
    assert models.model_table(few, models.Inputs("id", "y", ["x"])).rdd.getNumPartitions() == 1


def test_judged_rows_are_scored_once(spark, tmp_path):
    class Given:
        app = spark.range(40).selectExpr(
            "id AS sk_id_curr", "CAST(id % 2 AS INT) AS target", "CAST(id AS DOUBLE) AS x")
    inputs = models.Inputs("sk_id_curr", "target", ["x"])
    model = models.train_tree(Given.app, inputs, maxDepth=2)
    old, queries.INPUTS = queries.INPUTS, inputs
    try:
        judged = queries._judged(Given, model)
    finally:
        queries.INPUTS = old
    assert judged.count() == 40 and judged.inputFiles() and "Join" not in judged._jdf.queryExecution().executedPlan().toString()
