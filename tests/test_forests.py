"""Forests of a search: growing in step, counts, splits, scores."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loanloom.operators import forests, models
from loanloom.operators.forests import Forest

N = 3000


@pytest.fixture(scope="module")
def table(spark):
    return spark.range(N).select(
        "id", (F.col("id") % 7).cast("double").alias("x"), F.rand(5).alias("z"), F.element_at(F.array(F.lit("a"), F.lit("b"), F.lit("c")), (F.col("id") % 3 + 1).cast("int")).alias("c"),
        ((F.col("id") % 7 > 3) | (F.col("id") % 3 == 1)).cast("double").alias("label")).localCheckpoint()


def grown(table, settings, parts=3):
    coding, trees = forests.learn_coding(table, ["x", "z"], ["c"]), {}
    forests.grow(forests.blocks_of(table.repartition(parts), coding, "id", "label"), coding, np.array([1.0, 2.0]), settings, trees)
    return coding, trees


def plain(trees):
    return [[x.tolist() for x in (t.feature, t.cut, t.child, t.rows)] for t in trees]


def test_a_search_fits_no_forest_per_draw(table, monkeypatch):
    """Draws grow in step: MLlib's learner, a dozen jobs per draw, is not asked."""
    def fit(*_):
        raise AssertionError("fitted on its own")

    monkeypatch.setattr(models.RandomForestClassifier, "fit", fit)
    inputs = models.Inputs("id", "label", ["x", "z"], ["c"])
    trials, model = models.search_forest(table, inputs, n=6, budgets=(2, 4))
    assert trials.count() == 6 and trials.agg(F.max("roc_auc")).first()[0] > 0.95
    scores = models.score_table(model, table, inputs)
    again = models.load_model(models.save_model(model, f"{models.materialized(table.limit(1)).inputFiles()[0]}-model"), "forest")
    assert sorted(scores.collect()) == sorted(models.score_table(again, table, inputs).collect())
    shares = {r["feature"]: r["importance"] for r in models.feature_importance(model, table).collect()}
    assert sum(shares.values()) == pytest.approx(1) and shares["x"] + shares["c_flags_b"] > 0.5


def test_trees_do_not_depend_on_partitions_or_company(table, monkeypatch):
    a, b = Forest(3, 4, 5, "gini", 0.4, 1), Forest(2, 5, 2, "entropy", "all", 2)
    _, alone = grown(table, {0: a}, 1)
    monkeypatch.setattr(forests, "SUM_BYTES", 1000)  # one tree per job
    coding, both = grown(table, {0: a, 1: b}, 4)
    assert plain(alone[0]) == plain(both[0]) and len(both[1]) == 2
    kept = plain(both[1])
    blocks = forests.blocks_of(table, coding, "id", "label")
    forests.grow(blocks, coding, np.array([1.0, 2.0]), {1: Forest(4, 5, 2, "entropy", "all", 2)}, both)
    assert plain(both[1][:2]) == kept and len(both[1]) == 4


def test_nodes_hold_the_rows_that_reach_them(table):
    coding, trees = grown(table, {0: Forest(2, 4, 7, "gini", "sqrt", 9)})
    rows = table.toArrow().combine_chunks().to_batches()[0]
    x, y = coding.of(rows), rows.column("label").to_numpy().astype(int)
    h = np.array([r[0] for r in table.select(forests.row_hash(coding, "id", "label")).collect()], np.int64).view(np.uint64)
    for number, t in enumerate(trees[0]):
        times = forests.drawn(h, int(np.random.SeedSequence((9, number)).generate_state(1, np.uint64)[0]))
        at = forests.walked(t.plain(), x, np.arange(N), coding)
        leaves = t.cut == forests.CLOSED
        assert leaves.sum() > 2 and t.rows[1:].sum(axis=1).min() >= 7
        for label in (0, 1):
            assert np.bincount(at, times * (y == label), len(t.cut)).tolist() == np.where(leaves, t.rows[:, label], 0).tolist()
    assert abs(times.mean() - 1) < 0.1 and abs((times == 0).mean() - np.exp(-1)) < 0.05


@pytest.mark.parametrize("kind", ["gini", "entropy"])
def test_best_split_against_brute_force(kind):
    rng, weights, best = np.random.default_rng(3), np.array([0.7, 1.9]), -1.0
    own = rng.integers(0, 9, (1, 3, forests.BINS, 2))
    own[0, 1:] = own[0, 0, rng.permutation(forests.BINS)], own[0, 0, rng.permutation(forests.BINS)]

    def impurity(n):
        p = n * weights / (n * weights).sum()
        return 1 - (p ** 2).sum() if kind == "gini" else -sum(q * np.log2(q) for q in p if q > 0)

    whole = own[0, 0].sum(axis=0)
    for j in range(3):
        for cut in range(forests.BINS - 1):
            left = own[0, j, :cut + 1].sum(axis=0)
            if min(left.sum(), (whole - left).sum()) < 20:
                continue
            w = [(n * weights).sum() for n in (left, whole - left, whole)]
            gain = impurity(whole) - (w[0] * impurity(left) + w[1] * impurity(whole - left)) / w[2]
            best = max(best, gain)
    total, good, _, _, left, gain = forests.best_splits(own, np.array([[4, 5, 6]]), weights, Forest(1, 3, 20, kind))
    assert good[0] and total[0].tolist() == whole.tolist() and gain[0] == pytest.approx(best * (whole * weights).sum())


def test_rare_and_unknown_values(spark):
    rows = [(float(i % 40 == 0), float(i), "ab"[i % 2]) for i in range(2000)]
    coding = forests.learn_coding(spark.createDataFrame(rows, "rare double, many double, c string"), ["rare", "many"], ["c"])
    assert coding.cuts[0].tolist() == [0.0, 1.0] and 25 <= len(coding.cuts[1]) <= 31 and coding.groups == [{"a": 1, "b": 2}]
    batch = pa.RecordBatch.from_pydict({"rare": [0.0, 1.0], "many": [-1.0, 9e9], "c": ["b", "new"]})
    assert coding.of(batch).tolist() == [[0, 1], [0, len(coding.cuts[1])], [2, 0]]
    assert [Forest(strategy=s).width(22) for s in (0.11, "auto", "all", 0.001)] == [3, 5, 22, 1]
