"""Boosted trees against a plain version on rows, split by split."""

import math
import os
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from loanloom.operators import boosting, models
from loanloom.operators.boosting import BoostedModel, Settings, Task, grow, learn_bins

RNG = np.random.default_rng(5)
N = 700
ROWS = []
for i in range(N):
    x, z, c = float(RNG.normal()), float(RNG.integers(0, 4)), "abcde"[int(RNG.integers(0, 5))]
    y = int(x + (c in "bd") + 0.3 * z + RNG.normal() > 1.4)
    ROWS.append((i, float(y), float(1 + i % 3), int(RNG.integers(0, 4)), x, z, c))
SCHEMA = "id int, label double, class_weight double, part int, x double, z double, c string"


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(5).cache()


def shrunk(g, l1):
    return math.copysign(max(abs(g) - l1, 0), g)


class Plain:
    """Best-first growth over raw rows with bins; one leaf after the other is split."""

    def __init__(self, bins, y, w, s: Settings, ordered):
        self.bins, self.y, self.w, self.s, self.ordered = bins, y, w, s, ordered

    def split(self, rows, g, h):
        s, best = self.s, None
        whole = shrunk(g[rows].sum(), s.l1) ** 2 / (h[rows].sum() + s.l2)
        for f in range(self.bins.shape[1]):
            mine = self.bins[rows, f]
            values = sorted(set(mine.tolist()))
            if not self.ordered[f]:
                values.sort(key=lambda v: g[rows][mine == v].sum() / (h[rows][mine == v].sum() + boosting.CATEGORY_SMOOTHING))
            for k in range(1, len(values)):
                left = np.isin(mine, values[:k])
                a, b = rows[left], rows[~left]
                if min(len(a), len(b)) < s.least_rows:
                    continue
                gain = sum(shrunk(g[r].sum(), s.l1) ** 2 / (h[r].sum() + s.l2) for r in (a, b)) - whole
                if gain > boosting.LEAST_GAIN and (best is None or gain > best[0] + 1e-12):
                    best = (gain, f, a, b)
        return best

    def tree(self, g, h):
        s = self.s
        leaves = [(np.arange(len(self.y)), 0)]
        gains = []
        while len(leaves) < s.leaves:
            found = [(self.split(rows, g, h) if depth < s.depth else None, i) for i, (rows, depth) in enumerate(leaves)]
            found = [(x, i) for x, i in found if x is not None]
            if not found:
                break
            (gain, f, a, b), i = max(found, key=lambda t: t[0][0])
            gains.append((gain, f))
            depth = leaves.pop(i)[1] + 1
            leaves += [(a, depth), (b, depth)]
        step = np.zeros(len(self.y))
        for rows, _ in leaves:
            step[rows] = -shrunk(g[rows].sum(), s.l1) / (h[rows].sum() + s.l2) * s.rate
        return step, sorted(gains)

    def grow(self, rounds):
        base = math.log((self.w * self.y).sum() / (self.w * (1 - self.y)).sum())
        score, gains = np.full(len(self.y), base), []
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-score))
            step, mine = self.tree(self.w * (p - self.y), self.w * p * (1 - p))
            score = score + step
            gains.append(mine)
        return score, gains


def plain_bins(binning, rows):
    out = np.zeros((len(rows), 3), int)
    for i, r in enumerate(rows):
        out[i] = [sum(c < r[4] for c in binning.cuts["x"]), sum(c < r[5] for c in binning.cuts["z"]), binning.groups["c"].index(r[6]) + 1]
    return out


@pytest.mark.parametrize("settings", [
    Settings(rounds=3), Settings(rounds=2, leaves=5, depth=8, l1=2.0, l2=5.0, rate=0.5), Settings(rounds=2, leaves=31, depth=2, least_rows=40),
    Settings(rounds=1, leaves=9, depth=5, l2=1.0, least_rows=1)])
@pytest.mark.parametrize("local_rows", [0, 150, 10_000])
def test_equals_the_plain_version(table, settings, local_rows):
    binning = learn_bins(table, ["x", "z"], ["c"], 16)
    model = grow(table, ["x", "z"], ["c"], [Task(settings)], binning=binning, local_rows=local_rows)[0]
    y, w = np.array([r[1] for r in ROWS]), np.array([r[2] for r in ROWS])
    score, gains = Plain(plain_bins(binning, ROWS), y, w, settings, [True, True, False]).grow(settings.rounds)
    for tree, mine in zip(model.trees, gains):
        found = sorted((g, f) for g, f in zip(tree.gain, tree.feature) if f >= 0)
        assert [f for _, f in found] == [f for _, f in mine]
        assert np.allclose([g for g, _ in found], [g for g, _ in mine], rtol=1e-4, atol=1e-3)
    proba = dict(model.score(table.select("id", "x", "z", "c")).select("id", "proba").collect())
    assert np.allclose([proba[r[0]] for r in ROWS], 1 / (1 + np.exp(-score)), atol=1e-4)
    assert sum(model.importance.values()) == pytest.approx(1)


def log_loss(model, trees, rows):
    bins = plain_bins(model.binning, rows).astype(np.uint8)
    s = np.full(len(rows), model.base)
    for t in trees:
        s += np.array(t.value)[t.place(bins, model.settings.depth)]
    y, w = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    return (w * (np.logaddexp(0, s) - y * s)).sum() / w.sum()


def test_patience_stops_where_a_plain_loop_does(table):
    whole = grow(table, ["x", "z"], ["c"], [Task(Settings(rounds=40, rate=0.6), held=frozenset([1]), unused=frozenset([3]))], part="part")[0]
    held = [r for r in ROWS if r[3] == 1]
    losses = [log_loss(whole, whole.trees[:n], held) for n in range(41)]
    assert np.allclose(whole.losses, losses, atol=1e-5) and len(whole.trees) == 40
    for patience in (1, 3, 8):
        best = n = 0
        for n in range(41):
            best = n if losses[n] < losses[best] else best
            if n - best >= patience:
                break
        model = grow(table, ["x", "z"], ["c"], [Task(Settings(rounds=40, rate=0.6, patience=patience), frozenset([1]), frozenset([3]))], part="part")[0]
        assert (len(model.trees), model.grown) == (best, n)
        assert [t.gain for t in model.trees] == [t.gain for t in whole.trees[:best]]


def test_models_in_step_equal_models_alone(table):
    tasks = [Task(Settings(rounds=4, leaves=6, seed=k, share=0.67), unused=frozenset([k])) for k in range(3)] + [Task(Settings(rounds=2)), Task(Settings(rounds=0))]
    together = grow(table, ["x", "z"], ["c"], tasks, part="part")
    other = table.repartition(2, "x")
    for task, model in zip(tasks, together):
        alone = grow(other, ["x", "z"], ["c"], [task], part="part")[0]
        assert alone.text() == model.text()
        rest = grow(table.filter(~F.col("part").isin(*task.unused)), ["x", "z"], ["c"], [Task(task.settings)], part="part", binning=model.binning)[0]
        assert [t.value for t in rest.trees] == [t.value for t in model.trees]


@pytest.mark.parametrize("local_rows, few", [(0, 8), (0, 0), (120, 8), (120, 0)])
def test_all_ways_give_the_same_trees(table, monkeypatch, local_rows, few):
    monkeypatch.setattr(boosting, "FEW_TASKS", few)
    monkeypatch.setattr(boosting, "WRITE_EVERY", 2)
    tasks = [Task(Settings(rounds=4, leaves=7, seed=k, share=0.67, patience=2), frozenset([k])) for k in range(2)]
    wanted = grow(table.coalesce(1), ["x", "z"], ["c"], tasks, part="part")
    found = grow(table, ["x", "z"], ["c"], tasks, part="part", binning=wanted[0].binning, local_rows=local_rows)
    for a, b in zip(wanted, found):
        assert a.losses == b.losses and a.grown == b.grown
        bins = plain_bins(a.binning, ROWS).astype(np.uint8)
        assert (a.raw(bins) == b.raw(bins)).all()


def test_odd_tables(spark, table):
    empty = grow(table.limit(0), ["x"], ["c"], [Task(Settings(rounds=3))])[0]
    assert empty.score(table.select("id", "x", "c")).agg(F.min("proba"), F.max("proba")).first()[:] == (0.5, 0.5)
    same = grow(table.withColumn("label", F.lit(1.0)), ["x"], [], [Task(Settings(rounds=3))])[0]
    assert same.score(table.select("id", "x")).filter("proba < 0.99").count() == 0
    odd = spark.createDataFrame([(1, float("nan"), None), (2, None, "never seen"), (3, math.inf, "b")], "id int, x double, c string")
    model = grow(table, ["x"], ["c"], [Task(Settings(rounds=3))])[0]
    assert model.score(odd).filter("proba IS NULL OR isnan(proba)").count() == 0
    assert BoostedModel.of_text(model.text()).text() == model.text()


def test_training_saving_and_ensembles(spark, table, tmp_path):
    inputs = models.Inputs("id", "target", ["x", "z"], ["c"])
    people = table.withColumn("target", F.when(F.col("id") % 15 > 0, F.col("label"))).drop("label", "class_weight", "part")
    model = models.train_boosted(people, inputs, rounds=30, rate=0.5, patience=5)
    assert model.grown < 30 and len(model.trees) == model.grown - 5 and min(model.losses) == model.losses[len(model.trees)]
    again = models.load_model(models.save_model(model, str(tmp_path / "m")), "boosted")
    scores = models.score_table(model, people, inputs).join(models.score_table(again, people, inputs, "again"), "id")
    assert scores.count() == N and models.score_parity(scores, "proba", "again").first()["all_equal"]
    top = models.feature_importance(model, people).collect()
    assert {r["feature"] for r in top} == {"x", "z", "c"} and top[0]["feature"] == "x"
    bases = {"base_rf": models.forest(numTrees=8, maxDepth=4), "base_boosted": Settings(rounds=6, depth=3)}
    blended, stacked = models.blend(people, inputs, bases), models.stack_oof(people, inputs, bases, k=3)
    for out, names in ((blended, ["base_rf", "base_boosted", "blending", "bagging"]), (stacked, ["base_rf", "base_boosted", "stacking"])):
        assert out.columns == ["id", "target", *names]
        assert 120 < out.count() < 145
        for n in names:
            assert models.roc_auc(out, "target", n).first()[0] > 0.65
    only = models.stack_oof(people, inputs, {"one": Settings(rounds=3), "two": Settings(rounds=3, depth=2)}, k=3)
    assert only.columns == ["id", "target", "one", "two", "stacking"]


def test_halving_keeps_the_best():
    seen = []

    def judge(alive, budget):
        seen.append((list(alive), budget))
        return [-abs(i - 7) + budget / 1000 for i in alive]

    found = models.halving(20, [1, 2, 4], judge, keep=4)
    assert seen == [(list(range(20)), 1), ([7, 6, 8, 5, 9], 2), ([7], 4)]
    assert [f[:2] for f in found] == [(i, 4 if i == 7 else 2 if i in (5, 6, 8, 9) else 1) for i in range(20)]


@pytest.mark.parametrize("local_rows", [0, 10_000])
def test_growth_goes_on(table, local_rows):
    """Models that go on from earlier ones are those grown anew, trees after the best round included; one has had its patience before."""
    binning = learn_bins(table, ["x", "z"], ["c"], 16)
    kinds = [dict(depth=3, share=0.5, patience=3), dict(depth=2, rate=3.0, patience=1), dict(depth=2, patience=0), dict(depth=3, rate=2.0, patience=4, seed=9)]

    def models_of(rounds, earlier=None):
        tasks = [Task(Settings(rounds=rounds, **k), frozenset([1]) if k["patience"] else frozenset()) for k in kinds]
        return grow(table, ["x", "z"], ["c"], tasks, "label", "class_weight", "part", binning=binning, local_rows=local_rows, earlier=earlier)

    def whole(found):
        return [(m.text(), [t.value for t in m.after]) for m in found]

    first, right = models_of(3), models_of(6)
    went_on = models_of(6, first)
    assert whole(went_on) == whole(right) == whole(models_of(6, right))
    assert all(b is a for m, k in zip(first, went_on) for a, b in zip([*m.trees, *m.after], [*k.trees, *k.after]))
    assert [m.grown for m in first] == [3, 1, 3, 3] and went_on[1].grown == 1 and went_on[0].grown == 6 and first[3].after


def test_last_rung_of_a_search_has_the_rounds_drawn(table, monkeypatch):
    asked, real = [], boosting.grow

    def one_round(df, numeric, categorical, tasks, *rest, **more):
        asked.append([t.settings.rounds for t in tasks])
        return real(df, numeric, categorical, [Task(replace(t.settings, rounds=1), t.held) for t in tasks], *rest, **more)

    monkeypatch.setattr(boosting, "grow", one_round)
    inputs = models.Inputs("id", "label", ["x", "z"], ["c"])
    rows = models.search_boosted(table.drop("class_weight", "part"), inputs, n=6)[0].collect()
    drawn = [d["rounds"] for d in models.draw_params(models.SPACES["boosted"], 6)]
    top = max(r["budget"] for r in rows)
    last = [r["trial"] for r in rows if r["budget"] == top]
    assert asked[:2] == [[5] * 6, [25]] and asked[2] == [drawn[i] for i in last] and min(asked[2]) > 125 and top == max(drawn)


def test_searches(table):
    inputs = models.Inputs("id", "label", ["x", "z"], ["c"])
    people = table.drop("class_weight", "part")
    trials, model = models.search_boosted(people, inputs, n=7, budgets=(2, 6))
    rows = trials.collect()
    assert len(rows) == 7 and sum(r["budget"] == 6 for r in rows) == 1 and len(model.trees) <= 6
    best = next(r for r in rows if r["budget"] == 6)
    parts = models.stratified_split(models.model_table(people, inputs), "id", "label", {"train": 0.75, "validation": 0.25}, models.SEED)
    held = models.boosting.scored(parts.filter("split = 'validation'"), {"a": model})
    assert models.roc_auc(held, "label", "a").first()[0] == pytest.approx(best["roc_auc"])
    assert models.roc_auc_of_each(held.withColumn("b", 1 - F.col("a")), "label", ["a", "b"])["b"] == pytest.approx(1 - best["roc_auc"])
    trials, model = models.search_forest(people, inputs, n=5, budgets=(2, 4))
    assert trials.count() == 5 and models.score_table(model, people, inputs).count() == N


def test_only_paths_to_wanted_nodes_are_walked():
    marks = np.arange(256) < 1
    tree = boosting.Tree(
        feature=[0, 1, 2, -1, -1, -1, -1], left_bins=[marks, marks, marks, None, None, None, None], child=[1, 3, 5, -1, -1, -1, -1],
        value=[0.0] * 7, gain=[0.0] * 7, rows=[4] * 7)
    bins = [np.array([0, 0, 1, 1], np.uint8), np.array([0, 1, 0, 1], np.uint8), None]  # no wanted node lies below the split on the last
    assert [(v, rows.tolist()) for v, rows in boosting.rows_at(tree.plain(), bins, {4: 0})] == [(4, [1])]


def test_splits_of_many_models_are_found_in_tasks(table, monkeypatch):
    """The driver is sent a split per node, not the sums per bin from which it is found."""
    binning = learn_bins(table, ["x", "z"], ["c"], 16)
    tasks = [Task(Settings(rounds=2, depth=3, seed=s), frozenset([1])) for s in range(2)]

    def trees():
        return [m.text() for m in grow(table, ["x", "z"], ["c"], tasks, "label", "class_weight", "part", binning=binning, local_rows=0)]

    right = trees()
    monkeypatch.setattr(boosting, "FEW_TASKS", 0)
    driver, found = os.getpid(), boosting.best_split

    def in_a_task(*sums):
        assert os.getpid() != driver
        return found(*sums)

    monkeypatch.setattr(boosting, "best_split", in_a_task)
    assert trees() == right
