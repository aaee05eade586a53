"""Training, tuning, combining and judging default-probability models with MLlib."""

from __future__ import annotations

import random
from dataclasses import dataclass, field, replace
from multiprocessing.pool import ThreadPool

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    DecisionTreeClassifier, GBTClassifier, LogisticRegression, RandomForestClassifier,
)
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import OneHotEncoder, StandardScaler, StringIndexer, StringIndexerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.core import col
from .cleaning import MISSING_NUMBER, MISSING_TEXT
from ..sources.tables import materialized
from . import boosting, forests
from .boosting import BoostedModel, Settings, Task
from .forests import Forest, ForestModel
from .lookup import GROUP_ROWS, attach_lookup, dealt, spread
from .ordered import running_totals
from .sampling import stratified_folds, stratified_split

FEATURES, WEIGHT, LABEL = "features", "class_weight", "label"
SEED = 123
# Settings of the base and meta models of the stacked ensemble.
FOREST = {"numTrees": 100, "maxDepth": 9, "minInstancesPerNode": 10}
BOOSTED = {"maxIter": 100, "maxDepth": 8, "minInstancesPerNode": 10}
STAGED = {"rounds": 100, "depth": 8, "least_rows": 10}
PATIENCE = {"train": 20, "blend": 50}
META = {"maxIter": 150, "C": 5.0}


@dataclass(frozen=True)
class Inputs:
    """Which columns a model reads."""

    id_col: str
    target: str
    numeric: list[str]
    categorical: list[str] = field(default_factory=list)


# ---- tables for training -----------------------------------------------------

def balanced_weights(df: DataFrame, label: str, name: str = WEIGHT) -> DataFrame:
    """Add the class weight n / (classes * n_class); rows without a label have none."""
    counts = df.filter(col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    total, classes = counts.agg(F.sum("_n"), F.count(F.lit(1))).first()
    weights = counts.select(col(label), (F.lit(total) / (F.lit(classes) * F.col("_n"))).alias("_weight"))
    joined = attach_lookup(df, weights, [label])
    return joined.select(*[col(c) for c in df.columns if c != name], F.col("_weight").alias(name))


def model_table(df: DataFrame, inputs: Inputs, labelled: bool = True) -> DataFrame:
    """Id, label and filled features; labelled tables also carry balanced class weights.

    A labelled table is written once, cut down to the model's columns: weights, encoders and
    learners read that and not the features' whole history again. Its rows are spread over the cores.
    """
    numbers = [F.coalesce(col(c).cast("double"), F.lit(float(MISSING_NUMBER))).alias(c) for c in inputs.numeric]
    texts = [F.coalesce(col(c).cast("string"), F.lit(MISSING_TEXT)).alias(c) for c in inputs.categorical]
    if not labelled:
        return df.select(inputs.id_col, *numbers, *texts)
    known = df.filter(col(inputs.target).isNotNull())
    table = known.select(inputs.id_col, col(inputs.target).cast("double").alias(LABEL), *numbers, *texts)
    return balanced_weights(spread(materialized(table, "model-table")), LABEL)


def encoding_stages(inputs: Inputs, scale: bool = True, expand: bool = True) -> list:
    """Index categories, optionally expand them to flags, optionally scale numbers."""
    stages, parts = [], []
    if inputs.categorical:
        indexed = [f"{c}_index" for c in inputs.categorical]
        stages.append(StringIndexer(
            inputCols=inputs.categorical, outputCols=indexed, handleInvalid="keep", stringOrderType="alphabetAsc"
        ))
        if expand:
            flags = [f"{c}_flags" for c in inputs.categorical]
            stages.append(OneHotEncoder(inputCols=indexed, outputCols=flags, handleInvalid="keep"))
            parts += flags
        else:
            parts += indexed
    if scale:
        stages += [
            VectorAssembler(inputCols=inputs.numeric, outputCol="_numbers"),
            StandardScaler(inputCol="_numbers", outputCol="_scaled", withMean=True, withStd=True),
        ]
        parts.append("_scaled")
    else:
        parts += inputs.numeric
    return [*stages, VectorAssembler(inputCols=parts, outputCol=FEATURES)]


# ---- learners ----------------------------------------------------------------

def _common(**params) -> dict:
    return {"featuresCol": FEATURES, "labelCol": LABEL, "weightCol": WEIGHT, **params}


def logistic(rows: int, C: float = 1.0, maxIter: int = 100, features: str = FEATURES) -> LogisticRegression:
    """L2 logistic regression; ``C`` is the inverse strength over ``rows`` rows."""
    learner = LogisticRegression(**_common(
        featuresCol=features, maxIter=maxIter, regParam=1.0 / (C * max(rows, 1)), standardization=False
    ))
    learner.stated_rows = max(rows, 1)
    return learner


def tree(seed: int = SEED, **params) -> DecisionTreeClassifier:
    return DecisionTreeClassifier(**_common(seed=seed, **params))


def forest(seed: int = SEED, **params) -> RandomForestClassifier:
    return RandomForestClassifier(**_common(seed=seed, **{**FOREST, **params}))


def boosted(seed: int = SEED, **params) -> GBTClassifier:
    return GBTClassifier(**_common(seed=seed, **{**BOOSTED, **params}))


def train_logistic(df: DataFrame, inputs: Inputs, C: float = 1.0, maxIter: int = 100) -> PipelineModel:
    table = model_table(df, inputs)
    return Pipeline(stages=[*encoding_stages(inputs), logistic(table.count(), C, maxIter)]).fit(table)


def train_tree(df: DataFrame, inputs: Inputs, **params) -> PipelineModel:
    return Pipeline(stages=[*encoding_stages(inputs, scale=False), tree(**params)]).fit(model_table(df, inputs))


def train_forest(df: DataFrame, inputs: Inputs, **params) -> PipelineModel:
    return Pipeline(stages=[*encoding_stages(inputs), forest(**params)]).fit(model_table(df, inputs))


def train_boosted(df: DataFrame, inputs: Inputs, validation: float = 0.25, patience: int = PATIENCE["train"], **settings) -> BoostedModel:
    """Second-order boosted trees (``boosting.Settings``) that end when a stratified validation part no longer improves.

    They keep the trees up to the round of the smallest validation loss, after which
    ``patience`` rounds brought none smaller. Categories are split natively.
    """
    parts = {"train": 1 - validation, "validation": validation}
    table = stratified_split(model_table(df, inputs), inputs.id_col, LABEL, parts, SEED)
    table = table.withColumn("part", (F.col("split") == "validation").cast("int"))
    task = Task(Settings(**{**STAGED, "patience": patience, **settings}), held=frozenset([1]))
    return boosting.grow(table, inputs.numeric, inputs.categorical, [task], LABEL, WEIGHT, "part")[0]


def train_boosted_mllib(df: DataFrame, inputs: Inputs, validation: float = 0.25, **params) -> PipelineModel:
    """MLlib's first-order boosted trees, which end at the first round that gains less than the tolerance on a validation part."""
    parts = {"train": 1 - validation, "validation": validation}
    table = stratified_split(model_table(df, inputs), inputs.id_col, LABEL, parts, SEED)
    table = table.withColumn("held_out", F.col("split") == "validation").drop("split")
    encoder = Pipeline(stages=encoding_stages(inputs, expand=False)).fit(table)
    learner = boosted(validationIndicatorCol="held_out", **{"maxBins": bins_for(encoder), "validationTol": 1e-5, **params})
    return PipelineModel(stages=[*encoder.stages, learner.fit(encoder.transform(table))])


def bins_for(encoder: PipelineModel, least: int = 32) -> int:
    """Bins that a tree needs for its indexed categories, one for unknown values included."""
    widths = [len(labels) + 1 for stage in encoder.stages if isinstance(stage, StringIndexerModel) for labels in stage.labelsArray]
    return max([least, *widths])


# ---- scores ------------------------------------------------------------------

def positive_score(column: str = "probability") -> Column:
    return vector_to_array(column)[1]


def score_table(model: PipelineModel | BoostedModel | ForestModel, df: DataFrame, inputs: Inputs, name: str = "proba") -> DataFrame:
    """``(id, proba)``: default probability of every row."""
    table = dealt(model_table(df, inputs, labelled=False))
    if isinstance(model, (BoostedModel, ForestModel)):
        return model.score(table, name).select(inputs.id_col, name)
    scored = model.transform(table)
    return scored.select(inputs.id_col, positive_score().alias(name))


def score_parity(df: DataFrame, a: str, b: str, digits: int = 4) -> DataFrame:
    """One row: are two score columns equal after rounding, in all rows."""
    same = F.round(col(a), digits) == F.round(col(b), digits)
    return df.agg(F.count(F.lit(1)).alias("n"), F.bool_and(F.coalesce(same, F.lit(False))).alias("all_equal"))


def bag_average(df: DataFrame, columns: list[str], name: str = "bagging") -> DataFrame:
    total = F.lit(0.0)
    for c in columns:
        total = total + col(c)
    return df.withColumn(name, total / len(columns))


def _score_counts(df: DataFrame, label: str, score: str) -> DataFrame:
    """Labels per distinct score with running totals of both classes."""
    source = df.filter(col(label).isNotNull() & col(score).isNotNull()).select(
        F.lit(1).alias("_one"), col(score).cast("double").alias("score"), col(label).cast("int").alias("_label")
    )
    counted = source.groupBy("_one", "score").agg(
        F.count(F.when(F.col("_label") == 0, 1)).alias("n0"), F.count(F.when(F.col("_label") == 1, 1)).alias("n1")
    )
    rows = source.count()
    large = source if rows > GROUP_ROWS else None
    return running_totals(counted, ["_one"], "score", ["n0", "n1"], large, rows, GROUP_ROWS)


def roc_auc(df: DataFrame, label: str, score: str) -> DataFrame:
    """Exact area under the ROC curve from ranks; ties count one half."""
    ranked = _score_counts(df, label, score)
    wins = F.sum(F.col("n1") * (F.col("n0_before") + F.col("n0") / 2))
    pairs = F.max("n0_all").cast("double") * F.max("n1_all")
    return ranked.agg(F.try_divide(wins, pairs).alias("roc_auc"))


def roc_auc_of_each(df: DataFrame, label: str, scores: list[str]) -> dict[str, float]:
    """The same area for each of several score columns, in one pass; one row per column is read."""
    source = df.filter(col(label).isNotNull()).select(col(label).cast("int").alias("_label"), *[col(s).cast("double").alias(s) for s in scores])
    long = source.unpivot(["_label"], scores, "model", "score").filter("score IS NOT NULL")
    counted = long.groupBy("model", "score").agg(
        F.count(F.when(F.col("_label") == 0, 1)).alias("n0"), F.count(F.when(F.col("_label") == 1, 1)).alias("n1"))
    rows = source.count()
    ranked = running_totals(counted, ["model"], "score", ["n0", "n1"], long if rows > GROUP_ROWS else None, rows, GROUP_ROWS)
    wins = F.sum(F.col("n1") * (F.col("n0_before") + F.col("n0") / 2))
    area = F.try_divide(wins, F.max("n0_all").cast("double") * F.max("n1_all"))
    found = {r["model"]: r["area"] for r in ranked.groupBy("model").agg(area.alias("area")).collect()}
    return {s: 0.5 if found.get(s) is None else float(found[s]) for s in scores}


def roc_curve(df: DataFrame, label: str, score: str) -> DataFrame:
    """False and true positive rate when everything from a score upward is called positive."""
    ranked = _score_counts(df, label, score)
    def rate(c: str) -> Column:
        return F.try_divide((F.col(f"{c}_all") - F.col(f"{c}_before")).cast("double"), F.col(f"{c}_all"))
    return ranked.select(F.col("score").alias("threshold"), rate("n0").alias("fpr"), rate("n1").alias("tpr"))


def confusion_delta(df: DataFrame, label: str, a: str, b: str, threshold: float = 0.5) -> DataFrame:
    """``(cell, model_a, model_b, delta)`` for tn, fp, fn, tp; ``delta`` is a minus b."""
    cells = {"tn": (0, False), "fp": (0, True), "fn": (1, False), "tp": (1, True)}
    counts = []
    for name, (truth, positive) in cells.items():
        for m, score in (("a", a), ("b", b)):
            called = col(score) > threshold
            hit = (col(label).cast("int") == truth) & (called if positive else ~called)
            counts.append(F.count(F.when(hit, 1)).alias(f"{name}_{m}"))
    rows = F.array(*[
        F.struct(
            F.lit(n).alias("cell"), F.col(f"{n}_a").alias("model_a"), F.col(f"{n}_b").alias("model_b"),
            (F.col(f"{n}_a") - F.col(f"{n}_b")).alias("delta"),
        )
        for n in cells
    ])
    return df.agg(*counts).select(F.explode(rows).alias("r")).select("r.*")


# ---- validation and search ---------------------------------------------------

def evaluator(metric: str = "areaUnderROC") -> BinaryClassificationEvaluator:
    return BinaryClassificationEvaluator(labelCol=LABEL, rawPredictionCol="rawPrediction", metricName=metric)


def fitted_to(learner, rows: int, bins: int):
    """The learner for a table of so many rows and categories.

    A logistic learner's penalty was stated for another number of rows and is scaled to
    this one; a tree gets the bins that its categories need.
    """
    if isinstance(learner, LogisticRegression):
        stated = getattr(learner, "stated_rows", None)
        return learner.copy({learner.regParam: learner.getRegParam() * stated / max(rows, 1)}) if stated else learner
    return learner.copy({learner.maxBins: max(bins, learner.getOrDefault(learner.maxBins))})


def _judge(train: DataFrame, held: DataFrame, stages: list, learner, maps: list[dict], metric: str, pool) -> list[float]:
    """Metric of every parameter map on ``held``; the encoders are fitted on ``train`` alone."""
    encoder = Pipeline(stages=stages).fit(train)
    columns = [FEATURES, LABEL, WEIGHT]
    train = encoder.transform(train).select(*columns).persist()
    held = encoder.transform(held).select(*columns).persist()
    judge = evaluator(metric)

    rows, bins = train.count(), bins_for(encoder)

    def run(params: dict) -> float:
        one = fitted_to(learner.copy(params), rows, bins)
        return judge.evaluate(one.fit(train).transform(held))

    try:
        return pool.map(run, maps)
    finally:
        train.unpersist()
        held.unpersist()


def cross_validate(
    table: DataFrame, id_col: str, stages: list, learner, maps: list[dict] | None = None, k: int = 5,
    metric: str = "areaUnderROC", seed: int = SEED, parallelism: int = 4,
) -> list[list[float]]:
    """Per fold the metric of every parameter map; folds keep the shares of the labels."""
    folds = stratified_folds(table, id_col, LABEL, k, seed).persist()
    inner = max(1, parallelism // k)

    def one(i: int) -> list[float]:
        with ThreadPool(inner) as pool:
            return _judge(
                folds.filter(F.col("fold") != i), folds.filter(F.col("fold") == i), stages, learner, maps or [{}],
                metric, pool,
            )

    try:
        with ThreadPool(min(parallelism, k)) as pool:
            return pool.map(one, range(k))
    finally:
        folds.unpersist()


def validate(
    table: DataFrame, id_col: str, stages: list, learner, maps: list[dict], share: float = 0.25,
    metric: str = "areaUnderROC", seed: int = SEED, parallelism: int = 4,
) -> list[float]:
    """Metric of every parameter map on one stratified validation part."""
    parts = stratified_split(table, id_col, LABEL, {"train": 1 - share, "validation": share}, seed)
    train, held = parts.filter(F.col("split") == "train"), parts.filter(F.col("split") == "validation")
    with ThreadPool(parallelism) as pool:
        return _judge(train, held, stages, learner, maps, metric, pool)


# Ranges the parameters are drawn from (low, high, step).
SPACES = {
    "logistic": {"maxIter": (100, 200, 1), "C": (0.01, 10.01, 0.1)},
    "tree": {"impurity": ("gini", "entropy"), "maxDepth": (5, 13, 1), "minInstancesPerNode": (1, 20, 1)},
    "forest": {
        "numTrees": (100, 200, 5), "impurity": ("gini", "entropy"), "maxDepth": (3, 10, 1),
        "minInstancesPerNode": (1, 20, 1), "featureSubsetStrategy": (0.03, 0.2, 0.01),
    },
    "boosted": {
        "rate": (0.001, 0.5, 0.001), "depth": (3, 10, 1), "rounds": (100, 1000, 1), "leaves": (20, 62, 1), "least_rows": (10, 100, 1),
        "share": (0.03, 1.0, 0.01), "l1": (0, 100, 1), "l2": (0, 100, 1),
    },
    "meta": {"maxIter": (100, 200, 1), "C": (0.01, 10.01, 0.1)},
}
TRIALS = {"logistic": 10, "tree": 10, "forest": 100, "boosted": 100, "meta": 100}


def draw_params(space: dict, n: int, seed: int = SEED) -> list[dict]:
    """``n`` independent draws; a range is (low, high, step), anything else a list of choices."""
    rng = random.Random(seed)

    def draw(choice):
        if isinstance(choice[0], str):
            return rng.choice(choice)
        low, high, step = choice
        value = low + step * rng.randint(0, int(round((high - low) / step)))
        return value if isinstance(step, int) else round(value, 6)

    return [{name: draw(choice) for name, choice in space.items()} for _ in range(n)]


def _param_map(learner, params: dict, rows: int) -> dict:
    out = {}
    for name, value in params.items():
        if name == "C":
            out[learner.regParam] = 1.0 / (value * max(rows, 1))
        elif name == "featureSubsetStrategy":
            out[learner.featureSubsetStrategy] = str(value)
        else:
            out[learner.getParam(name)] = value
    return out


def hyperparameter_search(
    df: DataFrame, inputs: Inputs, kind: str, n: int | None = None, how: str = "folds", k: int = 5,
    seed: int = SEED, parallelism: int = 4, space: dict | None = None,
) -> tuple[DataFrame, object]:
    """(table of trials with their ROC-AUC, model refitted with the best draw).

    ``folds`` judges each draw on stratified folds, ``holdout`` on one
    stratified validation part. Draws come from ``SPACES`` unless given. Forests and boosted
    trees have ``search_forest`` and ``search_boosted``.
    """
    table = model_table(df, inputs).persist()
    try:
        rows = table.count()
        draws = draw_params(space or SPACES[kind], TRIALS[kind] if n is None else n, seed)
        learner = {
            "logistic": lambda: logistic(rows), "meta": lambda: logistic(rows), "tree": tree,
            "forest": forest,
        }[kind]()
        maps = [_param_map(learner, d, rows) for d in draws]
        stages = encoding_stages(inputs, scale=kind != "tree")
        if how == "folds":
            per_fold = cross_validate(table, inputs.id_col, stages, learner, maps, k, seed=seed, parallelism=parallelism)
            scores = [sum(s) / k for s in zip(*per_fold)]
        else:
            scores = validate(table, inputs.id_col, stages, learner, maps, seed=seed, parallelism=parallelism)
        best = maps[max(range(len(maps)), key=lambda i: scores[i])]
        encoder = Pipeline(stages=stages).fit(table)
        final = fitted_to(learner.copy(best), rows, bins_for(encoder))
        model = PipelineModel(stages=[*encoder.stages, final.fit(encoder.transform(table))])
    finally:
        table.unpersist()
    trials = [(i, str(sorted(d.items())), float(s)) for i, (d, s) in enumerate(zip(draws, scores))]
    return df.sparkSession.createDataFrame(trials, "trial int, params string, roc_auc double"), model


def halving(n: int, budgets: list[int], judge, keep: int = 5) -> list[tuple[int, int, float]]:
    """(draw, budget, score) of each draw at the last rung it reached.

    ``judge(draws, budget)`` scores some draws at a budget; the best ``keep``-th part of a
    rung, one at least, goes on to the next, larger budget.
    """
    alive, last = list(range(n)), {}
    for rung, budget in enumerate(budgets):
        scores = dict(zip(alive, judge(alive, budget)))
        last.update({i: (i, budget, float(s)) for i, s in scores.items()})
        if rung + 1 < len(budgets):
            alive = sorted(alive, key=lambda i: (-scores[i], i))[:max(1, len(alive) // keep)]
    return [last[i] for i in sorted(last)]


def _trials(df: DataFrame, draws: list[dict], found: list[tuple[int, int, float]]) -> tuple[DataFrame, int]:
    """The table of trials, and the best draw of the last rung."""
    top = max(b for _, b, _ in found)
    best = max((f for f in found if f[1] == top), key=lambda f: (f[2], -f[0]))[0]
    rows = [(i, str(sorted(draws[i].items())), budget, score) for i, budget, score in found]
    return df.sparkSession.createDataFrame(rows, "trial int, params string, budget int, roc_auc double"), best


def search_boosted(
    df: DataFrame, inputs: Inputs, n: int | None = None, budgets: tuple[int | None, ...] = (5, 25, None), seed: int = SEED,
    space: dict | None = None, validation: float = 0.25, patience: int = PATIENCE["train"],
) -> tuple[DataFrame, BoostedModel]:
    """(trials, best model) by successive halving over rounds, judged on one stratified validation part.

    All draws of a rung grow in step over one table, so a rung of a hundred draws takes the
    passes of a single model. A draw that goes on keeps its trees. Its own number of rounds is
    its limit, and the only one besides patience where a budget is None; such a rung is listed
    with the largest number of all draws.
    """
    draws = draw_params(space or SPACES["boosted"], TRIALS["boosted"] if n is None else n, seed)
    most = max([d["rounds"] for d in draws] + [b for b in budgets if b is not None])
    parts = stratified_split(model_table(df, inputs), inputs.id_col, LABEL, {"train": 1 - validation, "validation": validation}, seed)
    parts = materialized(parts.withColumn("part", (F.col("split") == "validation").cast("int")), "search")
    held = parts.filter("part = 1").select(LABEL, *inputs.numeric, *inputs.categorical)
    binning = boosting.learn_bins(parts, inputs.numeric, inputs.categorical)
    grown: dict[int, BoostedModel] = {}

    def judge(alive: list[int], budget: int) -> list[float]:
        tasks = [Task(Settings(**{**draws[i], "rounds": min(budget, draws[i]["rounds"]), "patience": patience, "seed": seed + i}), frozenset([1])) for i in alive]
        earlier = [grown[i] for i in alive] if grown else None
        models = boosting.grow(parts, inputs.numeric, inputs.categorical, tasks, LABEL, WEIGHT, "part", binning=binning, earlier=earlier)
        grown.update(zip(alive, models))
        names = {f"m{i}": m for i, m in zip(alive, models)}
        areas = roc_auc_of_each(boosting.scored(held, names), LABEL, list(names))
        return [areas[f"m{i}"] for i in alive]

    trials, best = _trials(df, draws, halving(len(draws), [most if b is None else b for b in budgets], judge))
    return trials, grown[best]


def search_forest(
    df: DataFrame, inputs: Inputs, n: int | None = None, budgets: tuple[int, ...] = (4, 20, 100), seed: int = SEED,
    space: dict | None = None, validation: float = 0.25,
) -> tuple[DataFrame, ForestModel]:
    """(trials, forest refitted with the best draw) by successive halving over the number of trees.

    A budget is the per cent of a draw's own number of trees that is grown. All draws of a rung grow in step over one
    table, and a draw that goes on keeps its trees; they are judged on one stratified validation part.
    """
    table = model_table(df, inputs)
    draws = draw_params(space or SPACES["forest"], TRIALS["forest"] if n is None else n, seed)
    parts = materialized(stratified_split(table, inputs.id_col, LABEL, {"train": 1 - validation, "validation": validation}, seed), "search")
    train, held = parts.filter("split = 'train'"), parts.filter("split = 'validation'")
    weights = np.zeros(2)
    for r in train.groupBy(LABEL).agg(F.max(WEIGHT)).collect():
        weights[int(r[0])] = r[1]
    coding = forests.learn_coding(train, inputs.numeric, inputs.categorical)
    blocks = forests.blocks_of(train, coding, inputs.id_col, LABEL)
    grown: dict[int, list] = {}

    def settings(i: int, percent: int) -> Forest:
        d = {**FOREST, **draws[i]}
        return Forest(max(1, d["numTrees"] * percent // 100), d["maxDepth"], d["minInstancesPerNode"], d.get("impurity", "gini"),
                      d.get("featureSubsetStrategy", "auto"), seed + i)

    def judge(alive: list[int], budget: int) -> list[float]:
        forests.grow(blocks, coding, weights, {i: settings(i, budget) for i in alive}, grown)
        scores = materialized(forests.scored(held, coding, weights, {f"m{i}": grown[i] for i in alive}, [LABEL]), "forest-scores")
        areas = roc_auc_of_each(scores, LABEL, [f"m{i}" for i in alive])
        return [areas[f"m{i}"] for i in alive]

    try:
        trials, best = _trials(df, draws, halving(len(draws), list(budgets), judge))
    finally:
        blocks.unpersist()
    return trials, forests.train(table, inputs.numeric, inputs.categorical, settings(best, 100), inputs.id_col, LABEL, weights)


# ---- ensembles ---------------------------------------------------------------

def _meta_features(scored: DataFrame, names: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=names, outputCol="meta_features").transform(scored)


def _fit_meta(scored: DataFrame, names: list[str], C: float, maxIter: int):
    table = balanced_weights(_meta_features(scored, names).drop(WEIGHT), LABEL)
    return logistic(table.count(), C, maxIter, features="meta_features").fit(table)


def _apply_meta(meta, scored: DataFrame, names: list[str], name: str) -> DataFrame:
    out = meta.transform(_meta_features(scored, names))
    return out.withColumn(name, positive_score("probability"))


def _with_scores(models: dict[str, object], table: DataFrame, keep: list[str]) -> DataFrame:
    """Add one score column per model, row by row, without joins."""
    for name, model in models.items():
        table = model.transform(table).withColumn(name, positive_score()).drop(
            "rawPrediction", "probability", "prediction"
        )
    return table.select(*keep, *models)


def _fit_all(bases: dict[str, object], train: DataFrame) -> dict[str, object]:
    with ThreadPool(len(bases)) as pool:
        fitted = pool.map(lambda base: base.fit(train), bases.values())
    return dict(zip(bases, fitted))


def default_bases() -> dict[str, object]:
    """Learners of MLlib fit on encoded vectors; ``Settings`` are boosted trees over bins."""
    return {"base_rf": forest(), "base_boosted": Settings(**STAGED)}


def _staged(bases: dict[str, object]) -> tuple[dict[str, object], dict[str, Settings]]:
    return ({n: b for n, b in bases.items() if not isinstance(b, Settings)}, {n: b for n, b in bases.items() if isinstance(b, Settings)})


def blend(
    df: DataFrame, inputs: Inputs, bases: dict[str, object] | None = None,
    meta: dict | None = None, seed: int = SEED, patience: int = PATIENCE["blend"],
) -> DataFrame:
    """Test-part scores of the bases, the blended meta-model and their plain average.

    Bases learn on the 60 % train part, boosted ones with ``patience`` rounds on the
    validation part; scores on the 20 % validation part train the meta-model, which is
    applied to the 20 % test part.
    """
    bases, meta = bases or default_bases(), {**META, **(meta or {})}
    fitted, staged = _staged(bases)
    parts = stratified_split(
        model_table(df, inputs), inputs.id_col, LABEL, {"train": 0.6, "validation": 0.2, "test": 0.2}, seed
    )
    parts = materialized(parts.withColumn("part", F.when(F.col("split") == "train", 0).when(F.col("split") == "validation", 1).otherwise(2)), "blend")
    tasks = [Task(replace(s, patience=s.patience or patience), frozenset([1]), frozenset([2])) for s in staged.values()]
    grown = dict(zip(staged, boosting.grow(parts, inputs.numeric, inputs.categorical, tasks, LABEL, WEIGHT, "part"))) if staged else {}
    encoder = Pipeline(stages=encoding_stages(inputs)).fit(parts.filter(F.col("split") == "train"))
    encoded = encoder.transform(boosting.scored(parts, grown)).select(inputs.id_col, LABEL, WEIGHT, "split", FEATURES, *grown)
    models = _fit_all(fitted, encoded.filter(F.col("split") == "train").drop(*grown)) if fitted else {}
    names, keep = list(bases), [inputs.id_col, LABEL, *grown]
    held = _with_scores(models, encoded.filter(F.col("split") == "validation"), keep)
    final = _fit_meta(held, names, meta["C"], meta["maxIter"])
    test = _with_scores(models, encoded.filter(F.col("split") == "test"), keep)
    scored = bag_average(_apply_meta(final, test, names, "blending"), names)
    return scored.select(inputs.id_col, F.col(LABEL).cast("int").alias("target"), *names, "blending", "bagging")


def stack_oof(
    df: DataFrame, inputs: Inputs, bases: dict[str, object] | None = None, meta: dict | None = None,
    k: int = 5, seed: int = SEED,
) -> DataFrame:
    """Validation-part scores of a stacked ensemble.

    Out-of-fold base scores on the 80 % train part teach the meta-model; the
    bases are then refitted on that whole part. The boosted models of all folds and the
    refitted one grow in step over one table.
    """
    bases, meta = bases or default_bases(), {**META, **(meta or {})}
    fitted, staged = _staged(bases)
    parts = stratified_split(model_table(df, inputs), inputs.id_col, LABEL, {"train": 0.8, "validation": 0.2}, seed)
    folds = stratified_folds(parts.filter(F.col("split") == "train"), inputs.id_col, LABEL, k, seed)
    parts = materialized(folds.unionByName(parts.filter(F.col("split") == "validation").withColumn("fold", F.lit(k))), "stack")
    inside = [frozenset([i, k]) for i in range(k)] + [frozenset([k])]
    grown = boosting.grow(
        parts, inputs.numeric, inputs.categorical, [Task(s, unused=away) for s in staged.values() for away in inside], LABEL, WEIGHT, "fold")
    by_fold = {f"_{name}_{i}": grown[j * (k + 1) + i] for j, name in enumerate(staged) for i in range(k + 1)}
    scored = boosting.scored(parts, by_fold)
    for name in staged:  # a row's score is from the model that did not see it
        scored = scored.withColumn(name, F.element_at(F.array(*[F.col(f"_{name}_{i}") for i in range(k + 1)]), F.col("fold") + 1))
    encoder = Pipeline(stages=encoding_stages(inputs)).fit(parts.filter(F.col("split") == "train"))
    encoded = materialized(encoder.transform(scored).select(inputs.id_col, LABEL, WEIGHT, "fold", FEATURES, *staged), "encoded")
    names, keep = list(bases), [inputs.id_col, LABEL, *staged]

    def out_of_fold(i: int) -> DataFrame:
        rest, part = encoded.filter(~F.col("fold").isin(i, k)), encoded.filter(F.col("fold") == i)
        return _with_scores(_fit_all(fitted, rest), part, keep) if fitted else part.select(*keep)

    with ThreadPool(min(k + 1, 6)) as pool:
        *scores, held = pool.map(out_of_fold, range(k + 1))
    oof = scores[0]
    for part in scores[1:]:
        oof = oof.unionByName(part)
    final = _fit_meta(oof, names, meta["C"], meta["maxIter"])
    out = _apply_meta(final, held, names, "stacking")
    return out.select(inputs.id_col, F.col(LABEL).cast("int").alias("target"), *names, "stacking")


# ---- inspection --------------------------------------------------------------

def feature_names(transformed: DataFrame, column: str = FEATURES) -> list[str]:
    """Names of the vector's entries, from the metadata the encoders leave."""
    groups = transformed.schema[column].metadata["ml_attr"]["attrs"]
    entries = sorted((a for kind in groups.values() for a in kind), key=lambda a: a["idx"])
    return [a.get("name", str(a["idx"])) for a in entries]


def feature_importance(model: PipelineModel | BoostedModel | ForestModel, table: DataFrame, top: int = 100) -> DataFrame:
    """``(feature, importance)`` of the largest tree importances or linear coefficients."""
    if isinstance(model, (BoostedModel, ForestModel)):
        rows = list(model.importance.items())
    else:
        last = model.stages[-1]
        values = last.featureImportances if hasattr(last, "featureImportances") else last.coefficients
        # the encoders name the entries; no rows are needed for that
        named = feature_names(PipelineModel(stages=model.stages[:-1]).transform(table.limit(0)))
        rows = [(n, float(v)) for n, v in zip(named, values.toArray())]
    out = table.sparkSession.createDataFrame(rows, "feature string, importance double")
    return out.orderBy(F.desc("importance"), "feature").limit(top)


def fitted_source_weights(df: DataFrame, inputs: Inputs, digits: int = 2, **params) -> dict[str, float]:
    """Importances of the sources in a boosted model over complete rows, rounded."""
    complete = df.dropna(subset=[*inputs.numeric, inputs.target])
    table = model_table(complete, inputs)
    stages = encoding_stages(inputs, scale=False)
    model = Pipeline(stages=[*stages, boosted(**params)]).fit(table)
    importances = model.stages[-1].featureImportances.toArray()
    return {n: round(float(v), digits) for n, v in zip(inputs.numeric, importances)}


# ---- from a model to decisions -------------------------------------------------

def save_model(model: PipelineModel | BoostedModel | ForestModel, path: str) -> str:
    """Write a fitted model, encoders included, to a folder that all machines share."""
    if isinstance(model, (BoostedModel, ForestModel)):
        spark = SparkSession.active()
        spark.createDataFrame([(model.text(),)], "model string").coalesce(1).write.mode("overwrite").parquet(path)
    else:
        model.write().overwrite().save(path)
    return path


def load_model(path: str, kind: str = "pipeline") -> PipelineModel | BoostedModel | ForestModel:
    """A model that was written; ``kind`` is ``pipeline``, ``boosted`` or ``forest`` (of a search)."""
    if kind in ("boosted", "forest"):
        return (BoostedModel if kind == "boosted" else ForestModel).of_text(SparkSession.active().read.parquet(path).first()["model"])
    return PipelineModel.load(path)
