"""Positive-unlabelled learning: held-out quality, the estimator, odd rows."""

import random

import numpy as np

from loanloom.llm import toxicity as X


def corpus(n):
    rnd = random.Random(8)
    rows, labels = [], []
    for i in range(n):
        words = ["".join(rnd.choice(["an", "er", "st", "ion", "th", "ou"]) for _ in range(rnd.randrange(1, 4))) for _ in range(rnd.randrange(20, 200))]
        toxic = rnd.random() < 0.12
        for _ in range(rnd.randrange(2, 6) if toxic else 0):
            words.insert(rnd.randrange(len(words)), rnd.choice(["vileword", "nastything", "badabra" + rnd.choice("abcdefg")]))
        rows.append((i, " ".join(words)))
        if rnd.random() < 0.6:
            labels.append((i, int(toxic)))
    return rows, labels, {i for i, t in rows if any(w in t for w in ("vile", "nasty", "badabra"))}


def test_held_out_quality_and_odd_rows(spark):
    rows, labels, toxic = corpus(2500)
    odd = [(9001, None), (9002, ""), (None, "vileword nastything vileword"), (9003, "th ou " * 300_000), (9004, "vileword nastything " + "ou er " * 100)]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows + odd], "doc_id long, text string, score int, toxic string")
    marks = spark.createDataFrame([(i, 0, x) for i, x in labels + [(None, 1), (1, None)]], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in X.rate_documents(docs, marks).collect()}
    assert len(got) == len(rows) + len(odd)
    held = [i for i, _ in rows if got[i].held_out]
    hit = [got[i].predicted for i in held if i in toxic]
    miss = [got[i].predicted for i in held if i not in toxic]
    assert np.mean(hit) > 0.95 and np.mean(miss) < 0.01
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got.values())
    assert got[9001].predicted == got[9002].predicted == got[9003].predicted == 0 and got[9004].predicted == 1
    flipped = marks.withColumn("toxic", X.F.when(X.held_out("doc_id", 3, 1), 1 - X.F.col("toxic")).otherwise(X.F.col("toxic")))
    again = {r.doc_id: r.score for r in X.rate_documents(docs.repartition(7), flipped).collect()}
    assert all(again[i] == r.score for i, r in got.items())


def test_rare_features_beside_many_common_ones(spark):
    rnd = random.Random(3)
    common = " ".join("".join(rnd.choices("abcdefghijklmnopqrstuvwxyz", k=12)) for _ in range(3500))  # 24,500 features
    F = X.F
    docs = spark.range(360).withColumnRenamed("id", "doc_id")
    docs = docs.select("doc_id", F.concat(F.lit(common), F.when(F.col("doc_id") < 6, " vileword").otherwise("")).alias("text"))
    marks = spark.createDataFrame([(i, int(i < 60)) for i in range(360)], "doc_id long, toxic int")
    model = X.train(docs, marks)
    want = {int(h) for found, _ in X.Extractor().hashes(X.pa.array(["vileword"])) for h in found}
    assert {int(h) for h in model.known} == want
    twice = X.train(docs.union(docs.filter("doc_id < 60")), marks)  # copies of a document count in its kind's rate
    assert {int(h) for h in twice.known} == want


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(2, "a b"), (3, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r.score for r in X.rate_documents(docs, none).collect()] == [0.0, 0.0]
    assert X.rate_documents(docs.limit(0), none).count() == 0


def test_estimator_is_kept_above_zero():
    rng = np.random.default_rng(1)
    hidden = rng.random(4000) < 0.3
    unlabelled = [np.array([0 if h else 1, 2 + int(rng.integers(200))]) for h in hidden]
    positive = [np.array([0, 2 + int(rng.integers(200))]) for _ in range(60)]
    weights, bias, turned = X.nn_pu_fit(positive, unlabelled, 0.3, 202, steps=800)
    assert turned > 0 and weights[0] + bias > 0 > weights[1] + bias
    z = np.array([weights[s].sum() + bias for s in unlabelled])
    assert np.mean((z > 0) == hidden) > 0.95
