"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts are the positives; other texts count as unlabelled, a mixture with
a class prior. A linear classifier is trained on the estimator
``prior * R_p(+) + (1 - prior) / (1 - mixed) * max(0, R_u(-) - mixed * R_p(-))``, ``mixed``
being the share of toxic ones among the unlabelled: where the corrected risk of the
negatives falls below zero, its gradient is turned round, so the model cannot overfit by
pushing the unlabelled texts below their true risk.

Features are words and beginnings of words, in lower case, each present or not, present
twice or more, and frequent or not for the length of the text, and the magnitude of that
length. All features of the positives are compared with the unlabelled texts on Spark;
only those that mark out the positives are used, the FEATURES clearest where there are
more, which is the size of the model.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .batches import Words, mix, rows_of, slices
from .decontaminate import _BREAK, tokens_of
from .langid import held_out

PREFIXES = (None, 5, 6, 7, 8, 9, 10)
POSITIVES = 2000
UNLABELLED = 6000
FEATURES = 4096
LEVELS = 4
LENGTHS = 24
STEPS = 1200
BATCH = 512
RATE = 0.05
L2 = 3e-4
SLACK = 0.0
THRESHOLD = 0.7
_PLACE_BITS = 20
_WAITING = 1 << 20
_STEP = 0xC2B2AE3D27D4EB4F


class Extractor:
    """Feature hashes of texts: the words, and their first bytes."""

    def __init__(self):
        self.words = [Words(_BREAK, np.arange(256, dtype=np.uint8), most=k) for k in PREFIXES]

    def hashes(self, texts: pa.Array):
        """(feature hashes, word bounds) for whole words and for each length of beginnings."""
        for i, words in enumerate(self.words):
            found, bounds = tokens_of(words, texts)
            yield mix(found + np.uint64((i + 1) * _STEP % (1 << 64))), bounds


class Lookup:
    """Numbers of known feature hashes."""

    def __init__(self, known: np.ndarray):
        self.known = known  # sorted
        self.places = np.zeros(1 << _PLACE_BITS, bool)
        self.places[known & np.uint64((1 << _PLACE_BITS) - 1)] = True
        self.extract = Extractor()

    def sets(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Feature numbers of each text, and how many come before each.

        Feature f has numbers f * LEVELS (present), + 1 (twice or more), + 2 (one word in
        200 or more, twice at least), + 3 (one in 50); then come those of the length.
        """
        keys, n = [], len(texts)
        size = len(self.known)
        for hashes, bounds in self.extract.hashes(texts):
            near = np.flatnonzero(self.places[hashes & np.uint64((1 << _PLACE_BITS) - 1)]) if size else np.zeros(0, np.int64)
            at = np.minimum(np.searchsorted(self.known, hashes[near]), max(size - 1, 0))
            hit = self.known[at] == hashes[near] if size else np.zeros(0, bool)
            keys.append(rows_of(bounds)[near][hit] * size + at[hit])
        length = np.diff(bounds)
        key, count = np.unique(np.concatenate(keys), return_counts=True)
        row, feature = key // max(size, 1), key % max(size, 1)
        rate = count / np.maximum(length[row], 1)
        passed = [np.ones(len(key), bool), count >= 2, (count >= 2) & (rate >= 0.005), (count >= 2) & (rate >= 0.02)]
        rows = np.concatenate([row[p] for p in passed] + [np.arange(n)])
        kind = np.frexp(length.astype(np.float64))[1]
        numbers = np.concatenate([feature[p] * LEVELS + i for i, p in enumerate(passed)] + [size * LEVELS + np.minimum(kind, LENGTHS - 1)])
        order = np.argsort(rows, kind="stable")
        return numbers[order], np.searchsorted(rows[order], np.arange(n + 1))


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


@dataclass
class Model:
    """Known features, the weight of each number of :class:`Lookup`, and a bias."""

    known: np.ndarray
    weights: np.ndarray
    bias: float

    def scorer(self):
        lookup = Lookup(self.known)

        def score(texts: pa.Array) -> np.ndarray:
            numbers, bounds = lookup.sets(texts)
            # each text's own sum, so that a score does not depend on the texts beside it
            sums = np.bincount(rows_of(bounds), self.weights[numbers], len(bounds) - 1)
            return sigmoid(sums + self.bias)

        return score


def nn_pu_fit(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, size: int, steps: int = STEPS,
              batch: int = BATCH, rate: float = RATE, l2: float = L2, slack: float = SLACK, seed: int = 0,
              mixed: float | None = None) -> tuple[np.ndarray, float, int]:
    """(weights, bias, corrections) of a linear classifier on sets of feature numbers below ``size``.

    ``mixed`` is the share of positives among the unlabelled, ``prior`` where it is not given.

    The sigmoid loss, steps of Adam on batches of both kinds; ``corrections`` counts the
    steps that undid a negative part of the risk.
    """
    rng = np.random.default_rng(seed)
    w, m, v = np.zeros(size + 1), np.zeros(size + 1), np.zeros(size + 1)
    turned, mixed = 0, prior if mixed is None else mixed

    def flat(rows):
        return np.concatenate(rows), np.concatenate(([0], np.cumsum([len(r) for r in rows])))

    def picked(numbers, bounds):
        chosen = rng.integers(0, len(bounds) - 1, batch)
        lengths = bounds[chosen + 1] - bounds[chosen]
        row = np.repeat(np.arange(batch), lengths)
        at = np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths) + np.repeat(bounds[chosen], lengths)
        return np.append(numbers[at], np.full(batch, size)), np.append(row, np.arange(batch))

    pos, unl = flat(positive), flat(unlabelled)
    for step in range(1, steps + 1):
        (pf, pr), (uf, ur) = picked(*pos), picked(*unl)
        # calling z negative costs sigmoid(z), calling it positive sigmoid(-z)
        sp, su = sigmoid(np.bincount(pr, w[pf], batch)), sigmoid(np.bincount(ur, w[uf], batch))
        dp, du = sp * (1 - sp) / batch, su * (1 - su) / batch
        gp = np.bincount(pf, dp[pr], size + 1)
        gn = (1 - prior) / (1 - mixed) * (np.bincount(uf, du[ur], size + 1) - mixed * gp)
        if su.mean() - mixed * sp.mean() < -slack:
            turned += 1
            g = -gn
        else:
            g = gn - prior * gp
        g[:size] += l2 * w[:size]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    return w[:size], float(w[size]), turned


def telling(counts: DataFrame, n_pos: int, n_other: int, most: int = FEATURES) -> DataFrame:
    """Of ``counts`` (feature, positive, other) the features whose rate among positives exceeds that elsewhere clearly and by half, the clearest ``most``."""
    positive, other = F.col("positive"), F.col("other")
    p, u = positive / F.lit(float(n_pos)), other / F.lit(float(n_other))
    mean = (positive + other) / F.lit(float(n_pos + n_other))
    error = F.sqrt(F.greatest(mean * (1 - mean), F.lit(1e-12)) * (1 / n_pos + 1 / n_other))
    good = counts.withColumn("z", (p - u) / error).filter((F.col("z") > 4) & (positive >= max(3, n_pos // 200)) & (p > 1.5 * u))
    return good.orderBy(F.desc("z"), "feature").limit(most)


def fit(known: np.ndarray, positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, mixed: float) -> Model:
    """Fit the weights of the known features and of the lengths."""
    weights, bias, _ = nn_pu_fit(positive, unlabelled, prior, len(known) * LEVELS + LENGTHS, mixed=mixed)
    return Model(known, weights, bias)


def train(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> Model | None:
    """Learn from ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic), which are read twice.

    The sample is the ``positives`` toxic and ``unlabelled`` other documents of least id
    hash, so it is bounded and the same under any partitioning; ids are only used to pick
    it. The prior is the share of toxic ones among labelled documents (a null label is
    none); were documents without a label as often toxic, the others would hold the share
    ``mixed`` of toxic ones. None where there are no positives or no others.
    """
    ids = docs.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count(F.lit(1)).alias("copies"))
    marks = labels.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rows = ids.join(marks, "doc_id", "left")
    every, labelled, toxic_ones = rows.agg(F.count(F.lit(1)), F.count("toxic"), F.count(F.when(F.col("toxic") == 1, 1))).first()

    def least(kind, n: int) -> dict[int, int]:
        return {r.doc_id: r.copies for r in rows.filter(kind).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n).select("doc_id", "copies").collect()}

    toxic = F.coalesce(F.col("toxic"), F.lit(0)) == 1
    pos, unl = least(toxic, positives), least(~toxic, unlabelled)
    if not pos or not unl:
        return None
    prior = toxic_ones / labelled
    mixed = prior * (every - labelled) / (every - toxic_ones)
    wanted = {i: 1 for i in pos} | {i: 0 for i in unl}

    def chosen(batches):
        for batch in slices(batches, 1):
            kind = np.array([wanted.get(i, -1) for i in batch.column(0).to_pylist()])
            at = np.flatnonzero(kind >= 0)
            if len(at):
                yield batch.take(pa.array(at)), kind[at]

    def count(batches):
        extract, found, waiting = Extractor(), [], 0

        def summed(parts):
            features, at = np.unique(np.concatenate([f for f, _ in parts]), return_inverse=True)
            return features, np.stack([np.bincount(at, np.concatenate([n[k] for _, n in parts]), len(features)).astype(np.int32) for k in (0, 1)])

        for batch, kind in chosen(batches):
            for hashes, bounds in extract.hashes(batch.column(1)):
                row = rows_of(bounds)
                order = np.lexsort((hashes, row))
                row, hashes = row[order], hashes[order]
                new = np.ones(len(row), bool)
                new[1:] = (row[1:] != row[:-1]) | (hashes[1:] != hashes[:-1])
                of = kind[row[new]]
                found.append((hashes[new], np.stack([of == 0, of == 1]).astype(np.int32)))
                waiting += int(new.sum())
            if waiting > _WAITING:
                found, waiting = [summed(found)], 0
        if found:
            features, n = summed(found)
            yield pa.RecordBatch.from_arrays([pa.array(features.view(np.int64)), *[pa.array(n[k].astype(np.int64)) for k in (1, 0)]], ["feature", "positive", "other"])

    texts = docs.select("doc_id", "text")
    counts = texts.mapInArrow(count, "feature long, positive long, other long").groupBy("feature").agg(
        F.sum("positive").alias("positive"), F.sum("other").alias("other"))
    clearest = telling(counts, sum(pos.values()), sum(unl.values())).select("feature").toArrow()
    known = np.sort(clearest["feature"].to_numpy().view(np.uint64))

    def sets(batches):
        lookup = Lookup(known)
        for batch, kind in chosen(batches):
            numbers, bounds = lookup.sets(batch.column(1))
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(kind.astype(np.int64)),
                pa.ListArray.from_arrays(bounds.astype(np.int32), numbers.astype(np.int32))], ["doc_id", "kind", "numbers"])

    table = texts.mapInArrow(sets, "doc_id long, kind long, numbers array<int>").dropDuplicates(["doc_id"]).orderBy("doc_id").toArrow()
    numbers = [x.values.to_numpy().astype(np.int64) for x in table["numbers"]]
    kinds = table["kind"].to_pylist()
    return fit(known, [r for r, k in zip(numbers, kinds) if k == 1], [r for r, k in zip(numbers, kinds) if k == 0], prior, mixed)


def score(df: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """The rows of ``df`` with ``score`` (0 to 1) and ``predicted`` (1 from 0.7 on); columns of these names are replaced.

    Null and empty texts are scored as texts without words; without a model every score is 0.
    """
    kept = [c for c in df.columns if c not in ("score", "predicted")]
    at = kept.index(text)
    shared = df.sparkSession.sparkContext.broadcast(model and (model.known, model.weights, model.bias))
    rows = df.select(*[F.col(f"`{c}`") for c in kept])

    def run(batches):
        scorer = shared.value and Model(*shared.value).scorer()
        for batch in slices(batches, at):
            found = scorer(batch.column(at)) if scorer else np.zeros(batch.num_rows)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(found), pa.array((found >= THRESHOLD).astype(np.int32))], names=[*batch.schema.names, "score", "predicted"])

    schema = rows.withColumn("score", F.lit(0.0)).withColumn("predicted", F.lit(0)).schema
    for field in schema:
        field.nullable = True
    return rows.mapInArrow(run, schema)


def rate_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document; learns from labels of rows not held out."""
    marked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), held_out("doc_id", 3, 1).alias("held_out"))
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "toxic").filter(~held_out("doc_id", 3, 1))
    return score(marked, train(marked.filter("NOT held_out"), known)).drop("text")
