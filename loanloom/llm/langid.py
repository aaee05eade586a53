"""Language identification: sparse multinomial logistic regression on TF-IDF of character n-grams.

Learning: document frequencies are counted over all labelled texts; weights are fitted
with follow-the-regularised-leader and elastic-net penalties on a bounded sample of them;
a temperature fitted on texts kept out of that makes the scores probabilities.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window, functions as F

from .batches import slices

GRAMS = (1, 2, 3, 4)
BUCKET_BITS = 15
BUCKETS = 1 << BUCKET_BITS
SAMPLE_ROWS = 4000
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.0005
CALIBRATION_SHARE = 4  # one in so many sample rows fits the temperature only
LEAST_SHARE = 0.001  # of right predictions for these, the share whose score counts as low
UNKNOWN = "und"
_BREAKS = re.compile(r"[\W\d_]+")
_LETTER = regex.compile(r"\p{L}")  # Unicode category L: neither numerals like U+2167 nor fractions
_STEP = np.uint32(0x9E3779B1)
_BLOCK_CHARS = 1 << 20


def gram_counts(text: str) -> np.ndarray:
    """How often each hash bucket's n-grams occur in the letters of a text.

    Letters are lower-cased, everything else is a single space; no n-gram spans more
    than one break. Long texts are counted in blocks that overlap by an n-gram less a
    letter; an n-gram counts in the block in which it starts.
    """
    total = np.zeros(BUCKETS, np.int64)
    if not text:
        return total
    plain, over = " " + _BREAKS.sub(" ", text.lower()) + " ", max(GRAMS) - 1
    for at in range(0, len(plain), _BLOCK_CHARS):
        codes = np.frombuffer(plain[at:at + _BLOCK_CHARS + over].encode("utf-32-le", "surrogatepass"), "<u4")
        fold = np.zeros(len(codes), np.uint32)
        for n in range(1, max(GRAMS) + 1):
            if len(codes) < n:
                break
            fold = (fold[:len(codes) - n + 1] ^ (fold[:len(codes) - n + 1] >> np.uint32(15))) * _STEP + codes[n - 1:]
            if n in GRAMS:
                own = fold[:_BLOCK_CHARS]
                mixed = (own ^ (own >> np.uint32(16))) * np.uint32(0x85EBCA6B)
                total += np.bincount(mixed >> np.uint32(32 - BUCKET_BITS), minlength=BUCKETS)
    return total


@dataclass
class Model:
    """Weights per bucket and language, inverse document frequencies, a temperature, and the score below which no language stands out."""

    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    least: float = 0.0

    def features(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        return weigh(gram_counts(text), self.idf)

    def predict(self, text: str | None) -> tuple[str, float]:
        """The likeliest language and its probability; ``und`` with 0 for a text without letters."""
        if not text or not _LETTER.search(text) or not self.languages:
            return UNKNOWN, 0.0
        at, values = self.features(text)
        p = softmax((values @ self.weights[at] + self.bias) / self.temperature)
        best = int(np.argmax(p))
        return self.languages[best], float(p[best])


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def weigh(counts: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of a text with their TF-IDF weights, of unit length."""
    at = np.flatnonzero((counts > 0) & (idf > 0))
    values = (1 + np.log(counts[at])) * idf[at]
    norm = np.sqrt((values * values).sum())
    return at, values / norm if norm else values


def document_frequencies(texts: DataFrame) -> tuple[np.ndarray, int]:
    """In how many texts each bucket occurs, and the number of texts, over all rows.

    A task returns one row per bucket it met, so what is gathered is bounded by the
    number of buckets.
    """
    def run(batches):
        met, rows = np.zeros(BUCKETS, np.int64), 0
        for batch in slices(batches, 0):
            for text in batch.column(0).to_pylist():
                if text and _LETTER.search(text):
                    met += gram_counts(text) > 0
                    rows += 1
        at = np.flatnonzero(met)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(met[at], rows))], ["bucket", "n"])

    found = texts.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    counts = dict(zip(found["bucket"].tolist(), found["n"].tolist()))
    rows = counts.pop(-1, 0)
    met = np.zeros(BUCKETS, np.int64)
    met[list(counts)] = list(counts.values())
    return met, int(rows)


def fit_ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], classes: int, epochs: int = EPOCHS, alpha: float = ALPHA,
             beta: float = BETA, l1: float = L1, l2: float = L2, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Follow-the-regularised-leader per coordinate: weights stay 0 until their gradients outweigh ``l1``."""
    z, n = np.zeros((BUCKETS + 1, classes)), np.zeros((BUCKETS + 1, classes))

    def weights(zs, ns):
        w = -(zs - np.sign(zs) * l1) / ((beta + np.sqrt(ns)) / alpha + l2)
        return np.where(np.abs(zs) <= l1, 0.0, w)

    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            at, values, label = rows[i]
            at, values = np.append(at, BUCKETS), np.append(values, 1.0)  # the last one is the bias
            w = weights(z[at], n[at])
            p = softmax(values @ w)
            p[label] -= 1
            g = values[:, None] * p
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - sigma * w
            n[at] += g * g
    w = weights(z, n)
    return w[:-1], w[-1]


def fit_temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of least log loss, by golden-section search of its logarithm."""
    if not len(labels):
        return 1.0

    def loss(t: float) -> float:
        return float(-np.log(np.maximum(softmax(logits / np.exp(t))[np.arange(len(labels)), labels], 1e-12)).mean())

    low, high, step = np.log(0.05), np.log(20.0), (5 ** 0.5 - 1) / 2
    for _ in range(40):
        a, b = high - step * (high - low), low + step * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def least_score(scores: np.ndarray, languages: int) -> float:
    """Halfway, in log odds, from chance (one in ``languages``) to the LEAST_SHARE quantile of the scores of right predictions.

    The quantile of n scores counts as n / (n + 1) at most, as so few cannot vouch for more. Chance
    where there are none, which rejects nothing; a single language always has score 1.
    """
    def odds(p: float) -> float:
        p = min(max(p, 1e-9), 1 - 1e-9)
        return float(np.log(p / (1 - p)))

    chance = 1 / languages
    low = max(min(float(np.quantile(scores, LEAST_SHARE)), len(scores) / (len(scores) + 1)), chance) if len(scores) else chance
    return 1 / (1 + float(np.exp(-(odds(chance) + odds(low)) / 2)))


def train(labelled: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Learn from ``labelled`` (text, lang); rows without text, letters or lang teach nothing.

    The sample is, for each language, the ``sample_rows / languages`` different texts of
    least hash; texts are taken whole. They are reduced to bucket counts on Spark before
    they reach the driver.
    """
    labelled = labelled.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).filter(
        "text IS NOT NULL AND lang IS NOT NULL")
    met, total = document_frequencies(labelled)
    names = sorted(r.lang for r in labelled.select("lang").distinct().collect())
    idf = np.where(met > 0, np.log((1 + total) / (1 + met)) + 1, 0.0)
    empty = Model([], idf, np.zeros((BUCKETS, 0)), np.zeros(0))
    if not names or not total:
        return empty
    hashed = labelled.withColumn("h", F.xxhash64("text"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("h"))  # limits groups before its exchange
    rows = hashed.select("h", "lang").distinct().withColumn("place", place).filter(F.col("place") <= -(-sample_rows // len(names)))
    keys = [(r.h, r.lang) for r in rows.collect()]
    wanted = frozenset(keys)

    def run(batches):
        sent = set()
        for batch in slices(batches, 0):
            out = []
            for text, name, h in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if (h, name) in wanted and (h, name) not in sent and _LETTER.search(text):
                    sent.add((h, name))
                    counts = gram_counts(text)
                    at = np.flatnonzero(counts)
                    out.append((h, name, at.astype(np.int32).tolist(), counts[at].astype(np.int32).tolist()))
            if out:
                h, name, at, counts = zip(*out)
                yield pa.RecordBatch.from_arrays([
                    pa.array(h, pa.int64()), pa.array(name), pa.array(at, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int32()))],
                    ["h", "lang", "at", "counts"])

    table = hashed.select("text", "lang", "h").mapInArrow(run, "h long, lang string, at array<int>, counts array<int>").dropDuplicates(["h", "lang"]).toArrow()
    got = {}
    for h, name, at, counts in zip(*(table[c] for c in ("h", "lang", "at", "counts"))):
        whole = np.zeros(BUCKETS, np.int64)
        whole[at.values.to_numpy()] = counts.values.to_numpy()
        got[h.as_py(), name.as_py()] = weigh(whole, idf)
    used = [(*got[k], names.index(k[1])) for k in sorted(got)]
    kept = [r for i, r in enumerate(used) if i % CALIBRATION_SHARE] or used
    held = [r for i, r in enumerate(used) if not i % CALIBRATION_SHARE]
    weights, bias = fit_ftrl(kept, len(names))
    model = Model(names, idf, weights, bias)
    if held:
        logits = np.array([v @ weights[at] + bias for at, v, _ in held])
        labels = np.array([y for _, _, y in held])
        model.temperature = fit_temperature(logits, labels)
        p = softmax(logits / model.temperature)
        model.least = least_score(p.max(axis=1)[p.argmax(axis=1) == labels], len(names))
    return model


def predict(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows of ``df`` with ``lang_pred`` and ``score`` (the calibrated probability of it).

    ``und`` and 0 where the text is null or has no letter. Only the text is looked at;
    columns of these names are replaced.
    """
    kept = [c for c in df.columns if c not in ("lang_pred", "score")]
    at = kept.index(text)
    shared = df.sparkSession.sparkContext.broadcast((model.languages, model.idf, model.weights, model.bias, model.temperature))
    rows = df.select(*[F.col(f"`{c}`") for c in kept])

    def run(batches):
        own = Model(*shared.value)
        for batch in slices(batches, at):
            found = [own.predict(t) for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                names=[*batch.schema.names, "lang_pred", "score"])

    schema = rows.withColumn("lang_pred", F.lit("").cast("string")).withColumn("score", F.lit(0.0)).schema
    for field in schema:
        field.nullable = True
    return rows.mapInArrow(run, schema)


def held_out(key: str, folds: int, fold: int) -> Column:
    """Whether crc32 of the key's text leaves ``fold``; a null key counts as empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % folds == fold


def identify(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text, lang) with ``held_out``, ``lang_pred`` and ``score``; learns from rows not held out."""
    marked = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang"), held_out("doc_id", 4, 2).alias("held_out"))
    model = train(marked.filter("NOT held_out"))
    return predict(marked.select("doc_id", "held_out", "text"), model).drop("text")
