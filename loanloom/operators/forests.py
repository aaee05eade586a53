"""Random forests of a search, grown in step: the trees of all draws share every pass over the rows.

Numbers become at most BINS bins, categories codes; a feature is a number or the flag of one category. A level of many trees
is one job: tasks count rows per (tree, node, drawn feature, bin, label), the counts meet by tree, and the best splits are
found there; the driver is sent a split per node. Counts are whole numbers, and the weight of a row in a tree's resample and
the features a node may use follow from seeds, so trees are the same under any partitioning, alone or in step with others.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.core import col
from .boosting import BLOCK_ROWS
from .sampling import POISSON_CDF

BINS = 32  # of a number
SUM_BYTES = 64 << 20  # of the counts a task holds at once
DRAW_BITS = 20
LEAST_GAIN = 1e-12
CLOSED = np.iinfo(np.int32).max
_DRAWS = np.searchsorted(POISSON_CDF, (np.arange(1 << DRAW_BITS) + 0.5) / (1 << DRAW_BITS)).astype(np.uint8)


@dataclass(frozen=True)
class Forest:
    """What a forest learns by; ``strategy`` is the share of the features a node may use, or MLlib's name of one."""

    trees: int = 100
    depth: int = 9
    least_rows: int = 10
    impurity: str = "gini"
    strategy: float | str = "auto"
    seed: int = 123

    def width(self, features: int) -> int:
        """Number of features that a node may use."""
        known = {"auto": math.sqrt(features), "sqrt": math.sqrt(features), "log2": math.log2(max(features, 2)), "all": features, "onethird": features / 3}
        share = known[self.strategy] if self.strategy in known else float(self.strategy) * features
        return min(features, max(1, math.ceil(round(share, 9))))


# ---- features ------------------------------------------------------------------

@dataclass
class Coding:
    """Cut points of numbers and codes of categories (0 is an unknown one), learned from a table."""

    numeric: list[str]
    categorical: list[str]
    cuts: list[np.ndarray]
    groups: list[dict[str, int]]

    def __post_init__(self):
        flags = [(len(self.numeric) + j, g) for j, known in enumerate(self.groups) for g in range(len(known) + 1)]
        self.source = np.array([*range(len(self.numeric)), *(s for s, _ in flags)], np.int64)
        self.code = np.array([*[0] * len(self.numeric), *(g for _, g in flags)], np.int32)
        self.flag = np.arange(len(self.source)) >= len(self.numeric)

    @property
    def names(self) -> list[str]:
        """Names of the features; the first flag of a category is that of unknown values."""
        flags = [f"{c}_flags_{g}" for c, known in zip(self.categorical, self.groups) for g in ["__unknown", *known]]
        return [*self.numeric, *flags]

    def of(self, batch: pa.RecordBatch) -> np.ndarray:
        """The columns x rows matrix of a batch. A number's bin is how many cut points lie below it."""
        out = np.zeros((len(self.numeric) + len(self.categorical), batch.num_rows), np.min_scalar_type(max([BINS, *map(len, self.groups)])))
        for j, c in enumerate(self.numeric):
            out[j] = np.searchsorted(self.cuts[j], batch.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False), side="left")
        for j, c in enumerate(self.categorical):
            coded = batch.column(c).cast(pa.string()).dictionary_encode()
            codes = np.array([self.groups[j].get(v, 0) for v in coded.dictionary.to_pylist()] + [0])
            out[len(self.numeric) + j] = codes[np.asarray(coded.indices.fill_null(len(codes) - 1))]
        return out


def learn_coding(table: DataFrame, numeric: list[str], categorical: list[str]) -> Coding:
    """All values of a number of at most BINS different ones are cut points, else quantiles; all categories are known."""
    def run(batches):
        seen: dict[str, set] = {c: set() for c in numeric}
        for batch in batches:
            for c in numeric:
                if len(seen[c]) <= BINS:
                    values = np.unique(batch.column(c).to_numpy(zero_copy_only=False))
                    seen[c].update(values[~np.isnan(values)][:BINS + 1].tolist())
        found = [(c, v) for c, values in seen.items() for v in sorted(values)[:BINS + 1]]
        yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in found], pa.string()), pa.array([v for _, v in found], pa.float64())], ["name", "value"])

    values: dict[str, list[float]] = {c: [] for c in numeric}
    if numeric:
        numbers = table.select(*[col(c).cast("double").alias(c) for c in numeric])
        for r in numbers.mapInArrow(run, "name string, value double").distinct().collect():
            values[r["name"]].append(r["value"])
        many = [c for c in numeric if len(values[c]) > BINS]
        if many:
            values.update(zip(many, numbers.approxQuantile([f"`{c}`" for c in many], [i / BINS for i in range(1, BINS)], 0.001)))
    cuts = [np.array(sorted(set(values[c]))[:BINS - 1]) for c in numeric]
    groups = [{r[0]: i for i, r in enumerate(table.select(col(c).cast("string")).distinct().dropna().orderBy(c).collect(), 1)} for c in categorical]
    return Coding(list(numeric), list(categorical), cuts, groups)


def row_hash(coding: Coding, id_col: str, label: str) -> Column:
    """What a row's resampling follows from; rows that share an id, or have none, differ in what they hold."""
    return F.xxhash64(*[col(c) for c in (id_col, label, *coding.numeric, *coding.categorical)])


def blocks_of(table: DataFrame, coding: Coding, id_col: str, label: str) -> RDD:
    """The rows as blocks of (labels, hashes, columns x rows matrix), kept as every level reads them."""
    def run(batches):
        held, rows = [], 0

        def block():
            parts = [np.ascontiguousarray(np.concatenate(x, axis=-1)) for x in zip(*held)]
            return pa.RecordBatch.from_arrays([*[pa.array([x.tobytes()], pa.binary()) for x in parts], pa.array([parts[2].dtype.str])], ["y", "h", "x", "kind"])

        for batch in batches:
            y = batch.column("_label").to_numpy(zero_copy_only=False).astype(np.uint8)
            held.append((y, batch.column("_hash").to_numpy(zero_copy_only=False).astype(np.int64), coding.of(batch)))
            rows += batch.num_rows
            if rows >= BLOCK_ROWS:
                yield block()
                held, rows = [], 0
        if rows:
            yield block()

    def arrays(row):
        y = np.frombuffer(row["y"], np.uint8)
        return y, np.frombuffer(row["h"], np.uint64), np.frombuffer(row["x"], row["kind"]).reshape(-1, len(y))

    chosen = table.select(col(label).cast("int").alias("_label"), row_hash(coding, id_col, label).alias("_hash"), *[col(c) for c in [*coding.numeric, *coding.categorical]])
    return chosen.mapInArrow(run, "y binary, h binary, x binary, kind string").rdd.map(arrays).persist(StorageLevel.MEMORY_AND_DISK)


# ---- trees -----------------------------------------------------------------------

class Tree:
    """Arrays over nodes: the feature tested, the largest bin (or the code, of a flag) that decides, the left child, rows per label, weighted gain.

    A leaf tests nothing and is its own child.
    """

    def __init__(self):
        self.feature, self.cut, self.child = np.zeros(1, np.int32), np.full(1, CLOSED, np.int32), np.zeros(1, np.int32)
        self.rows, self.gain, self.open, self.level = np.zeros((1, 2), np.int64), np.zeros(1), np.zeros(1, np.int64), 0

    def split(self, coding: Coding, forest: Forest, found: tuple) -> None:
        """Split the open nodes as found, and open those of their children that may be split again."""
        total, good, feature, cut, left, gain = found
        self.rows[self.open] = total
        at, first, n = self.open[good], len(self.feature), int(good.sum())
        self.feature[at], self.child[at], self.gain[at] = feature[good], first + 2 * np.arange(n), gain[good]
        self.cut[at] = np.where(coding.flag[feature[good]], coding.code[feature[good]], cut[good])
        rows = np.stack([left[good], total[good] - left[good]], axis=1).reshape(-1, 2)
        fresh = first + np.arange(2 * n)
        self.feature, self.cut = np.append(self.feature, np.zeros(2 * n, np.int32)), np.append(self.cut, np.full(2 * n, CLOSED, np.int32))
        self.child, self.rows = np.append(self.child, fresh.astype(np.int32)), np.concatenate([self.rows, rows])
        self.gain = np.append(self.gain, np.zeros(2 * n))
        self.level += 1
        more = (rows.min(axis=1) > 0) & (rows.sum(axis=1) >= 2 * forest.least_rows) & (self.level < forest.depth)
        self.open = fresh[more]

    def plain(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        return self.feature, self.cut, self.child, self.level

    def share(self, weights: np.ndarray) -> np.ndarray:
        """The weighted share of label 1 in each node."""
        w = self.rows * weights
        return w[:, 1] / np.maximum(w.sum(axis=1), 1e-300)


def walked(tree: tuple, x: np.ndarray, rows: np.ndarray, coding: Coding) -> np.ndarray:
    """The node in which each of some rows of a columns x rows matrix ends."""
    feature, cut, child, depth = tree
    values, start, flag = x.ravel(), coding.source[feature] * x.shape[1], coding.flag[feature] & (cut != CLOSED)
    at = np.zeros(len(rows), np.int32)
    for _ in range(depth):
        v, limit = values[start[at] + rows], cut[at]
        at = child[at] + np.where(flag[at], v == limit, v > limit)
    return at


def drawn(h: np.ndarray, salt: int) -> np.ndarray:
    """How often each row is in a tree's resample (Poisson with mean 1), from its hash."""
    x = (h ^ np.uint64(salt)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    return _DRAWS[x >> np.uint64(64 - DRAW_BITS)]


def _impurity(w: np.ndarray, kind: str) -> np.ndarray:
    p = w / np.maximum(w.sum(axis=-1, keepdims=True), 1e-300)
    if kind == "gini":
        return 1 - (p * p).sum(axis=-1)
    return -(p * np.log2(np.where(p > 0, p, 1.0))).sum(axis=-1)


def best_splits(own: np.ndarray, picked: np.ndarray, weights: np.ndarray, forest: Forest) -> tuple:
    """(rows per label, whether to split, feature, cut, rows per label that go left, weighted gain) of nodes from nodes x features x bins x labels."""
    total = own[:, 0].sum(axis=1)
    left = np.cumsum(own, axis=2)[:, :, :-1]
    right = total[:, None, None] - left
    lw, rw, tw = left * weights, right * weights, total * weights
    whole = np.maximum(tw.sum(axis=-1), 1e-300)
    below = (lw.sum(axis=-1) * _impurity(lw, forest.impurity) + rw.sum(axis=-1) * _impurity(rw, forest.impurity)) / whole[:, None, None]
    gain = _impurity(tw, forest.impurity)[:, None, None] - below
    gain[np.minimum(left.sum(axis=-1), right.sum(axis=-1)) < max(forest.least_rows, 1)] = -1.0
    flat, nodes = gain.reshape(len(own), -1), np.arange(len(own))
    best = flat.argmax(axis=1)
    j, cut = np.divmod(best, gain.shape[2])
    top = flat[nodes, best]
    return total, top > LEAST_GAIN, picked[nodes, j], cut, left[nodes, j, cut], top * whole


def _level(blocks: RDD, asked: dict[int, tuple], coding: Coding, weights: np.ndarray, tasks: int) -> dict[int, tuple]:
    """Best splits of the open nodes of some trees (nodes, their spots, drawn features, salt, settings): one job."""
    shared = blocks.context.broadcast(asked)

    def run(held):
        sums: dict[int, np.ndarray] = {}
        for y, h, x in held:
            values, labels = x.ravel(), y.astype(np.int64)
            for key, (tree, spots, picked, salt, _) in shared.value.items():
                times = drawn(h, salt)
                rows = np.flatnonzero(times)
                spot = spots[walked(tree, x, rows, coding)]
                inside = np.flatnonzero(spot >= 0)
                if len(inside) < len(rows):
                    rows, spot = rows[inside], spot[inside]
                if not len(rows):
                    continue
                own = sums.setdefault(key, np.zeros((picked.shape[0], picked.shape[1], BINS, 2), np.uint32))
                times, base = times[rows].astype(np.float64), spot * (2 * BINS) + labels[rows]
                for j in range(picked.shape[1]):
                    f = picked[spot, j]
                    v = values[coding.source[f] * len(y) + rows]
                    v = np.where(coding.flag[f], v == coding.code[f], v)
                    own[:, j] += np.bincount(base + 2 * v.astype(np.int64), times, len(own) * BINS * 2).astype(np.uint32).reshape(-1, BINS, 2)
        yield from sums.items()

    def split(item):
        key, own = item
        _, _, picked, _, forest = shared.value[key]
        return key, best_splits(own.astype(np.int64), picked, weights, forest)

    try:
        return dict(blocks.mapPartitions(run).reduceByKey(lambda a, b: a.astype(np.int64) + b, min(tasks, len(asked))).map(split).collect())
    finally:
        shared.destroy()


def grow(blocks: RDD, coding: Coding, weights: np.ndarray, forests: dict[int, Forest], grown: dict[int, list[Tree]]) -> None:
    """Add to the trees of each forest in ``grown`` those it lacks; ``weights`` are those of the labels 0 and 1.

    What a task holds is bounded by SUM_BYTES and one tree; trees beyond that wait for the next job.
    """
    tasks, features, todo = max(1, blocks.getNumPartitions()), len(coding.source), []
    for i, forest in forests.items():
        mine = grown.setdefault(i, [])
        while len(mine) < forest.trees:
            todo.append((forest, len(mine), tree := Tree()))
            mine.append(tree)
    while todo:
        asked, size = {}, 0

        def finish():
            found = _level(blocks, asked, coding, weights, tasks)
            for key in asked:
                forest, _, tree = todo[key]
                if key in found:
                    tree.split(coding, forest, found[key])
                else:
                    tree.open = tree.open[:0]  # no row is in the resample

        for key, (forest, number, tree) in enumerate(todo):
            seed = np.random.SeedSequence((forest.seed, number))
            rng, width = np.random.default_rng((forest.seed, number, tree.level)), forest.width(features)
            more = len(tree.open) * width * BINS * 2 * 4
            if asked and size + more > SUM_BYTES:
                finish()
                asked, size = {}, 0
            spots = np.full(len(tree.feature), -1, np.int64)
            spots[tree.open] = np.arange(len(tree.open))
            picked = np.argsort(rng.random((len(tree.open), features)), axis=1)[:, :width]
            asked[key] = (tree.plain(), spots, picked, int(seed.generate_state(1, np.uint64)[0]), forest)
            size += more
        finish()
        todo = [(f, n, t) for f, n, t in todo if len(t.open)]


def scored(df: DataFrame, coding: Coding, weights: np.ndarray, forests: dict[str, list[Tree]], keep: list[str]) -> DataFrame:
    """The columns ``keep`` and each forest's mean over its trees of the weighted share of label 1, in one pass over the rows."""
    shared = df.sparkSession.sparkContext.broadcast({m: [(t.plain(), t.share(weights)) for t in trees] for m, trees in forests.items()})
    kinds = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name in keep] + [f"`{m}` double" for m in forests])
    names, kept = list(forests), [f.name for f in df.schema if f.name in keep]

    def run(batches):
        for batch in batches:
            x, rows = coding.of(batch), np.arange(batch.num_rows)
            out = [batch.column(c) for c in kept]
            for m in names:
                total = np.zeros(len(rows))
                for tree, p in shared.value[m]:
                    total += p[walked(tree, x, rows, coding)]
                out.append(pa.array(total / len(shared.value[m])))
            yield pa.RecordBatch.from_arrays(out, [*kept, *names])

    return df.select(*[col(c) for c in dict.fromkeys([*kept, *coding.numeric, *coding.categorical])]).mapInArrow(run, kinds)


@dataclass
class ForestModel:
    """A grown forest with what it needs to score rows; ``weights`` are those of the labels 0 and 1."""

    coding: Coding
    weights: np.ndarray
    trees: list[Tree]

    def score(self, df: DataFrame, name: str = "proba") -> DataFrame:
        """``df`` with the probability of label 1."""
        return scored(df, self.coding, self.weights, {name: self.trees}, [c for c in df.columns if c != name])

    @property
    def importance(self) -> dict[str, float]:
        """Each feature's share of a tree's weighted gains, averaged over the trees that split."""
        total = np.zeros(len(self.coding.source))
        for t in self.trees:
            if t.gain.sum() > 0:
                total += np.bincount(t.feature, t.gain, len(total)) / t.gain.sum()
        whole = total.sum()
        return dict(zip(self.coding.names, (total / whole if whole else total).tolist()))

    def text(self) -> str:
        """The model as JSON."""
        c = self.coding
        return json.dumps({
            "numeric": c.numeric, "categorical": c.categorical, "cuts": [x.tolist() for x in c.cuts], "groups": c.groups, "weights": self.weights.tolist(),
            "trees": [[*(x.tolist() for x in (t.feature, t.cut, t.child, t.rows, t.gain)), t.level] for t in self.trees]})

    @staticmethod
    def of_text(text: str) -> ForestModel:
        d, trees = json.loads(text), []
        for feature, cut, child, rows, gain, level in d["trees"]:
            trees.append(t := Tree())
            t.feature, t.cut, t.child = (np.array(x, np.int32) for x in (feature, cut, child))
            t.rows, t.gain, t.level, t.open = np.array(rows, np.int64), np.array(gain, float), level, t.open[:0]
        return ForestModel(Coding(d["numeric"], d["categorical"], [np.array(x, float) for x in d["cuts"]], d["groups"]), np.array(d["weights"]), trees)


def train(table: DataFrame, numeric: list[str], categorical: list[str], forest: Forest, id_col: str, label: str, weights: np.ndarray) -> ForestModel:
    """One forest over all rows of a table."""
    coding, grown = learn_coding(table, numeric, categorical), {}
    blocks = blocks_of(table, coding, id_col, label)
    try:
        grow(blocks, coding, weights, {0: forest}, grown)
    finally:
        blocks.unpersist()
    return ForestModel(coding, weights, grown[0])
