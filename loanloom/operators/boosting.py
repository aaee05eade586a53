"""Second-order boosted trees whose histograms are Spark aggregates; many models grow in step.

Features become at most 256 bins, and rows are kept in blocks, a byte per row and feature.
A level of all trees of all models is one job: tasks turn their rows into sums of gradients and hessians per (model,
node, feature, bin), these meet by model and a few nodes, and the best splits are found there; of a few models
and tasks the driver adds up the sums and finds the splits. Gradients are added as
integers (``UNIT`` steps to one), so results do not depend on how rows are partitioned.

Trees are grown level by level but kept best first: a node is split before another
exactly if the least gain on its path is larger, so a level leaves out what cannot be
among the ``leaves`` best, and the tree of a best-first learner with that limit results.

Models differ in settings and in the parts of the table they learn from: the folds of a
stack, a validation part, or the draws of a search share every pass over the rows.
"""

from __future__ import annotations

import heapq
import itertools
import json
import math
import pickle
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.core import col
from ..sources.tables import materialized, new_path
from .ordered import exact_quantiles

UNIT = 1 << 20
BINS = 64  # of a number; a category has up to MOST_BINS
MOST_BINS = 256
FEW_TASKS = 64  # models x tasks whose sums are added up without an exchange
FEW_MODELS = 3
SPOTS = 8  # nodes of a model whose sums meet in one task
BLOCK_ROWS = 1 << 16
BLOCK_BYTES = 16 << 20  # of the scores in a block
LOCAL_ROWS = 10_000  # of a node that one task may finish
WRITE_EVERY = 10  # rounds after which the scores are written to the shared folder
LEAST_HESSIAN = 1e-3
LEAST_GAIN = 1e-9
CATEGORY_SMOOTHING = 10.0  # hessian added where categories are put in order


@dataclass(frozen=True)
class Settings:
    """What a model learns by; ``patience`` rounds without a smaller validation loss end it (0: never)."""

    rounds: int = 100
    rate: float = 0.1
    depth: int = 8
    leaves: int = 31
    least_rows: int = 10
    l1: float = 0.0
    l2: float = 0.0
    share: float = 1.0  # of the features, drawn anew for each tree
    patience: int = 0
    seed: int = 123


@dataclass(frozen=True)
class Task:
    """A model to grow: it learns from the rows whose part is in neither set, and is validated on ``held``."""

    settings: Settings = Settings()
    held: frozenset = frozenset()
    unused: frozenset = frozenset()


@dataclass
class Tree:
    """Arrays over nodes. ``feature`` is -1 for leaves; ``left_bins`` marks the bins that go left."""

    feature: list[int] = field(default_factory=lambda: [-1])
    left_bins: list[np.ndarray | None] = field(default_factory=lambda: [None])
    child: list[int] = field(default_factory=lambda: [-1])  # the left one; the right one follows
    value: list[float] = field(default_factory=lambda: [0.0])
    gain: list[float] = field(default_factory=lambda: [0.0])
    rows: list[int] = field(default_factory=lambda: [0])

    def add(self) -> int:
        for part, empty in ((self.feature, -1), (self.left_bins, None), (self.child, -1), (self.value, 0.0), (self.gain, 0.0), (self.rows, 0)):
            part.append(empty)
        return len(self.feature) - 1

    def plain(self) -> tuple[np.ndarray, ...]:
        """Arrays that tasks read: features, left children, bins that go left, values."""
        left = np.zeros((len(self.feature), MOST_BINS), bool)
        for i, marks in enumerate(self.left_bins):
            if marks is not None:
                left[i] = marks
        return np.array(self.feature), np.array(self.child), left, np.array(self.value)

    def place(self, bins: np.ndarray, depth: int) -> np.ndarray:
        return placed(self.plain(), bins, depth)


def rows_at(tree: tuple[np.ndarray, ...], bins: np.ndarray, wanted=None):
    """(leaf, its rows) of a bin matrix of features x rows, for the wanted leaves that rows reach; rows of a lone root are a slice."""
    feature, child, left, _ = tree
    leads = np.ones(len(feature), bool)  # whether a node is wanted or lies above one; children come after their parents
    if wanted is not None:
        for v in range(len(feature) - 1, -1, -1):
            leads[v] = v in wanted if feature[v] < 0 else leads[child[v]] or leads[child[v] + 1]
    todo = [(0, slice(None))]
    while todo:
        node, rows = todo.pop()
        if feature[node] < 0:
            if wanted is None or node in wanted:
                yield node, rows
            continue
        went = left[node][bins[feature[node]][rows]]
        for c, side in ((child[node], went), (child[node] + 1, ~went)):
            if not leads[c]:
                continue
            mine = np.flatnonzero(side) if node == 0 else rows[side]
            if len(mine):
                todo.append((int(c), mine))


def placed(tree: tuple[np.ndarray, ...], bins: np.ndarray, depth: int) -> np.ndarray:
    """The node in which each row of a bin matrix ends."""
    feature, child, left, _ = tree
    at, rows = np.zeros(len(bins), np.int64), np.arange(len(bins))
    for _ in range(depth):
        inner = feature[at] >= 0
        if not inner.any():
            break
        went = left[at, bins[rows, np.maximum(feature[at], 0)]]
        at = np.where(inner, child[at] + ~went, at)
    return at


# ---- bins --------------------------------------------------------------------

@dataclass
class Binning:
    """Cut points of numbers and bins of categories, learned from a table."""

    numeric: list[str]
    categorical: list[str]
    cuts: dict[str, list[float]]
    groups: dict[str, list[str]]

    @property
    def names(self) -> list[str]:
        return [*self.numeric, *self.categorical]

    def of(self, batch: pa.RecordBatch) -> np.ndarray:
        """The bin matrix of a batch. A number's bin is how many cut points lie below it; an unknown category has bin 0."""
        out = np.zeros((batch.num_rows, len(self.names)), np.uint8)
        for j, c in enumerate(self.numeric):
            values = batch.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False)
            out[:, j] = np.searchsorted(self.cuts[c], values, side="left")
        for j, c in enumerate(self.categorical, len(self.numeric)):
            coded = batch.column(c).cast(pa.string()).dictionary_encode()
            known = {g: i + 1 for i, g in enumerate(self.groups[c])}
            codes = np.array([known.get(v, 0) for v in coded.dictionary.to_pylist()] + [0], np.uint8)
            out[:, j] = codes[np.asarray(coded.indices.fill_null(len(codes) - 1))]
        return out


def learn_bins(table: DataFrame, numeric: list[str], categorical: list[str], bins: int = BINS) -> Binning:
    """Exact quantiles as cut points, halfway to the next larger value being of no matter; the most frequent categories.

    Categories beyond the 255 most frequent of a column share the bin of unknown ones.
    """
    cuts, groups = {}, {}
    if numeric:
        row = exact_quantiles(table, [], numeric, [i / bins for i in range(1, bins)]).first()
        for c in numeric:
            cuts[c] = sorted(set(row[c] or []))
    for c in categorical:
        most = table.filter(col(c).isNotNull()).groupBy(col(c).cast("string").alias("group")).count().orderBy(F.desc("count"), "group").limit(MOST_BINS - 1)
        groups[c] = sorted(r["group"] for r in most.collect())
    return Binning(list(numeric), list(categorical), cuts, groups)


# ---- models ------------------------------------------------------------------

@dataclass
class BoostedModel:
    """Trees up to the best round, with the losses of all rounds that were grown; ``after`` are the trees that came after it."""

    binning: Binning
    base: float
    trees: list[Tree]
    settings: Settings
    losses: list[float]
    grown: int
    after: list[Tree] = field(default_factory=list)

    def raw(self, bins: np.ndarray) -> np.ndarray:
        out, columns = np.full(len(bins), self.base), np.ascontiguousarray(bins.T)
        for tree in self.trees:
            plain = tree.plain()
            for leaf, rows in rows_at(plain, columns):
                out[rows] += plain[3][leaf]
        return out

    def score(self, df: DataFrame, name: str = "proba") -> DataFrame:
        """``df`` with the probability of label 1; columns keep their places."""
        return scored(df, {name: self})

    @property
    def importance(self) -> dict[str, float]:
        """Summed gains of the splits on each feature, as shares of all."""
        total = np.zeros(len(self.binning.names))
        for tree in self.trees:
            for f, g in zip(tree.feature, tree.gain):
                if f >= 0:
                    total[f] += g
        whole = total.sum()
        return dict(zip(self.binning.names, (total / whole if whole else total).tolist()))

    def text(self) -> str:
        """The model as JSON."""
        return json.dumps({
            "binning": self.binning.__dict__, "base": self.base, "settings": self.settings.__dict__, "losses": self.losses, "grown": self.grown,
            "trees": [{**t.__dict__, "left_bins": [None if m is None else np.flatnonzero(m).tolist() for m in t.left_bins]} for t in self.trees]})

    @staticmethod
    def of_text(text: str) -> BoostedModel:
        d = json.loads(text)
        trees = []
        for t in d["trees"]:
            marks = [None if m is None else np.isin(np.arange(MOST_BINS), m) for m in t.pop("left_bins")]
            trees.append(Tree(left_bins=marks, **t))
        return BoostedModel(Binning(**d["binning"]), d["base"], trees, Settings(**d["settings"]), d["losses"], d["grown"])


def scored(df: DataFrame, models: dict[str, BoostedModel]) -> DataFrame:
    """Add one probability column per model, in one pass over the rows."""
    columns = [c for c in df.columns if c not in models]
    kinds = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name in columns] + [f"`{m}` double" for m in models])

    def run(batches):
        for batch in batches:
            out = [batch.column(c) for c in columns]
            for model in models.values():
                out.append(pa.array(1 / (1 + np.exp(-model.raw(model.binning.of(batch))))))
            yield pa.RecordBatch.from_arrays(out, [*columns, *models])

    return df.select(*[col(c) for c in columns]).mapInArrow(run, kinds)


# ---- growing -----------------------------------------------------------------

def _shrunk(g: np.ndarray, l1: float) -> np.ndarray:
    return np.sign(g) * np.maximum(np.abs(g) - l1, 0)


def best_split(g: np.ndarray, h: np.ndarray, n: np.ndarray, ordered: np.ndarray, allowed: np.ndarray, s: Settings):
    """(gain, feature, bins that go left, sums that go left) of a node's best split, or None; the arrays are features x bins.

    Numbers are cut between bins, categories between bins in the order of gradient over
    hessian. The gain is what the two halves' T(G)^2 / (H + l2) exceed the node's by, T
    shrinking G by l1. Ties go to the first feature and cut.
    """
    features = np.flatnonzero(allowed)
    g, h, n = g[features], h[features], n[features]
    order = np.tile(np.arange(g.shape[1]), (len(features), 1))
    for i in np.flatnonzero(~ordered[features]):
        ratio = np.where(n[i] > 0, g[i] / (h[i] + CATEGORY_SMOOTHING), np.inf)
        order[i] = np.argsort(ratio, kind="stable")
    lg, lh, ln = (np.cumsum(np.take_along_axis(x, order, axis=1), axis=1) for x in (g, h, n))
    total_g, total_h, total_n = lg[0, -1], lh[0, -1], ln[0, -1]
    rg, rh, rn = total_g - lg, total_h - lh, total_n - ln
    fit = (ln >= s.least_rows) & (rn >= s.least_rows) & (lh >= LEAST_HESSIAN) & (rh >= LEAST_HESSIAN)
    if not fit.any():
        return None
    halves = [_shrunk(x, s.l1) ** 2 / np.where(fit, y + s.l2, 1) for x, y in ((lg, lh), (rg, rh))]
    gains = np.where(fit, halves[0] + halves[1] - _shrunk(total_g, s.l1) ** 2 / (total_h + s.l2), -np.inf)
    i, at = divmod(int(np.argmax(gains)), gains.shape[1])
    if gains[i, at] <= LEAST_GAIN:
        return None
    left = np.zeros(MOST_BINS, bool)
    left[order[i, :at + 1]] = True
    return float(gains[i, at]), int(features[i]), left, (lg[i, at], lh[i, at], ln[i, at])


class _Growing:
    """A tree on its way: nodes, their sums, and which of them are among the best so far."""

    def __init__(self, settings: Settings, allowed: np.ndarray, rows: int = 0, level: int = 0):
        self.settings, self.allowed, self.tree = settings, allowed, Tree()
        self.splits: dict[int, tuple] = {}
        self.sums: dict[int, tuple[float, float]] = {}
        self.path: dict[int, str] = {0: ""}
        self.open, self.level = [0], level
        self.small: list[tuple[int, int]] = []  # nodes with their levels that a single task finishes
        self.tree.rows[0] = rows

    def meet(self, node: int, g: np.ndarray, h: np.ndarray, n: np.ndarray, ordered: np.ndarray) -> None:
        f = int(np.argmax(self.allowed))  # only allowed features are summed
        self.note(node, float(g[f].sum()), float(h[f].sum()), int(n[f].sum()), best_split(g, h, n, ordered, self.allowed, self.settings))

    def note(self, node: int, g: float, h: float, n: int, found: tuple | None) -> None:
        """Note a node's best split; the root's sums are known from no parent."""
        if node == 0:
            self.sums[0], self.tree.rows[0] = (g, h), n
        if found is not None:
            self.splits[node] = found

    def _kept(self) -> list[int]:
        """The nodes that a best-first learner splits, as far as is known: again and again the open one of largest gain."""
        out, heap = [], [(-self.splits[0][0], "", 0)] if 0 in self.splits else []
        while heap and len(out) < self.settings.leaves - 1:
            node = heapq.heappop(heap)[2]
            out.append(node)
            if self.tree.feature[node] >= 0:
                for c in (self.tree.child[node], self.tree.child[node] + 1):
                    if c in self.splits:
                        heapq.heappush(heap, (-self.splits[c][0], self.path[c], c))
        return out

    def _split(self, node: int) -> tuple[int, int]:
        tree = self.tree
        gain, tree.feature[node], tree.left_bins[node], (g, h, n) = self.splits[node]
        tree.child[node], tree.gain[node] = tree.add(), gain
        tree.add()
        left, right = tree.child[node], tree.child[node] + 1
        for c, side, sums in ((left, "0", (g, h, n)), (right, "1", (self.sums[node][0] - g, self.sums[node][1] - h, tree.rows[node] - n))):
            self.path[c], self.sums[c], tree.rows[c] = self.path[node] + side, (float(sums[0]), float(sums[1])), int(sums[2])
        return left, right

    def next_level(self) -> None:
        """Split the open nodes that may be kept; children that can be split further are the next open nodes."""
        kept, opened = set(self._kept()), []
        self.level += 1
        for node in self.open:
            if node in kept:
                opened += [c for c in self._split(node) if self.level < self.settings.depth and self.tree.rows[c] >= 2 * self.settings.least_rows]
        self.open = opened

    def set_aside(self) -> None:
        """The open nodes are left to single tasks."""
        self.small += [(v, self.level) for v in self.open]
        self.open = []

    def local(self, bins: np.ndarray, g: np.ndarray, h: np.ndarray, ordered: np.ndarray) -> bytes:
        """Grow the whole tree over rows at hand; returns what ``graft`` takes."""
        place = np.zeros(len(bins), np.int64)
        while self.open:
            for v in self.open:
                mine = place == v
                cells = (np.arange(bins.shape[1]) * MOST_BINS + bins[mine]).ravel()
                sums = [np.bincount(cells, None if x is None else np.repeat(x[mine].astype(np.float64), bins.shape[1]), bins.shape[1] * MOST_BINS) for x in (g, h, None)]
                sums = [x.reshape(bins.shape[1], MOST_BINS) for x in sums]
                self.meet(v, sums[0] / UNIT, sums[1] / UNIT, sums[2].astype(np.int64), ordered)
            before = self.open
            self.next_level()
            for v in before:
                if self.tree.feature[v] >= 0:
                    mine = np.flatnonzero(place == v)
                    place[mine] = self.tree.child[v] + ~self.tree.left_bins[v][bins[mine, self.tree.feature[v]]]
        return pickle.dumps((self.sums.get(0), self.tree.rows[0], [(v, x) for v, x in self.splits.items() if self.tree.feature[v] >= 0], self.tree.child))

    def graft(self, node: int, found: bytes) -> None:
        """Put a tree that was grown elsewhere in the place of a node."""
        sums, rows, splits, child = pickle.loads(found)
        if node == 0 and sums is not None:
            self.sums[0], self.tree.rows[0] = sums, rows
        splits, todo = dict(splits), [(0, node)]
        while todo:
            old, new = todo.pop()
            if old in splits:
                self.splits[new] = splits[old]
                left, right = self._split(new)
                todo += [(child[old], left), (child[old] + 1, right)]

    def finish(self) -> Tree:
        """The tree of the kept splits alone, with leaf values."""
        kept, s, out = set(self._kept()), self.settings, Tree()
        todo = [(0, 0)]
        while todo:
            old, new = todo.pop()
            out.rows[new] = self.tree.rows[old]
            if old in kept and self.tree.feature[old] >= 0:
                child = out.add()
                out.add()
                out.feature[new], out.left_bins[new], out.child[new], out.gain[new] = (
                    self.tree.feature[old], self.tree.left_bins[old], child, self.tree.gain[old])
                todo += [(self.tree.child[old], child), (self.tree.child[old] + 1, child + 1)]
            else:
                g, h = self.sums.get(old, (0.0, 0.0))
                out.value[new] = float(-_shrunk(np.float64(g), s.l1) / (h + s.l2) * s.rate) if h + s.l2 > 0 else 0.0
        return out


def _blocks(state: DataFrame, features: int, models: int) -> RDD:
    """The blocks of the state table: labels, weights, parts, bins and scores as arrays; bins are features x rows, scores models x rows.

    Every level of every round is a small job, so blocks are kept as an RDD, whose jobs need no plan.
    """
    def arrays(row):
        y, w, part, bins, scores = (np.frombuffer(v, k) for v, k in zip(row, ("<f8", "<f8", "<i8", np.uint8, "<f8")))
        return y, w, part, bins.reshape(features, -1), scores.reshape(models, -1)

    return state.rdd.map(arrays)


def _written(blocks: RDD, spark: SparkSession, width: int) -> RDD:
    """The blocks written to the shared folder and read back in as many tasks."""
    path = new_path(spark, "boosting")
    blocks.saveAsPickleFile(path, 1)
    return spark.sparkContext.pickleFile(path, width).coalesce(width)


def _learning(kept: dict, away: list, bins: np.ndarray, y: np.ndarray, w: np.ndarray, part: np.ndarray):
    """The learning rows of a block with their bins, labels and weights; models that leave out the same parts share them."""
    key = tuple(sorted(away))
    if key not in kept:
        rows = np.flatnonzero(~np.isin(part, away))
        kept[key] = (slice(None), bins, y, w) if len(rows) == len(part) else (rows, np.ascontiguousarray(bins[:, rows]), y[rows], w[rows])
    return kept[key]


_STATE = "label binary, weight binary, part binary, bins binary, scores binary"
_STATE_NAMES = ["label", "weight", "part", "bins", "scores"]


def _block(label: np.ndarray, weight: np.ndarray, part: np.ndarray, bins: np.ndarray, scores: np.ndarray) -> pa.RecordBatch:
    parts = [np.ascontiguousarray(x) for x in (label, weight, part, bins, scores)]
    return pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in parts], _STATE_NAMES)


def _state(table: DataFrame, binning: Binning, bases: np.ndarray, label: str, weight: str, part: str | None) -> DataFrame:
    most = max(1, min(BLOCK_ROWS, BLOCK_BYTES // (8 * max(len(bases), 1))))

    def run(batches):
        held, rows = [], 0

        def block():
            y, w, p, bins = (np.concatenate(x, axis=-1) for x in zip(*held))
            return _block(y, w, p, bins, np.tile(bases[:, None], (1, len(y))))

        for batch in batches:
            numbers = [batch.column(c).to_numpy(zero_copy_only=False).astype(np.float64) for c in ("_label", "_weight")]
            parts = batch.column("_part").fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
            held.append((*numbers, parts, binning.of(batch).T))
            rows += batch.num_rows
            if rows >= most:
                yield block()
                held, rows = [], 0
        if rows:
            yield block()

    chosen = table.select(
        col(label).cast("double").alias("_label"), col(weight).cast("double").alias("_weight"),
        (col(part).cast("int") if part else F.lit(0)).alias("_part"), *[col(c) for c in binning.names])
    return chosen.mapInArrow(run, _STATE)


def _advanced(blocks: RDD, trees: dict[int, list[Tree]]) -> RDD:
    """The blocks after adding trees to each of some models, one after the other."""
    plain = [(m, tree.plain()) for m, added in trees.items() for tree in added]

    def add(block):
        y, w, part, bins, scores = block
        scores = scores.copy()
        for m, tree in plain:
            for leaf, rows in rows_at(tree, bins):
                scores[m][rows] += tree[3][leaf]
        return y, w, part, bins, scores

    return blocks.map(add)


def _histograms(bins: np.ndarray, g: np.ndarray, h: np.ndarray, columns: list[int], rows, out: np.ndarray, shift: int) -> None:
    """Add a node's sums per feature and bin to ``out``. Rows are counted in the bits above the hessians' (``shift``) where 53 hold both."""
    g, h = g[rows], h[rows]
    for j, f in enumerate(columns):  # sums of a block are whole numbers far below 2^53
        at = bins[f][rows]
        out[j, 0] += np.bincount(at, g, MOST_BINS).astype(np.int64)
        sums = np.bincount(at, h, MOST_BINS).astype(np.int64)
        out[j, 1] += sums & ((1 << shift) - 1) if shift else sums
        out[j, 2] += sums >> shift if shift else np.bincount(at, minlength=MOST_BINS)


def _found(own: np.ndarray, columns: list[int], features: int, ordered: np.ndarray, allowed: np.ndarray, settings: Settings) -> list[tuple]:
    """(sums of gradients, of hessians, number of rows, best split) of each node from its sums (nodes x allowed features x 3 x bins)."""
    out = []
    for cells in own:
        full = np.zeros((features, 3, MOST_BINS), np.int64)
        full[columns] = cells
        g, h, n = full[:, 0] / UNIT, full[:, 1] / UNIT, full[:, 2]
        f = columns[0]  # only allowed features are summed
        out.append((float(g[f].sum()), float(h[f].sum()), int(n[f].sum()), best_split(g, h, n, ordered, allowed, settings)))
    return out


def _sums(blocks: RDD, growing: dict[int, tuple], features: int, losses: bool, tasks: int, ordered: np.ndarray):
    """Best splits of the open nodes from sums per (model, node, allowed feature, bin) of the learning rows, and validation losses: one job.

    Returned are, by model, what ``_found`` gives for each open node, and the losses (loss, weight). What a task emits is bounded
    by the open nodes. Sums of a few models and tasks (``FEW_TASKS``) are added up without an exchange; others meet by model,
    and the splits are found there.
    """
    asked = {
        m: (tree.plain(), spots, list(task.held), list(task.held | task.unused), np.flatnonzero(allowed).tolist(), allowed, task.settings)
        for m, (tree, spots, task, allowed) in growing.items()}

    def run(held):
        sums: dict[int, np.ndarray] = {}
        lost: dict[int, list[int]] = {}
        for y, w, part, bins, scores in held:
            kept: dict = {}
            for m, (tree, spots, validation, away, columns, _, _) in asked.items():
                s = scores[m]
                if losses and validation:
                    seen = np.isin(part, validation)
                    if seen.any():
                        _add_loss(lost.setdefault(m, [0, 0, 0]), s[seen], y[seen], w[seen])
                if not columns:
                    continue
                learns, mine, labels, weights = _learning(kept, away, bins, y, w, part)
                g, h = (x.astype(np.float64) for x in _steps(s[learns], labels, weights))
                shift = int(h.sum()).bit_length() if len(h) and h.min() >= 0 else 0
                if shift and shift + len(h).bit_length() <= 53:
                    h += 1 << shift
                else:
                    shift = 0
                own = sums.setdefault(m, np.zeros((len(spots), len(columns), 3, MOST_BINS), np.int64))
                for node, rows in rows_at(tree, mine, spots):
                    _histograms(mine, g, h, columns, rows, own[spots[node]], shift)
        for m, own in sums.items():  # the bins beyond the last one in use are not sent
            last = np.flatnonzero(own[:, :, 2].any(axis=(0, 1)))
            for i in range(0, len(own), SPOTS):
                yield (m, i), own[i:i + SPOTS, :, :, :last[-1] + 1 if len(last) else 1]
        for m, x in lost.items():
            yield (-1 - m, 0), x

    def add(a, b):
        if isinstance(a, list):
            return [x + y for x, y in zip(a, b)]
        if a.shape[-1] < b.shape[-1]:
            a, b = b, a
        a = a.copy()
        a[..., :b.shape[-1]] += b
        return a

    def split(item):
        (m, i), own = item
        if m < 0:
            return item
        _, _, _, _, columns, allowed, settings = asked[m]
        whole = np.zeros((*own.shape[:3], MOST_BINS), np.int64)
        whole[..., :own.shape[-1]] = own
        return (m, i), _found(whole, columns, features, ordered, allowed, settings)

    found = blocks.mapPartitions(run)
    if tasks * len(asked) <= FEW_TASKS:
        merged: dict[tuple[int, int], object] = {}
        for key, x in found.collect():
            merged[key] = add(merged[key], x) if key in merged else x
        done = [split(item) for item in merged.items()]
    else:
        done = found.reduceByKey(add, tasks).map(split).collect()
    by_model: dict[int, list] = {}
    for (m, _), x in sorted((item for item in done if item[0][0] >= 0), key=lambda item: item[0]):
        by_model.setdefault(m, []).extend(x)
    return by_model, {-1 - m: (x[0], x[1]) for (m, _), x in done if m < 0}


def _local(blocks: RDD, growing: dict[int, tuple], losses: bool, tasks: int, ordered: np.ndarray):
    """Finish nodes of few rows: each node's rows meet in one task. One job; returns trees by model and node, and losses.

    A state of one task has all rows in place; a few models need no exchange then.
    """
    asked = {m: (tree.plain(), spots, list(task.held), list(task.held | task.unused), task.settings, allowed) for m, (tree, spots, task, allowed) in growing.items()}

    def gathered(held):
        """Per block, model and small node: bins, gradients and hessians of the rows there; at the end the losses."""
        lost: dict[int, list[int]] = {}
        for y, w, part, bins, scores in held:
            kept: dict = {}
            for m, (tree, spots, validation, away, _, _) in asked.items():
                s = scores[m]
                if losses and validation:
                    seen = np.isin(part, validation)
                    if seen.any():
                        _add_loss(lost.setdefault(m, [0, 0, 0]), s[seen], y[seen], w[seen])
                learns, mine, labels, weights = _learning(kept, away, bins, y, w, part)
                g, h = _steps(s[learns], labels, weights)
                for node, rows in rows_at(tree, mine, spots):
                    if len(g[rows]):
                        yield (m, node), (np.ascontiguousarray(mine[:, rows].T), g[rows], h[rows])
        for m, x in lost.items():
            yield (-1 - m, 0), tuple(x)

    def finish(item):
        (m, node), parts = item
        if m < 0:
            return (m, node), tuple(sum(x) for x in zip(*parts))
        _, spots, _, _, settings, allowed = asked[m]
        bins, g, h = (np.concatenate(x) for x in zip(*parts))
        return (m, node), _Growing(settings, allowed, len(bins), spots[node]).local(bins, g, h, ordered)

    def in_place(held):
        met: dict[tuple[int, int], list] = {}
        for key, x in gathered(held):
            met.setdefault(key, []).append(x)
        return map(finish, met.items())

    if tasks == 1 and len(asked) <= FEW_MODELS:
        done = blocks.mapPartitions(in_place).collect()
    else:
        done = blocks.mapPartitions(gathered).groupByKey(max(tasks, blocks.context.defaultParallelism)).map(finish).collect()
    return {k: x for k, x in done if k[0] >= 0}, {-1 - m: x[:2] for (m, _), x in done if m < 0}


def _steps(s: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients and hessians of the log loss in whole units."""
    p = 1 / (1 + np.exp(-s))
    return np.rint(w * (p - y) * UNIT).astype(np.int64), np.rint(w * p * (1 - p) * UNIT).astype(np.int64)


def _add_loss(sums: list[int], s: np.ndarray, y: np.ndarray, w: np.ndarray) -> None:
    for k, x in enumerate((w * (np.logaddexp(0, s) - y * s), w)):
        sums[k] += int(np.rint(x * UNIT).astype(np.int64).sum())
    sums[2] += len(s)


def _bases(table: DataFrame, tasks: list[Task], label: str, weight: str, part: str | None) -> tuple[np.ndarray, list[int]]:
    """Log-odds of the weighted share of label 1 among each task's learning rows, and the number of these."""
    key = col(part).cast("int") if part else F.lit(0)
    sums = [F.sum(F.round(c * UNIT).cast("long")) for c in (col(weight) * col(label), col(weight))]
    rows = table.groupBy(key.alias("part")).agg(sums[0].alias("ones"), sums[1].alias("all"), F.count(F.lit(1)).alias("n")).collect()
    out, sizes = [], []
    for task in tasks:
        mine = [r for r in rows if r["part"] not in task.held | task.unused]
        ones, whole = sum(r["ones"] for r in mine), sum(r["all"] for r in mine)
        share = min(max(ones / whole if whole else 0.5, 1e-6), 1 - 1e-6)
        out.append(math.log(share / (1 - share)))
        sizes.append(sum(r["n"] for r in mine))
    return np.array(out), sizes


def grow(
    table: DataFrame, numeric: list[str], categorical: list[str], tasks: list[Task], label: str = "label",
    weight: str = "class_weight", part: str | None = None, bins: int = BINS, binning: Binning | None = None, local_rows: int = LOCAL_ROWS,
    earlier: list[BoostedModel] | None = None,
) -> list[BoostedModel]:
    """Boosted models of all tasks over one table of complete rows; ``part`` holds small integers.

    A task with a validation part and patience ends ``patience`` rounds after its smallest
    weighted log loss there and keeps the trees up to it (the first one of equals). Nodes of
    at most ``local_rows`` rows are finished where their rows meet, the rest level by level;
    both give the same trees. ``earlier`` are models of the same tasks, table and ``binning`` with
    fewer rounds: they go on from their last trees and become what growing anew would give.
    """
    binning = binning or learn_bins(table, numeric, categorical, bins)
    features, models = len(binning.names), len(tasks)
    bases, sizes = _bases(table, tasks, label, weight, part)
    state = materialized(_state(table, binning, bases, label, weight, part), "boosting")
    ordered = np.array([True] * len(binning.numeric) + [False] * len(binning.categorical))
    trees: list[list[Tree]] = [[*m.trees, *m.after] for m in earlier] if earlier else [[] for _ in tasks]
    losses: list[list[float]] = [list(m.losses) for m in earlier] if earlier else [[] for _ in tasks]
    live = [m for m, t in enumerate(tasks) if _goes_on(trees[m], t.settings) and not _spent(losses[m], t.settings)]
    draws = [np.random.default_rng([t.settings.seed, 7]) for t in tasks]
    for m in live:  # the features of the trees at hand have been drawn
        for _ in trees[m]:
            draws[m].permutation(features)
    no_feature = np.zeros(features, bool)  # asks for losses alone
    blocks = _blocks(state, features, models)
    if earlier:
        blocks = _advanced(blocks, {m: trees[m] for m in live})
    held, before, grown = blocks.persist(StorageLevel.MEMORY_AND_DISK), None, 0
    width = held.getNumPartitions()
    try:
        while live:
            growing = {}
            for m in live:
                s = tasks[m].settings
                allowed = np.zeros(features, bool)
                allowed[draws[m].permutation(features)[:max(1, math.ceil(s.share * features - 1e-9))]] = True
                growing[m] = _Growing(s, allowed, sizes[m])
            ended: set[int] = set()
            for turn in itertools.count():
                # small nodes ride along while a larger one of any model needs the pass
                if all(x.tree.rows[v] <= local_rows for m, x in growing.items() if m not in ended for v in x.open):
                    for x in growing.values():
                        x.set_aside()
                wide = {m: x for m, x in growing.items() if x.open and m not in ended}
                if wide:
                    asked = {m: (x.tree, {v: i for i, v in enumerate(x.open)}, tasks[m], x.allowed) for m, x in wide.items()}
                    found, lost = _sums(held, asked, features, turn == 0, width, ordered)
                else:
                    asked = {m: (x.tree, dict(x.small), tasks[m], x.allowed) for m, x in growing.items() if x.small and m not in ended}
                    if not asked:
                        break
                    found, lost = _local(held, asked, turn == 0, width, ordered)
                if turn == 0:
                    if before is not None:  # the scores of this round have been computed from it
                        before.unpersist()
                        before = None
                    # models of few and of many rows may be judged by different jobs
                    judged = {m for m in live if m in asked}
                    unseen = {m: (Tree(), {0: 0}, tasks[m], no_feature) for m in live if m not in judged and tasks[m].held}
                    if unseen:
                        lost |= _sums(held, unseen, features, True, width, ordered)[1]
                    # the loss after an earlier model's last tree is known
                    ended = {m for m in live if len(losses[m]) <= len(trees[m]) and _over(lost.get(m), losses[m], tasks[m].settings)}
                if not wide:
                    for (m, node), sub in found.items():
                        growing[m].graft(node, sub)
                    break
                for m, x in wide.items():
                    if m not in ended:
                        for node, at in zip(x.open, found.get(m, [])):
                            x.note(node, *at)
                        x.next_level()
            live = [m for m in live if m not in ended]
            new = {m: growing[m].finish() for m in live}
            for m, tree in new.items():
                trees[m].append(tree)
            live = [m for m in live if _goes_on(trees[m], tasks[m].settings)]
            last = [m for m in new if m not in live and tasks[m].held]
            grown += 1
            if not live and not last:
                break
            before, held = held, _advanced(held, {m: [tree] for m, tree in new.items()})
            if grown % WRITE_EVERY == 0:
                held = _written(held, table.sparkSession, width)
            held = held.persist(StorageLevel.MEMORY_AND_DISK)
            if last:  # the loss after a model's last tree
                lost = _sums(held, {m: (Tree(), {0: 0}, tasks[m], no_feature) for m in last}, features, True, width, ordered)[1]
                for m in last:
                    _over(lost.get(m), losses[m], tasks[m].settings)
    finally:
        for frame in (before, held):
            if frame is not None:
                frame.unpersist()
    out = []
    for m, task in enumerate(tasks):
        best = int(np.argmin(losses[m])) if losses[m] and task.settings.patience else len(trees[m])
        out.append(BoostedModel(binning, float(bases[m]), trees[m][:best], task.settings, losses[m], len(trees[m]), trees[m][best:]))
    return out


def _goes_on(trees: list[Tree], settings: Settings) -> bool:
    """Are rounds left? A tree of one leaf ends a model, unless its features were a draw."""
    return len(trees) < settings.rounds and (not trees or trees[-1].feature[0] >= 0 or settings.share < 1)


def _over(lost: tuple[int, int] | None, losses: list[float], settings: Settings) -> bool:
    """Note the loss; has the model had its patience without a smaller one?"""
    if lost is None:
        return False
    losses.append(lost[0] / max(lost[1], 1))
    return _spent(losses, settings)


def _spent(losses: list[float], settings: Settings) -> bool:
    return bool(settings.patience and losses) and len(losses) - 1 - int(np.argmin(losses)) >= settings.patience
