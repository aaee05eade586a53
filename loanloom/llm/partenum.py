"""Exact Jaccard join of documents on word shingles by PartEnum signatures.

Let sets a and b, b not the smaller, have Jaccard similarity t or more. They differ in at
most k(b) = 2 |b| (1 - t) / (1 + t) features. The feature domain is cut into parts (in
number chosen for bands of equal size), parts are taken in groups of ``split``, and a
signature hashes the features that a set has in each choice of ``pick`` parts of a group.
A feature in which the sets differ spoils C(split - 1, pick - 1) signatures of a set, so
b keeps more signatures than can be spoilt, and one of them is a signature of a as well.
Sets of up to 1023 features use the finest domain, each feature a part of its own.

That count gives more. As b has ``spare`` signatures beyond the spoilt ones, it may leave
its ``spare`` largest buckets untested and still meets every partner in another one. So
a passage that a third of all documents share costs nothing in documents that are mostly
something else.

Steps: (1) sets, digests, sketches; equal sets are one node. (2) Signatures, packed by
target part, are exchanged once; each task keeps a first node per signature and returns
the others that meet it. (3) Nodes are compared with their bucket's first node; links
give components. (4) Buckets whose nodes are still in several components are tested
around another node, and then in full where the count above demands it. Pairs pass a
lossless sketch filter and are then decided on the full sets.
"""

from __future__ import annotations

from itertools import combinations
from math import comb, exp

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..sources.tables import materialized
from .batches import Words, bounded, mix, rows_of, slices
from .components import components

SHINGLE_WORDS = 5
FINE_LEVEL = 10  # sets below 2 ** FINE_LEVEL features: every feature is a part
SKETCH_BITS = 1024
SIGNATURE_BITS = 48
LEVEL_BITS = 5
PACK_BYTES = 2 << 20  # of texts whose signatures a task holds
MEET_ROWS = 1 << 19  # signatures that meet those known at once
STAR_ROUNDS = 2  # stars around other nodes before the full test
_STEP = np.uint64(0xD6E8FEB86659FD93)


def shingle_sets(words: Words, texts: pa.Array, width: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each row, and the number of them before each row.

    Fewer words than ``width`` make one shingle of all words; no words make none.
    """
    hashes, bounds = words.of(texts)
    row, counts = rows_of(bounds), np.diff(bounds)
    found, owners = [], []
    if len(hashes) >= width:
        n = len(hashes) - width + 1
        fold = hashes[:n].copy()
        for k in range(1, width):
            fold = mix(fold * _STEP) + hashes[k:n + k]
        whole = row[:n] == row[width - 1:]
        found.append(fold[whole])
        owners.append(row[:n][whole])
    for short in range(1, width):
        rows = np.flatnonzero(counts == short)
        if len(rows):
            fold = hashes[bounds[rows]].copy()
            for k in range(1, short):
                fold = mix(fold * _STEP) + hashes[bounds[rows] + k]
            found.append(mix(fold + np.uint64(short)))
            owners.append(rows)
    if not found:
        return np.zeros(0, np.uint64), np.zeros(len(bounds), np.int64)
    value, owner = np.concatenate(found), np.concatenate(owners)
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    value, owner = value[new], owner[new]
    return value, np.searchsorted(owner, np.arange(len(bounds)))


class PartEnum:
    """Signatures of sets of 64-bit features for a Jaccard threshold of ``num / den``."""

    def __init__(self, num: int = 3, den: int = 4, split: int = 2, pick: int = 1, seed: int = 0):
        self.num, self.den, self.split, self.pick = num, den, split, pick
        self.seed = np.uint64(pow(0x9E3779B97F4A7C15, 2 * seed + 1, 1 << 64))
        self.spoilt = comb(split - 1, pick - 1)
        most = 2 * (den - num) / (den + num)
        self.density = 0.5  # parts per least size of a band: enough that a band's largest sets keep a fifth to spare
        while self.density < 8 and self.density / 2 * (1 - exp(-2 / self.density)) < 1.2 * most:
            self.density += 0.05

    def errors(self, sizes: np.ndarray) -> np.ndarray:
        """The most features in which a set and a similar one, not larger, differ."""
        return 2 * sizes * (self.den - self.num) // (self.den + self.num)

    def level(self, sizes: np.ndarray) -> np.ndarray:
        at = np.frexp(np.maximum(sizes, 1).astype(np.float64))[1] - 1
        return np.where(at < FINE_LEVEL, 0, at)

    def parts(self, level: int) -> int:
        """Parts of the domain for a level; a multiple of ``split``."""
        return self.split * (1 << 31) if level == 0 else self.split * max(1, int(self.density * (1 << level) / self.split))

    def _scheme(self, value: np.ndarray, owner: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
        """Signatures, with owners, of sets (sorted by owner and value) in one level."""
        parts = self.parts(level)
        mixed = mix(value ^ self.seed)
        if level == 0:
            part = np.arange(len(value), dtype=np.int64)  # each feature alone
        else:
            order = np.lexsort((mixed, owner))  # parts in a row, as each seed cuts the domain elsewhere
            mixed, owner = mixed[order], owner[order]
            part = ((mixed >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
        first = np.ones(len(value), bool)
        first[1:] = (part[1:] != part[:-1]) | (owner[1:] != owner[:-1])
        at = np.flatnonzero(first)
        if not len(at):
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        sums = np.add.reduceat(mixed, at)
        owner, part = owner[at], part[at]
        if level == 0 or self.pick == 1:
            names = sums if level == 0 else sums + part.astype(np.uint64) * _STEP
        else:
            group = part // self.split
            new = np.ones(len(at), bool)
            new[1:] = (group[1:] != group[:-1]) | (owner[1:] != owner[:-1])
            line = np.cumsum(new) - 1
            table = np.zeros((int(line[-1]) + 1, self.split), np.uint64)
            table[line, part % self.split] = sums
            owner, group = owner[new], group[new].astype(np.uint64)
            names, owners = [], []
            for i, chosen in enumerate(combinations(range(self.split), self.pick)):
                rows = table[:, chosen].any(axis=1)
                total = table[:, chosen].sum(axis=1, dtype=np.uint64)
                names.append((total + (group * np.uint64(64) + np.uint64(i)) * _STEP)[rows])
                owners.append(owner[rows])
            names, owner = np.concatenate(names), np.concatenate(owners)
        shift = np.uint64(64 - SIGNATURE_BITS)
        return (mix(names) >> shift >> np.uint64(LEVEL_BITS) << np.uint64(LEVEL_BITS)) | np.uint64(level), owner

    def signatures(self, value: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All signatures with their rows, and each row's number of them in its own level.

        A set is given those of its own level and, where a similar larger set can be in
        the next, also those of that one. The level is in a signature's last bits.
        """
        sizes, owner = np.diff(bounds), rows_of(bounds)
        own, above = self.level(sizes), self.level(sizes * self.den // self.num)
        found, owners, met = [], [], np.zeros(len(sizes), np.int64)
        for level in np.unique(np.concatenate((own[sizes > 0], above[sizes > 0]))):
            inside = ((own == level) | (above == level)) & (sizes > 0)
            chosen = inside[owner]
            names, rows = self._scheme(value[chosen], owner[chosen], int(level))
            counts = np.bincount(rows, minlength=len(sizes))
            met = np.where(own == level, counts, met)
            found.append(names)
            owners.append(rows)
        if not found:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64), met
        return np.concatenate(found), np.concatenate(owners), met


def set_names(value: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A 64-bit name of each set, from a sum over its features; 0 for an empty one."""
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(value + _STEP), dtype=np.uint64)))
    sizes = np.diff(bounds).astype(np.uint64)
    return np.where(sizes > 0, mix(total[bounds[1:]] - total[bounds[:-1]] + sizes * _STEP), 0).view(np.int64)


def sketches(value: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Parities of the features per hash bit: two sketches differ in no more bits than the sets in features."""
    n = len(bounds) - 1
    at = rows_of(bounds) * SKETCH_BITS + (value % np.uint64(SKETCH_BITS)).astype(np.int64)
    odd = (np.bincount(at, minlength=n * SKETCH_BITS) & 1).astype(np.uint8).reshape(n, SKETCH_BITS)
    return np.packbits(odd, axis=1, bitorder="little").view(np.int64)


def wide_sketch(features: np.ndarray) -> bytes:
    """Parities per hash bit with two to four bits a feature, for sets that fill a plain sketch."""
    bits = 1 << int(2 * len(features) - 1).bit_length()
    odd = np.bincount((features % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def bits_apart(a: bytes, b: bytes) -> int:
    """Bits in which two wide sketches differ; the longer is folded to the length of the other."""
    x, y = (np.frombuffer(v, np.uint8) for v in (a, b))
    while len(x) != len(y):
        if len(x) < len(y):
            x, y = y, x
        x = x[:len(x) // 2] ^ x[len(x) // 2:]
    return int(np.bitwise_count(x ^ y).sum())


def document_sets(docs: DataFrame, scheme: PartEnum, width: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, n_shingles, node, spare, level, sketch, wide) of every row of ``docs`` (doc_id, text).

    ``node`` names the set; ``spare`` is the number of own-level signatures beyond those
    that differences can spoil, less one, and negative where there are none.
    """
    def run(batches):
        words = Words()
        for batch in slices(batches, 1):
            value, bounds = shingle_sets(words, batch.column(1), width)
            sizes = np.diff(bounds)
            _, _, met = scheme.signatures(value, bounds)
            spare = met - scheme.errors(sizes) * np.where(scheme.level(sizes) == 0, 1, scheme.spoilt) - 1
            flat = pa.array(sketches(value, bounds).ravel())
            wide = [wide_sketch(value[bounds[i]:bounds[i + 1]]) if n > SKETCH_BITS // 2 else None for i, n in enumerate(sizes.tolist())]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(sizes.astype(np.int64)), pa.array(set_names(value, bounds)), pa.array(spare.astype(np.int64)),
                pa.array(scheme.level(sizes).astype(np.int64)),
                pa.FixedSizeListArray.from_arrays(flat, SKETCH_BITS // 64).cast(pa.list_(pa.int64())),
                pa.array(wide, pa.binary()),
            ], ["doc_id", "n_shingles", "node", "spare", "level", "sketch", "wide"])

    schema = "doc_id long, n_shingles long, node long, spare long, level long, sketch array<long>, wide binary"
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def meetings(docs: DataFrame, scheme: PartEnum, parts: int, width: int = SHINGLE_WORDS) -> DataFrame:
    """(sig, lead, node): nodes that share a signature with another, the first that came.

    Tasks pack their signatures by target part, so an exchanged row is a few thousand
    signatures. The receiving task keeps one node per signature, not a bucket's members,
    so its memory follows the number of signatures per part however large a bucket is.
    """
    def pack(batches):
        words, held, size = Words(), [], 0

        def flush():
            sig, node = (np.concatenate(x) for x in zip(*held))
            part = (mix(sig) % np.uint64(parts)).astype(np.int32)
            order = np.lexsort((sig, part))
            sig, node, part = sig[order], node[order], part[order]
            names, at = np.unique(node, return_inverse=True)
            cuts = np.flatnonzero(np.diff(part, prepend=-1, append=-1))
            out = []
            for a, b in zip(cuts[:-1], cuts[1:]):
                used, where = np.unique(at[a:b], return_inverse=True)
                low = sig[a:b].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :SIGNATURE_BITS // 8]
                kind = "<u2" if len(used) < 65536 else "<u4"
                out.append((int(part[a]), b - a, low.tobytes(), names[used].astype("<i8").tobytes(), where.astype(kind).tobytes()))
            p, n, s, u, w = zip(*out)
            return pa.RecordBatch.from_arrays(
                [pa.array(p, pa.int32()), pa.array(n, pa.int32()), pa.array(s, pa.binary()), pa.array(u, pa.binary()), pa.array(w, pa.binary())],
                ["part", "n", "sigs", "nodes", "at"])

        seen = set()
        for batch in slices(batches, 0):
            value, bounds = shingle_sets(words, batch.column(0), width)
            nodes = set_names(value, bounds)
            fresh = np.array([n != 0 and n not in seen and not seen.add(n) for n in nodes.tolist()], bool)
            if not fresh.any():
                continue
            keep = fresh[rows_of(bounds)]
            sizes = np.where(fresh, np.diff(bounds), 0)
            sig, row, _ = scheme.signatures(value[keep], np.concatenate(([0], np.cumsum(sizes))))
            held.append((sig, nodes[row]))
            size += int(pa.compute.sum(pa.compute.binary_length(batch.column(0))).as_py() or 0)
            if size >= PACK_BYTES:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()

    def meet(batches):
        known, leads = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        held, rows = [], 0

        def settle():
            nonlocal known, leads
            sig, node = (np.concatenate(x) for x in zip(*held))
            order = np.lexsort((node, sig))
            sig, node = sig[order], node[order]
            new = np.ones(len(sig), bool)
            new[1:] = (sig[1:] != sig[:-1]) | (node[1:] != node[:-1])  # copies of a set from several tasks
            sig, node = sig[new], node[new]
            first = np.ones(len(sig), bool)
            first[1:] = sig[1:] != sig[:-1]
            heads = np.flatnonzero(first)
            at = np.searchsorted(known, sig[heads])
            old = np.zeros(len(heads), bool)
            if len(known):
                old = known[np.minimum(at, len(known) - 1)] == sig[heads]
            lead = np.where(old, leads[np.minimum(at, len(leads) - 1)] if len(leads) else 0, node[heads])
            lead_of = lead[np.cumsum(first) - 1]
            fresh = heads[~old]
            at = np.searchsorted(known, sig[fresh])
            known, leads = np.insert(known, at, sig[fresh]), np.insert(leads, at, node[fresh])
            meet = lead_of != node
            return pa.RecordBatch.from_arrays(
                [pa.array(sig[meet].view(np.int64)), pa.array(lead_of[meet]), pa.array(node[meet])], ["sig", "lead", "node"])

        for batch in batches:
            for i in range(batch.num_rows):
                n, s, u, w = (batch.column(c)[i].as_py() for c in range(1, 5))
                sig = np.zeros((n, 8), np.uint8)
                sig[:, :SIGNATURE_BITS // 8] = np.frombuffer(s, np.uint8).reshape(n, -1)
                where = np.frombuffer(w, "<u2" if len(w) == 2 * n else "<u4")
                held.append((sig.view("<u8").ravel(), np.frombuffer(u, "<i8")[where]))
                rows += n
                if rows >= MEET_ROWS:
                    yield settle()
                    held.clear()
                    rows = 0
        if held:
            yield settle()

    packed = docs.select("text").mapInArrow(pack, "part int, n int, sigs binary, nodes binary, at binary")
    return packed.repartition(parts, "part").mapInArrow(meet, "sig long, lead long, node long")


FILTER_BITS = 25


def sets_of(docs: DataFrame, nodes: DataFrame, width: int = SHINGLE_WORDS) -> DataFrame:
    """(node, features) of the wanted nodes, from the texts.

    A bitmap of fixed size over the nodes' names keeps most other documents from being
    sent; what it lets pass by chance, the join drops.
    """
    place = F.col("node").bitwiseAND(F.lit((1 << FILTER_BITS) - 1))
    bits = nodes.select(F.shiftright(place, 6).alias("word"), F.expr("shiftleft(1L, cast(node & 63 as int))").alias("bit")).groupBy(
        "word").agg(F.bit_or("bit").alias("bits")).toArrow()
    bitmap = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    bitmap[bits["word"].to_numpy()] = bits["bits"].to_numpy()
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches):
        words, wanted, sent = Words(), shared.value, set()
        for batch in slices(batches, 0):
            value, bounds = shingle_sets(words, batch.column(0), width)
            nodes = set_names(value, bounds)
            place = nodes & ((1 << FILTER_BITS) - 1)
            hit = (nodes != 0) & ((wanted[place >> 6] >> (nodes & 63)) & 1).astype(bool)
            chosen = [i for i in np.flatnonzero(hit) if nodes[i] not in sent and not sent.add(nodes[i])]
            if chosen:
                sizes = np.diff(bounds)[chosen]
                flat = np.concatenate([value[bounds[i]:bounds[i + 1]] for i in chosen]).view(np.int64)
                offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(nodes[chosen]), pa.ListArray.from_arrays(offsets, flat)], ["node", "features"])

    sets = docs.select("text").mapInArrow(run, "node long, features array<long>")
    return sets.join(nodes, "node", "left_semi").dropDuplicates(["node"])


def _near(pairs: DataFrame, info: DataFrame, scheme: PartEnum) -> DataFrame:
    """(x, y, nx, ny): the pairs that their sizes and sketches leave possible. Drops no similar pair."""
    num, den = scheme.num, scheme.den

    def side(name: str, *columns: str) -> DataFrame:
        return info.select(F.col("node").alias(name), *[F.col(c).alias(c[0] + name) for c in columns])

    sized = pairs.join(side("x", "n_shingles"), "x").join(side("y", "n_shingles"), "y").filter(
        den * F.least("nx", "ny") >= num * F.greatest("nx", "ny"))
    apart = sum((F.bit_count(F.col("sx")[i].bitwiseXOR(F.col("sy")[i])) for i in range(SKETCH_BITS // 64)), F.lit(0))
    rough = sized.join(side("x", "sketch"), "x").join(side("y", "sketch"), "y").filter(
        (den + num) * apart <= (den - num) * (F.col("nx") + F.col("ny"))).select("x", "y", "nx", "ny")
    rough = materialized(rough, "pairs")

    def run(batches):
        for batch in batches:
            nx, ny, wx, wy = (batch.column(i).to_pylist() for i in range(2, 6))
            keep = [
                a is None or b is None or (den + num) * bits_apart(a, b) <= (den - num) * (m + n)
                for m, n, a, b in zip(nx, ny, wx, wy)
            ]
            yield batch.filter(pa.array(keep, pa.bool_())).select(["x", "y", "nx", "ny"])

    full = rough.join(side("x", "wide"), "x").join(side("y", "wide"), "y").select("x", "y", "nx", "ny", "wx", "wy")
    return materialized(full.mapInArrow(run, "x long, y long, nx long, ny long"), "pairs")


def _verified(docs: DataFrame, info: DataFrame, pairs: DataFrame, scheme: PartEnum, width: int) -> DataFrame:
    """The (x, y) among ``pairs`` whose sets are similar."""
    num, den = scheme.num, scheme.den
    left = _near(pairs, info, scheme)
    if left.isEmpty():
        return left.select("x", "y")
    wanted = left.select(F.col("x").alias("node")).union(left.select("y")).distinct()
    sets = materialized(sets_of(docs, wanted, width), "sets")
    full = left.join(sets.select(F.col("node").alias("x"), F.col("features").alias("fx")), "x").join(
        sets.select(F.col("node").alias("y"), F.col("features").alias("fy")), "y")
    shared = F.size(F.array_intersect("fx", "fy"))
    return materialized(full.withColumn("i", shared).filter(f"{den} * i >= {num} * (nx + ny - i)").select("x", "y"), "links")


def _ordered(pairs: DataFrame, a: str, b: str) -> DataFrame:
    return pairs.filter(f"{a} <> {b}").select(F.least(a, b).alias("x"), F.greatest(a, b).alias("y")).distinct()


def similar_rows(docs: DataFrame, num: int = 3, den: int = 4, width: int = SHINGLE_WORDS, per_part: int = 1 << 20) -> DataFrame:
    """(doc_id, n_shingles, node, component, component_id) of every row of ``docs`` (doc_id, text; others are left out).

    Words are runs of bytes other than white space, A-Z lower-cased; rows link when the
    Jaccard similarity of their shingle sets is ``num / den`` or more. ``component_id`` is
    the least doc_id a row reaches; a null or blank text has no shingles, links with
    nothing and keeps its own id. Rows with one doc_id and different texts are documents
    of their own; null ids never become a component's id unless all are null. Sets are
    compared by 64-bit feature hashes; ``node`` is the set's name and ``component`` the least
    of its component's, null for an empty set. ``docs`` is read several times.
    """
    docs = bounded(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    spark = docs.sparkSession
    for seed in range(8):  # a set too clumped to have spare signatures is next to impossible; then another cut of the domain
        scheme = PartEnum(num, den, seed=seed)
        rows = materialized(document_sets(docs, scheme, width), "documents")
        total = rows.agg(F.sum("n_shingles"), F.min(F.when(F.col("n_shingles") > 0, F.col("spare")))).first()
        if total[1] is None or total[1] >= 0:
            break
    else:
        raise ValueError("no cut of the feature domain keeps a signature for every set")
    info = rows.filter("n_shingles > 0").dropDuplicates(["node"])
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), (total[0] or 0) // per_part)
    met = materialized(meetings(docs, scheme, parts, width), "meetings")
    links = _verified(docs, info, _ordered(met, "lead", "node"), scheme, width)
    found = materialized(components(links), "components")
    for step in range(STAR_ROUNDS + 1):
        buckets = _open_buckets(met, found)
        if buckets.isEmpty():
            break
        sized = _sized(buckets, info)
        pairs = _around_another(sized, scheme, step) if step < STAR_ROUNDS else _required(sized, scheme)
        more = _verified(docs, info, pairs, scheme, width)
        if not more.isEmpty():
            links = links.union(more)
            found = materialized(components(links), "components")
    placed = rows.select("doc_id", "n_shingles", "node").join(found, "node", "left").withColumn(
        "component", F.coalesce("component", "node"))
    least = placed.filter("n_shingles > 0").groupBy("component").agg(F.min("doc_id").alias("component_id"))
    return placed.withColumn("component", F.when(F.col("n_shingles") > 0, F.col("component"))).join(least, "component", "left").select(
        "doc_id", "n_shingles", "node", "component",
        F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def similar_components(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of ``docs``; see :func:`similar_rows`."""
    return similar_rows(docs, **options).select("doc_id", "n_shingles", "component_id")


LISTED_IDS = 1 << 20


def listed(ids: DataFrame, most: int = LISTED_IDS) -> DataFrame:
    """Ids to be joined: broadcast where they are counted and at most ``most``, else as they are."""
    return F.broadcast(ids) if ids.limit(most + 1).count() <= most else ids


def one_per_component(docs: DataFrame, **options) -> DataFrame:
    """Of each component of similar rows the one with the least doc_id, all columns kept.

    Rows without shingles stay. Ids on one row each are decided by id, and a list of those
    that go meets the texts, not the other way round. Rows without id or with an id that
    several rows have are told apart by their set; of equal ones that of least text hash stays.
    """
    names = docs.columns
    at = names.index("text")
    rows = materialized(similar_rows(docs, **options), "similar")
    many = materialized(rows.groupBy("doc_id").count().filter("count > 1 AND doc_id IS NOT NULL").select("doc_id"), "repeated")
    gone = rows.filter("doc_id IS NOT NULL AND doc_id <> component_id").select("doc_id").union(many).distinct()
    once = docs.filter("doc_id IS NOT NULL").join(listed(materialized(gone, "gone")), "doc_id", "left_anti").select(names)

    def run(batches):
        words = Words()
        for batch in slices(batches, at):
            value, bounds = shingle_sets(words, batch.column(at), options.get("width", SHINGLE_WORDS))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(set_names(value, bounds))], names=[*names, "set_name"])

    others = docs.join(listed(many), "doc_id", "left_semi").select(names).union(docs.filter("doc_id IS NULL"))
    schema = others.withColumn("set_name", F.lit(0).cast("long")).schema
    for field in schema:
        field.nullable = True
    kept = rows.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(
        F.col("doc_id").alias("kept_id"), F.col("node").alias("kept_name"), "component").distinct()
    named = others.mapInArrow(run, schema)
    found = named.join(kept, (named["set_name"] == kept["kept_name"]) & named["doc_id"].eqNullSafe(kept["kept_id"]))
    key = F.coalesce(F.col("component"), F.xxhash64("text"))
    best = found.groupBy("doc_id", key.alias("place")).agg(F.min_by(F.struct(*names), F.xxhash64("text")).alias("row"))
    return once.union(best.select("row.*"))


def _open_buckets(met: DataFrame, found: DataFrame) -> DataFrame:
    """(sig, node, component, members) of buckets of three nodes or more in several components."""
    members = met.select("sig", "node").union(met.select("sig", "lead")).distinct()
    members = members.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    members = materialized(members, "members")
    open_ = members.groupBy("sig").agg(F.count("*").alias("members"), F.min("component").alias("a"), F.max("component").alias("b"))
    return materialized(members.join(open_.filter("a <> b AND members > 2").select("sig", "members"), "sig"), "buckets")


def _sized(buckets: DataFrame, info: DataFrame) -> DataFrame:
    """Bucket rows with the node's size and level, whether the bucket is of that level (``own``),
    and how many of its features lie in no open bucket (``cold``, where each feature is a part)."""
    own = F.col("sig").bitwiseAND(F.lit((1 << LEVEL_BITS) - 1)) == F.col("level")
    sized = buckets.join(info.select("node", "n_shingles", "spare", "level"), "node").withColumn("own", own)
    return materialized(sized.withColumn(
        "cold", F.col("n_shingles") - F.sum(F.col("own").cast("long")).over(Window.partitionBy("node"))), "sized")


def _possible(scheme: PartEnum, x: str, y: str):
    """Whether two nodes are of different components, near enough in size and, where features
    are parts, not set apart by cold features: nodes of different components share none of these."""
    num, den = scheme.num, scheme.den
    n, m = F.col(f"{x}.n_shingles"), F.col(f"{y}.n_shingles")
    apart = (F.col(f"{x}.level") > 0) | (F.col(f"{y}.level") > 0) | (
        (den + num) * (F.col(f"{x}.cold") + F.col(f"{y}.cold")) <= (den - num) * (n + m))
    return (F.col(f"{x}.component") != F.col(f"{y}.component")) & (den * F.least(n, m) >= num * F.greatest(n, m)) & apart


def _around_another(sized: DataFrame, scheme: PartEnum, step: int) -> DataFrame:
    """The possible pairs of each open bucket's nodes with one of them, another in every bucket.

    Of many near copies each is so compared with as many others as it has signatures, in
    work that grows with the rows and not with their square.
    """
    whole = F.struct("node", "component", "n_shingles", "level", "cold")
    lead = sized.groupBy("sig").agg(F.max_by(whole, F.xxhash64("node", "sig", F.lit(step))).alias("lead"))
    lead = lead.select(F.col("sig").alias("bucket"), "lead.*")
    x, y = sized.alias("x"), lead.alias("y")
    both = x.join(y, (F.col("x.sig") == F.col("y.bucket")) & _possible(scheme, "x", "y"))
    return _ordered(both.select(F.col("x.node").alias("node"), F.col("y.node").alias("lead")), "node", "lead")


def _required(sized: DataFrame, scheme: PartEnum) -> DataFrame:
    """The pairs that must still be compared.

    Where each feature is a part: a similar pair has so few cold features that one node is
    nearly all open ones (a core). A core that is the smaller of two lacks at most
    n (1 - t) / (1 + t) of its features in the other, a core that is the larger n (1 - t);
    it leaves out as many of its largest buckets as it has features beyond these. Elsewhere
    the larger node leaves out its ``spare`` largest own-level buckets.
    """
    num, den = scheme.num, scheme.den
    order = Window.partitionBy("node").orderBy(F.desc("own"), F.desc("members"), "sig")
    ranked = sized.withColumn("rank", F.row_number().over(order)).filter("own")

    def core(side: str):
        return 2 * num * F.col(f"{side}.cold") <= (den - num) * F.col(f"{side}.n_shingles")

    def fine(lacking: int):
        kept = F.floor(F.col("n_shingles") * (den - num) / lacking)
        return ranked.alias("x").filter((F.col("level") == 0) & core("x") & (F.col("rank") > F.col("n_shingles") - kept - 1))

    def met(chosen: DataFrame, condition) -> DataFrame:
        x, y = chosen.alias("x"), sized.alias("y")
        both = x.join(y, (F.col("x.sig") == F.col("y.sig")) & _possible(scheme, "x", "y") & condition)
        return both.select(F.col("x.node").alias("larger"), F.col("y.node").alias("node"))

    rising = F.struct("x.n_shingles", "x.node") < F.struct("y.n_shingles", "y.node")
    coarse = met(ranked.filter((F.col("level") > 0) & (F.col("rank") > F.col("spare"))), F.col("y.n_shingles") <= F.col("x.n_shingles"))
    pairs = met(fine(den + num), rising).union(met(fine(den), ~rising & ~core("y"))).union(coarse)
    return _ordered(pairs, "larger", "node")
