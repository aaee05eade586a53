"""How far sources of a language are from each other and from the language, by hash-consed segment trees.

Kept terms of a language are numbered within ranges of about ``RANGE_TERMS`` terms (by
hash, so no task numbers a whole vocabulary). Over a range each (language, source) group
has a segment tree of its counts. Nodes are hash-consed: two subtrees with equal counts
are the same node, whichever group or place they are from. The difference of two groups
is priced by walking both trees at once, level by level; a pair of nodes that is met more
than once goes on as one pair with its number of meetings, so equal pairs are priced once.
The prices of the ranges are then summed.

A task holds one range of at most twice ``PANEL`` sources; languages with more sources are
compared panel against panel.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..sources.tables import materialized
from .vocab import WordBlocks, byte_table

LEAST_DOCUMENTS = 30
SMOOTHING = 5
SCALE = 1_000_000_000
TOP_TERMS = 50
RANGE_TERMS = 2048
PANEL = 48
LETTERS = byte_table((0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))  # in UTF-8: ASCII letters and everything beyond ASCII


def term_counts(docs: DataFrame, size: int | None = None) -> DataFrame:
    """(lang, source, term, count, documents): occurrences of a term, and documents with it, per group."""
    def run(batches):
        blocks = WordBlocks(LETTERS, byte_table(), **({"size": size} if size else {}))
        seen: set = set()  # terms of a long text whose earlier blocks were counted
        for block in blocks.of(batches):
            langs, sources = (block.rows.column(c).dictionary_encode() for c in ("lang", "source"))
            lang, source = (c.indices.to_numpy().astype(np.int64) for c in (langs, sources))
            group = lang * len(sources.dictionary) + source
            width = max(len(block.words), 1)
            pairs, times = np.unique(block.row * width + block.ids, return_counts=True)
            new = np.ones(len(pairs), np.int64)
            if not block.again:
                seen = set()
            if block.rows.num_rows == 1:
                terms = block.words.take(pa.array(pairs % width)).to_pylist()
                new = np.array([t not in seen for t in terms], np.int64)
                seen.update(terms)
            keys, at = np.unique(group[pairs // width] * width + pairs % width, return_inverse=True)
            count, documents = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
            np.add.at(count, at, times)
            np.add.at(documents, at, new)
            where = keys // width
            yield pa.RecordBatch.from_arrays([
                langs.dictionary.take(pa.array(where // len(sources.dictionary))), sources.dictionary.take(pa.array(where % len(sources.dictionary))),
                block.words.take(pa.array(keys % width)).cast(pa.large_string()).cast(pa.string()), pa.array(count), pa.array(documents),
            ], ["lang", "source", "term", "count", "documents"])

    found = docs.select("text", "lang", "source").mapInArrow(run, "lang string, source string, term string, count long, documents long")
    return found.groupBy("lang", "source", "term").agg(F.sum("count").alias("count"), F.sum("documents").alias("documents"))


def _share(count: str, total: str, terms: str) -> F.Column:
    """1 + floor(SCALE * (count + 5) / (total + 5 * terms)), in integers of up to 38 digits; null without terms."""
    top = f"cast({SCALE} AS DECIMAL(10,0)) * cast({count} + {SMOOTHING} AS DECIMAL(20,0))"
    return F.expr(f"CASE WHEN {terms} > 0 THEN 1 + ({top}) div cast({total} + {SMOOTHING} * {terms} AS DECIMAL(20,0)) END")


def consed(leaves: np.ndarray) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """The roots of the trees over the rows of ``leaves``, and per level, from the top, the children of its nodes.

    Equal subtrees of a level are one node, in all rows. Where a level is odd its last node
    has no right child (-1).
    """
    nodes, levels = leaves, []
    while nodes.shape[1] > 1:
        if nodes.shape[1] % 2:
            nodes = np.concatenate((nodes, np.full((len(nodes), 1), -1)), axis=1)
        span = int(nodes.max()) + 2
        pairs, at = np.unique((nodes[:, 0::2] + 1) * span + nodes[:, 1::2] + 1, return_inverse=True)
        levels.append((pairs // span - 1, pairs % span - 1))
        nodes = at.reshape(len(nodes), -1)
    return nodes[:, 0], levels[::-1]


def priced(leaves: np.ndarray, shares: np.ndarray, first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """For each pair (first[i], second[i]) of rows, the summed |share - share| over their leaves.

    ``leaves`` are columns of ``shares``, which has a row for each row of ``leaves``.
    """
    roots, levels = consed(leaves)
    pair, a, b = np.arange(len(first)), roots[first], roots[second]
    times = np.ones(len(first), np.int64)
    for left, right in levels:
        side = [(pair, left[a], left[b], times), (pair, right[a], right[b], times)]
        pair, a, b, times = (np.concatenate(x) for x in zip(*side))
        held = a >= 0  # both rows have as many leaves
        span = max(int(left.max()), int(right.max())) + 1
        keys, at = np.unique((pair[held] * span + a[held]) * span + b[held], return_inverse=True)
        summed = np.zeros(len(keys), np.int64)
        np.add.at(summed, at, times[held])
        pair, a, b, times = keys // span // span, keys // span % span, keys % span, summed
    out = np.zeros(len(first), np.int64)
    np.add.at(out, pair, np.abs(shares[first[pair], a] - shares[second[pair], b]) * times)
    return out


def _price_panel(rows: pd.DataFrame) -> pd.DataFrame:
    """The price of each pair of sources over one range of terms; rows without a term name the sources."""
    heads = rows[rows["spot"] < 0].drop_duplicates("source").sort_values("source", ignore_index=True)
    body = rows[rows["spot"] >= 0]
    lang, low, high = rows["lang"].iat[0], rows["low"].iat[0], rows["high"].iat[0]
    place = pd.Series(heads.index, index=heads["source"])
    counts, kinds = np.unique(np.append(0, body["count"].to_numpy()), return_inverse=True)
    who = place[body["source"]].to_numpy()
    leaves = np.zeros((len(heads), int(heads["terms"].iat[0])), np.int64)
    leaves[who, body["spot"].to_numpy()] = kinds[1:]
    shares = np.zeros((len(heads), len(counts)), np.int64)
    shares[:, 0] = heads["share"].to_numpy()
    shares[who, kinds[1:]] = body["share"].to_numpy()
    panel = heads["panel"].to_numpy()
    first, second = np.triu_indices(len(heads), 1)
    if low != high:
        apart = panel[first] != panel[second]
        first, second = first[apart], second[apart]
    names = heads["source"].to_numpy()
    return pd.DataFrame({"lang": lang, "source": names[first], "item": names[second], "value": priced(leaves, shares, first, second)})


def divergence(docs: DataFrame, least: int = LEAST_DOCUMENTS, top: int = TOP_TERMS, range_terms: int = RANGE_TERMS, panel: int = PANEL) -> DataFrame:
    """(lang, source, part, item, value, rank) for every (lang, source) group that occurs in ``docs``.

    Null text, language and source count as ''. A language keeps the terms (runs of letters
    and of characters beyond ASCII, A-Z lower-cased) that at least ``least`` of its documents
    hold, repeated rows counting as documents of their own. Part ``pair``: each other source
    of the language with the summed difference of all kept terms' shares (0 without any);
    part ``term``: the ``top`` kept terms of the group whose share exceeds the language's by
    most. Ties go to the smaller item in byte order. Other columns are not looked at; an
    empty table gives no rows, a lone source no pairs.
    """
    docs = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")])
    counts = materialized(term_counts(docs), "terms")
    kept = counts.groupBy("lang", "term").agg(F.sum("documents").alias("documents"), F.sum("count").alias("all")).filter(F.col("documents") >= least)
    kept = materialized(kept.select("lang", "term", "all"), "kept")
    langs = kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("all").alias("lang_total"))
    rows = materialized(counts.join(kept, ["lang", "term"]).select("lang", "source", "term", "count", "all"), "rows")
    totals = rows.groupBy("lang", "source").agg(F.sum("count").alias("total"))
    groups = docs.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = materialized(groups.na.fill(0, ["total", "terms", "lang_total"]), "groups")

    over = rows.join(groups, ["lang", "source"]).select("lang", "source", F.col("term").alias("item"), (
        _share("count", "total", "terms") - _share("all", "lang_total", "terms")).alias("value")).filter("value > 0")
    by_value = [F.desc("value"), "item"]
    best = over.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(*by_value))).filter(F.col("rank") <= top)

    # ranges of terms, each numbered by itself
    cuts = groups.groupBy("lang").agg(F.max("terms").alias("terms"), F.count("*").alias("sources")).select(
        "lang", F.ceil(F.col("terms") / range_terms).alias("ranges"), F.ceil(F.col("sources") / panel).alias("panels"))
    placed = kept.join(cuts, "lang").withColumn("range", F.pmod(F.xxhash64("term"), F.col("ranges")))
    placed = materialized(placed.withColumn(
        "spot", F.row_number().over(Window.partitionBy("lang", "range").orderBy("term")) - 1).select("lang", "term", "range", "spot"), "placed")
    held = placed.groupBy("lang", "range").agg(F.count("*").alias("in_range"))
    groups = materialized(groups.join(cuts, "lang").withColumn("panel", F.pmod(F.xxhash64("source"), F.greatest("panels", F.lit(1)))), "groups")
    heads = groups.join(held, "lang").select(
        "lang", "source", "panel", "panels", "range", F.lit(-1).alias("spot"), F.lit(0).cast("long").alias("count"),
        _share("0", "total", "terms").alias("share"), F.col("in_range").alias("terms"))
    body = rows.join(placed, ["lang", "term"]).join(groups, ["lang", "source"]).select(
        "lang", "source", "panel", "panels", "range", "spot", "count", _share("count", "total", "terms").alias("share"), F.lit(0).cast("long").alias("terms"))
    facing = heads.union(body).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("panels") - 1)))
    facing = facing.withColumn("low", F.least("panel", "other")).withColumn("high", F.greatest("panel", "other")).drop("panels", "other")
    half = facing.groupBy("lang", "range", "low", "high").applyInPandas(_price_panel, "lang string, source string, item string, value long")
    half = half.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    none = groups.filter("terms = 0").select("lang", "source")
    empty = none.join(none.withColumnRenamed("source", "item"), "lang").filter("source < item").withColumn("value", F.lit(0).cast("long"))
    pairs = half.unionByName(empty)
    pairs = pairs.union(pairs.select("lang", F.col("item"), F.col("source"), "value"))
    ranked = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(*by_value)))
    return ranked.withColumn("part", F.lit("pair")).unionByName(best.withColumn("part", F.lit("term"))).select(
        "lang", "source", "part", "item", "value", "rank")
