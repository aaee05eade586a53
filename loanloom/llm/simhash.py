"""Near duplicates by SimHash fingerprints and multi-index hashing.

A fingerprint has 64 bits; a bit is set where it is set in over half of a text's shingle
hashes. Two fingerprints link at ``WITHIN`` or fewer differing bits. The bits are cut into
m segments with radii that add up to WITHIN - m + 1, so linked fingerprints agree in one
segment to within its radius: every fingerprint enumerates that small Hamming ball in each
segment, fetches the fingerprints filed under those values, and complete distances decide.
Fewer, wider segments with larger balls are taken as the number of fingerprints grows.

Fingerprints of one family crowd in the same buckets. Above ``CROWD`` entries a bucket is
not compared pair by pair: two fingerprints differ in at most WITHIN bits exactly if some
word is within WITHIN / 2 bits of both, so everything that meets a crowded bucket lists
its ball of that radius over all bits (2,081 words for 4), and a word's members link to
the least of them. That costs the same for each fingerprint, however large the family.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..sources.tables import materialized
from .batches import BLOCK_BYTES, slices
from .components import components

BITS = 64
WITHIN = 4
SHINGLE_WORDS = 4
SEED = 42
CROWD = 1000  # entries of a bucket up to which its pairs are compared


def bit_counts(text: bytes, width: int = SHINGLE_WORDS, block: int = BLOCK_BYTES) -> tuple[np.ndarray, int]:
    """In how many of a text's shingle hashes each bit is set, and the number of shingles.

    Words are runs without ASCII white space, A-Z lower-cased. Fewer words than ``width``
    make one shingle, none make none. A long text is read in blocks, the last words of a
    block going on to the next.
    """
    total, shingles, words, at = np.zeros(BITS, np.int64), 0, [], 0
    while at < len(text):
        end = at + block
        while end < len(text) and not text[end:end + 1].isspace():
            end += 1
        words += text[at:end].lower().split()
        at = end
        n = len(words) - width + 1
        if n < 1:
            continue
        joined = b" ".join(words)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(sizes + 1) - 1
        spans = zip((ends - sizes)[:n].tolist(), ends[width - 1:].tolist())
        total += _set_bits(np.fromiter((xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in spans), np.uint64, n))
        shingles += n
        words = words[n:]
    if not shingles and words:
        return _set_bits(np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], np.uint64)), 1
    return total, shingles


def _set_bits(hashes: np.ndarray) -> np.ndarray:
    return np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fingerprint long, n_shingles) of every row; null and wordless texts have fingerprint 0 and no shingle."""
    def run(batches):
        for batch in slices(batches, 1):
            prints, counts = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for i, value in enumerate(batch.column(1).cast(pa.large_binary())):
                set_in, n = bit_counts(value.as_py() or b"")
                prints[i] = np.packbits(set_in * 2 > n, bitorder="little").view("<i8")[0]
                counts[i] = n
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints), pa.array(counts)], [key, "fingerprint", "n_shingles"])

    chosen = docs.select(F.col(f"`{key}`").alias(key), F.col(f"`{text}`").cast("string").alias("text"))
    kind = chosen.schema[key].dataType.simpleString()
    return chosen.mapInArrow(run, f"`{key}` {kind}, fingerprint long, n_shingles long")


def ball(width: int, radius: int) -> int:
    return sum(comb(width, k) for k in range(radius + 1))


def layout(codes: int, within: int = WITHIN) -> list[tuple[int, int, int]]:
    """(first bit, width, radius) of each segment, for so many different fingerprints.

    Of 2 to ``within`` + 1 segments the number is taken that makes the fewest probes and
    candidates when fingerprints spread evenly. Radii add up to within - m + 1: were every
    segment beyond its radius, more than ``within`` bits would differ.
    """
    def cut(m: int) -> list[tuple[int, int, int]]:
        edges = [BITS * i // m for i in range(m + 1)]
        each, more = divmod(within - m + 1, m)
        return [(a, b - a, each + (i < more)) for i, (a, b) in enumerate(zip(edges, edges[1:]))]

    return min((cut(m) for m in range(2, within + 2)), key=lambda c: sum(ball(w, r) * (2 + codes / 2 ** w) for _, w, r in c))


def _masks(width: int, radius: int) -> Column:
    """The words of ``width`` bits with at most ``radius`` set: at most 2,081, whatever the input."""
    return F.lit([sum(1 << b for b in bits) - (1 << 64) * (63 in bits) for r in range(radius + 1) for bits in combinations(range(width), r)]).cast("array<long>")


def _around(word: Column, width: int, radius: int) -> Column:
    return F.transform(_masks(width, radius), lambda m: word.bitwiseXOR(m))


def _filed(cut: list[tuple[int, int, int]], probing: bool) -> Column:
    """The keys under which a fingerprint is filed, or those of the balls that it probes."""
    keys = []
    for i, (first, width, radius) in enumerate(cut):
        tagged = F.shiftrightunsigned("fp", first).bitwiseAND(F.lit((1 << width) - 1)).bitwiseOR(F.lit(i << 32))
        keys.append(_around(tagged, width, radius if probing else 0))
    return F.concat(*keys)


def links(prints: DataFrame, within: int = WITHIN, crowd: int = CROWD, codes: int | None = None) -> DataFrame:
    """(x, y): pairs of different fingerprints (column ``fp``, distinct) at ``within`` or fewer bits.

    They connect exactly what all such pairs connect. ``within`` is even. ``codes`` stands
    for the number of fingerprints when the segments are chosen.
    """
    if within % 2 or within < 2:
        raise ValueError("an even number of differing bits, 2 or more")
    cut = layout(prints.count() if codes is None else codes, within)
    apart = F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= within
    index = materialized(prints.select(F.explode(_filed(cut, False)).alias("key"), F.col("fp").alias("other")), "index")
    # exploded rows are sized like the rows they come from, so Spark would broadcast them up to a gigabyte
    probes = prints.select("fp", F.explode(_filed(cut, True)).alias("key")).hint("merge")
    crowded = materialized(index.groupBy("key").count().filter(F.col("count") > crowd).select("key"), "crowded")
    if crowded.isEmpty():
        met = probes.join(index, (probes["key"] == index["key"]) & (F.col("fp") < F.col("other")) & apart)
        return met.select(F.col("fp").alias("x"), F.col("other").alias("y")).distinct()
    open_index = index.join(crowded, "key", "left_anti").withColumnRenamed("key", "filed")
    met = probes.join(open_index, (F.col("key") == F.col("filed")) & (F.col("fp") < F.col("other")) & apart)
    inside = probes.join(crowded, "key", "left_semi").select("fp").distinct()
    words = inside.select("fp", F.explode(_around(F.col("fp"), BITS, within // 2)).alias("word"))
    stars = words.withColumn("other", F.min("fp").over(Window.partitionBy("word"))).filter((F.col("fp") > F.col("other")) & apart)
    return met.select(F.col("fp").alias("x"), F.col("other").alias("y")).union(stars.select("other", "fp")).distinct()


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", within: int = WITHIN, crowd: int = CROWD) -> DataFrame:
    """(key, fingerprint as 16 hexadecimal digits, component_id, n_shingles), a row for every row of ``docs``.

    ``component_id`` is the least key reachable by links, its own included. Null, empty and
    wordless texts have fingerprint zero and are linked like any other; rows of equal text,
    repeated rows too, share a fingerprint and so a component; a null key is never the
    least, and a component of nothing else has null. Other columns are not looked at. An
    empty table gives no rows. A fingerprint that a third of all rows share is one row of
    the search.
    """
    prints = materialized(fingerprints(docs, key, text), "fingerprints")
    least = materialized(prints.groupBy(F.col("fingerprint").alias("fp")).agg(F.min(key).alias("least")), "least")
    joined = components(links(least.select("fp"), within, crowd))
    named = least.join(joined.select(F.col("node").alias("fp"), "component"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    first = named.groupBy("component").agg(F.min("least").alias("component_id"))
    labels = materialized(named.join(first, "component").select(F.col("fp").alias("fingerprint"), "component_id"), "labels")
    return prints.join(labels, "fingerprint").select(
        key, F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id", "n_shingles")
