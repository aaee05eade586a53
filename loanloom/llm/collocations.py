"""Collocations of two to four words per language by best-first branch-and-bound growth.

A phrase that occurs a times scores 2,000,000 * a / (l + r) at a cut into parts that occur
l and r times; its lowest cut counts. What grows from a prefix p occurs at most f(p)
times, and its last part at least as often as itself, so cutting after the first word
bounds every score below p by 2,000,000 * f(p) / (f(first word) + f(p)). The bound falls
along a branch.

Words and then all pairs of frequent words are counted. The frontier is expanded from the
best bound downwards: a round takes the prefixes whose bound reaches a level (the score
of a language's pair of rank ``REACH`` * top), counts what grows from them, and what a
word in front makes of the phrases that score at the level, for those decide which
phrases are covered by longer ones. A language is settled once ``top`` surviving phrases
score at the level or above: all that was not expanded is below it. Else the level falls,
at last to 0.

Counting reads the texts; the phrases to grow from are sent as bit sets of hashes of fixed
size. A collision counts a phrase more than was asked for, it never changes a count. Above
``FILTER_BITS`` prefixes the sets let more through; counts stay exact.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..sources.tables import materialized
from .batches import bounded, mix
from .vocab import WordBlocks, byte_table, word_hashes

TOP = 2000
LEAST = 30
WORDS = 4
SCALE = 2_000_000
COVERED = 80  # per cent of a phrase's occurrences that lie in a longer one
REACH = 3
FILTER_BITS = 1 << 24
BLOCK_BYTES = 2 << 20
STOPS = byte_table(0x21, 0x2C, 0x2E, 0x3A, 0x3B, 0x3F, (0x0A, 0x0D))  # ! , . : ; ? and line ends
WORD = ~(STOPS | byte_table(0x20, 0x09))
UNKNOWN = "und"
_STEP = np.uint64(0xD6E8FEB86659FD93)
Need = tuple[int, int, object]  # (first word, words, bit set as a broadcast): this part's hash is in the set


def count_phrases(texts: DataFrame, n: int, needs: list[list[Need]] | None = None, size: int = BLOCK_BYTES) -> DataFrame:
    """(lang, phrase, f, h): how often each phrase of ``n`` words occurs within pieces, and its hash.

    With ``needs`` only phrases for which all parts of one of the lists are in their sets.
    """
    def run(batches):
        blocks = WordBlocks(WORD, STOPS, WORDS - 1, size)
        for block in blocks.of(batches):
            langs = block.rows.column("lang").dictionary_encode()
            lang = langs.indices.to_numpy().astype(np.int64)
            width = max(len(block.words), 1)
            kinds, word = np.unique(lang[block.row] * width + block.ids, return_inverse=True)
            single = mix(word_hashes(block.words)[kinds % width] ^ _tongues(langs.dictionary)[kinds // width])[word]

            def hashed(at, length):
                fold = single[at]
                for k in range(1, length):
                    fold = mix(fold * _STEP + single[at + k])
                return fold

            at = block.starts(n)
            if needs is not None:
                wanted = np.zeros(len(at), bool)
                for parts in needs:
                    hit = np.ones(len(at), bool)
                    for first, length, bits in parts:
                        place = hashed(at + first, length) & np.uint64(len(bits.value) * 8 - 1)
                        hit &= (bits.value[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
                    wanted |= hit
                at = at[wanted]
            if not len(at):
                continue
            code = word[at]
            for k in range(1, n - 1):
                code = np.unique(code * len(kinds) + word[at + k], return_inverse=True)[1]
            if n > 1:
                code = code * len(kinds) + word[at + n - 1]
            _, first, times = np.unique(code, return_index=True, return_counts=True)
            at = at[first]
            parts = [block.words.take(pa.array(block.ids[at + k])) for k in range(n)]
            phrase = pa.compute.binary_join_element_wise(*parts, pa.scalar(b" ", pa.large_binary())) if n > 1 else parts[0]
            yield pa.RecordBatch.from_arrays([
                langs.dictionary.take(pa.array(lang[block.row[at]])), phrase.cast(pa.large_string()).cast(pa.string()), pa.array(times),
                pa.array(hashed(at, n).view(np.int64))], ["lang", "phrase", "f", "h"])

    # a block has each phrase once, so blocks are what meets in one place; a second table of phrases in each
    # task in front of the exchange would hold nearly as many rows again
    found = texts.mapInArrow(run, "lang string, phrase string, f long, h long").repartition("lang", "phrase")
    return found.groupBy("lang", "phrase").agg(F.sum("f").alias("f"), F.max("h").alias("h"))


def bit_set(phrases: DataFrame, bits: int = FILTER_BITS):
    """The hashes ``h`` of a table as a broadcast set of fixed size, built by an aggregate."""
    place = F.col("h").bitwiseAND(F.lit(bits - 1)) + 1
    rows = phrases.select(place.alias("place")).groupBy(F.bitmap_bucket_number("place").alias("part")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bits")).collect()
    out = np.zeros(max(bits // 8, 4096), np.uint8)
    for r in rows:
        out[(r["part"] - 1) * 4096:r["part"] * 4096] = np.frombuffer(r["bits"], np.uint8)
    return phrases.sparkSession.sparkContext.broadcast(out[:bits // 8])


def _part(first: int, words: int) -> Column:
    return F.array_join(F.slice(F.split("phrase", " "), first + 1, words), " ")


def _scaled(a: str, total: str) -> Column:
    """floor(SCALE * a / total), in integers of up to 38 digits."""
    return F.expr(f"cast({SCALE} AS DECIMAL(10,0)) * cast({a} AS DECIMAL(20,0)) div cast({total} AS DECIMAL(20,0))")


def scored(phrases: DataFrame, n: int, counts: DataFrame) -> DataFrame:
    """(lang, phrase, f, h, score, l, r, bound): the lowest cut of phrases of ``n`` words, and the bound of what grows from them.

    ``counts`` has the parts' f; a cut of which a part is not there is left out.
    """
    cuts = range(1, n)
    parts = phrases.select("*", F.explode(F.array(*[
        F.struct(F.lit(name).alias("side"), part.alias("part"))
        for k in cuts for name, part in ((f"l{k}", _part(0, k)), (f"r{k}", _part(k, n - k)))])).alias("p")).select("lang", "phrase", "f", "h", "p.*")
    met = parts.join(counts.select("lang", F.col("phrase").alias("part"), F.col("f").alias("part_f")), ["lang", "part"])
    wide = met.groupBy("lang", "phrase", "f", "h").agg(*[
        F.max(F.when(F.col("side") == f"{s}{k}", F.col("part_f"))).alias(f"{s}{k}") for k in cuts for s in "lr"])
    lowest = F.array_min(F.array(*[
        F.when(F.col(f"l{k}").isNotNull() & F.col(f"r{k}").isNotNull(), F.struct(
            _scaled("f", f"(l{k} + r{k})").alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r"))) for k in cuts]))
    return wide.withColumn("cut", lowest).select("lang", "phrase", "f", "h", "cut.score", "cut.l", "cut.r", _scaled("f", "(l1 + f)").alias("bound"))


def _longest(longer: DataFrame, n: int) -> DataFrame:
    """(lang, phrase, longest): the most frequent phrase of ``n`` words around each phrase of a word less."""
    parts = longer.select("lang", "f", F.explode(F.array(_part(0, n - 1), _part(1, n - 1))).alias("phrase"))
    return parts.groupBy("lang", "phrase").agg(F.max("f").alias("longest"))


def collocations(docs: DataFrame, top: int = TOP, least: int = LEAST, reach: int = REACH, bits: int = FILTER_BITS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` surviving phrases of each language.

    Texts are lower-cased (A-Z), split at ``.,;:!?`` and line ends into pieces and those at
    spaces and tabs into words; a null text is empty, a null language ``und``. Phrases of
    two to four words with ``least`` occurrences are candidates; those that lie in a longer
    candidate with 80 % of their occurrences do not survive. A phrase within two words more
    also lies within one word more that is as frequent, so one word more is looked at. The
    order is score and a descending, then the phrase's bytes. Repeated rows count again;
    other columns are not looked at; an empty table gives no rows.
    """
    texts = bounded(docs).select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)).alias("lang"))
    spark = docs.sparkSession
    words = materialized(count_phrases(texts, 1), "words")
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    words = words.filter(F.col("f") >= least)
    frequent = bit_set(words, bits)
    pairs = count_phrases(texts, 2, [[(0, 1, frequent), (1, 1, frequent)]]).filter(F.col("f") >= least)
    two = materialized(scored(materialized(pairs, "pairs"), 2, words), "two")
    frequent = bit_set(two, bits)
    known, three, four, done = words.select("lang", "phrase", "f").union(two.select("lang", "phrase", "f")), None, None, None
    # low: what is expanded in this round and before; high: what was expanded before
    levels = materialized(two.select("lang").distinct().withColumn("high", F.lit(SCALE + 1).cast("long")), "levels")
    while not levels.isEmpty():
        at = two.join(levels, "lang").withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"))))
        at = at.filter(F.col("place") <= reach * top).groupBy("lang").agg(F.when(F.max("place") == reach * top, F.min("score")).otherwise(0).alias("low"))
        levels = materialized(levels.join(at, "lang"), "levels")

        def fresh(table, column, now=levels):
            return table.join(now, "lang").filter((F.col(column) >= F.col("low")) & (F.col(column) < F.col("high")))

        def grown(table, n, wide):
            """Counts of ``n`` words from the table's new prefixes and around its new phrases; their other part is frequent."""
            grow, settle = bit_set(fresh(table, "bound"), bits), bit_set(fresh(table, "score"), bits)
            return count_phrases(texts, n, [
                [(0, n - 1, grow), (n - 2, 2, wide)], [(1, n - 1, settle), (0, 2, wide)]]).filter(F.col("f") >= least)

        def added(old, new, name):
            return materialized(new if old is None else old.select(new.columns).union(new).dropDuplicates(["lang", "phrase"]), name)

        three = added(three, grown(two, 3, frequent), "three")
        scored_three = materialized(scored(three, 3, known), "scored")
        four = added(four, grown(scored_three, 4, frequent), "four")
        scored_four = scored(four, 4, known.union(three.select("lang", "phrase", "f")))
        # last parts of three words that were not grown: counted where the other cuts leave the score open
        lacking = four.join(three.select("lang", F.col("phrase").alias("last")), (four["lang"] == three["lang"]) & (_part(1, 3) == F.col("last")), "left_anti")
        lacking = lacking.join(scored_four.join(levels, "lang").filter(F.col("score") >= F.col("low")), ["lang", "phrase"], "left_semi")
        lacking = materialized(lacking.select("lang", _part(1, 3).alias("phrase")).distinct(), "lacking")
        if not lacking.isEmpty():
            last = bit_set(_hashed(lacking), bits)
            three = added(three, count_phrases(texts, 3, [[(0, 3, last)]]).filter(F.col("f") >= least), "three")
            scored_four = scored(four, 4, known.union(three.select("lang", "phrase", "f")))
        best = None
        for n, table, longer in ((2, two, three), (3, scored_three, four), (4, scored_four, None)):
            rows = table.join(levels, "lang").filter(F.col("score") >= F.col("low"))
            if longer is not None:
                rows = rows.join(_longest(longer, n + 1), ["lang", "phrase"], "left").filter(
                    F.col("longest").isNull() | (100 * F.col("longest") < COVERED * F.col("f")))
            rows = rows.select("lang", "phrase", "f", "l", "r", "score")
            best = rows if best is None else best.union(rows)
        order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("f"), "phrase")
        best = materialized(best.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= top), "best")
        settled = levels.join(best.groupBy("lang").count(), "lang", "left").filter((F.col("count") >= top) | (F.col("low") == 0)).select("lang")
        ready = best.join(settled, "lang", "left_semi")
        done = ready if done is None else done.union(ready)
        levels = materialized(levels.join(settled, "lang", "left_anti").select("lang", F.col("low").alias("high")), "levels")
        reach *= 4
    if done is None:
        return spark.createDataFrame([], "lang string, rank long, phrase string, a long, l long, r long, n long, score long")
    return done.join(totals, "lang").select("lang", "rank", "phrase", F.col("f").alias("a"), "l", "r", "n", "score")


def _tongues(langs: pa.Array) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(x) for x in langs.to_pylist()], np.uint64)


def _hashed(phrases: DataFrame) -> DataFrame:
    """Adds the hash ``h`` that counting gives to phrases (lang, phrase) of three words."""
    def run(batches):
        for batch in batches:
            words = list(zip(*[x.split(" ") for x in batch.column(1).to_pylist()]))
            tongue, fold = _tongues(batch.column(0)), None
            for part in words:
                one = mix(word_hashes(pa.array([w.encode() for w in part], pa.large_binary())) ^ tongue)
                fold = one if fold is None else mix(fold * _STEP + one)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([] if fold is None else fold.view(np.int64), pa.int64())], ["lang", "phrase", "h"])

    return phrases.mapInArrow(run, "lang string, phrase string, h long")
