"""Benchmark passages in documents, found by spaced seeds that ignore some token positions.

A document holds a passage of a benchmark item where at least 11 of 13 tokens in a row
are the same in both, or, for an item of fewer tokens, where all but a sixth of it are.
Three fixed masks of seven positions each find every such window, whichever two tokens
were replaced; a hit is then checked token by token along the item.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .batches import Words, rows_of, slices

WINDOW = 13
SUBSTITUTIONS = 2
#: Any two of 13 positions leave one of these masks, at some shift, untouched.
MASKS = ((0, 1, 2, 3, 5, 6, 7), (0, 1, 4, 7, 8, 9, 10), (0, 3, 4, 5, 7, 10, 11))
BLOCK_TOKENS = 1 << 20
MOST_PAIRS = 1 << 20  # of places, or of tokens under comparison, at a time
_PLACE_BITS = 20
_STEP = 0x9FB21C651E98DF25
_BREAK = np.ones(256, bool)
_BREAK[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
SCHEMA = "doc_id long, item_id long, matched long, item_tokens long, doc_start long, doc_end long"


def tokenizer() -> Words:
    """Runs of ASCII letters, digits and all other non-ASCII bytes, of texts in lower case."""
    return Words(_BREAK, np.arange(256, dtype=np.uint8))


def tokens_of(words: Words, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return words.of(pc.utf8_lower(texts))


def rule(n: int) -> tuple[int, int]:
    """(window, substitutions allowed) for an item of ``n`` tokens."""
    return (WINDOW, SUBSTITUTIONS) if n >= WINDOW else (n, n // 6)


def masks_of(n: int) -> tuple[tuple[int, ...], ...]:
    """Masks for an item of ``n`` tokens: one of them is untouched by the substitutions allowed."""
    if n >= WINDOW:
        return MASKS
    parts = n // 6 + 1
    cuts = [n * i // parts for i in range(parts + 1)]
    return tuple(tuple(range(a, b)) for a, b in zip(cuts, cuts[1:]))


def seed_hashes(tokens: np.ndarray, row: np.ndarray, mask: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens under a mask, with the positions where it fits in one text."""
    span = mask[-1] + 1
    n = len(tokens) - span + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    total = np.zeros(n, np.uint64)
    for k in mask:
        total += tokens[k:n + k] * np.uint64(pow(_STEP, k + 1, 1 << 64))
    at = np.flatnonzero(row[:n] == row[span - 1:])
    return total[at], at


class Items:
    """A block of benchmark items and, per mask, their sorted seed hashes."""

    def __init__(self, ids: list, tokens: np.ndarray, bounds: np.ndarray):
        self.ids, self.tokens, self.bounds = ids, tokens, bounds
        row, sizes = rows_of(bounds), np.diff(bounds)
        self.seeds = []
        chosen: dict[tuple[int, ...], set[int]] = {}
        for n in np.unique(sizes[sizes > 0]).tolist():
            for mask in masks_of(n):
                chosen.setdefault(mask, set()).add(n)
        for mask, lengths in chosen.items():
            # masks of short items stand at a fixed place and are kept from the longer ones
            base = mask[0]
            place = tuple(k - base for k in mask)
            hashes, at = seed_hashes(tokens, row, place)
            keep = np.isin(sizes[row[at]], list(lengths))
            if min(lengths) < WINDOW:
                keep &= at - bounds[row[at]] == base
            hashes, at = hashes[keep], at[keep]
            order = np.argsort(hashes, kind="stable")
            hashes, at = hashes[order], at[order]
            places = np.zeros(1 << _PLACE_BITS, bool)
            places[hashes & np.uint64((1 << _PLACE_BITS) - 1)] = True
            self.seeds.append((place, hashes, at, places))

    def hits(self, tokens: np.ndarray, row: np.ndarray, bounds: np.ndarray):
        """Arrays (text, item, shift) of equal seeds: the item's first token lies ``shift`` tokens into the text.

        Pairs of places are listed at most ``MOST_PAIRS`` at a time. Where a seed comes so
        often in a text and in an item that their pairs outnumber the possible shifts, the
        shifts are marked instead, place by place of the item.
        """
        owner = rows_of(self.bounds)
        for place, hashes, at, places in self.seeds:
            own, pos = seed_hashes(tokens, row, place)
            near = np.flatnonzero(places[own & np.uint64((1 << _PLACE_BITS) - 1)])
            own, pos = own[near], pos[near]
            low = np.searchsorted(hashes, own, "left")
            count = np.searchsorted(hashes, own, "right") - low
            pos, low, count = pos[count > 0], low[count > 0], count[count > 0]
            if count.sum() > MOST_PAIRS:
                group, which, times = np.unique(np.stack([row[pos], low], 1), axis=0, return_inverse=True, return_counts=True)
                which = which.ravel()
                often = np.zeros(len(group), bool)
                for k in np.flatnonzero(times * count[np.unique(which, return_index=True)[1]] > MOST_PAIRS).tolist():
                    text, first = group[k].tolist()
                    mine = pos[which == k] - bounds[text]
                    held = at[first:np.searchsorted(hashes, hashes[first], "right")]
                    often[k] = True
                    for item in np.unique(owner[held]).tolist():
                        places_of = held[owner[held] == item] - self.bounds[item]
                        size = int(self.bounds[item + 1] - self.bounds[item])
                        marked = np.zeros(int(bounds[text + 1] - bounds[text]) + size, bool)
                        for p in places_of.tolist():
                            marked[mine - p + size] = True
                        shifts = np.flatnonzero(marked) - size
                        yield np.full(len(shifts), text), np.full(len(shifts), item), shifts
                left = ~often[which]
                pos, low, count = pos[left], low[left], count[left]
            ends = np.cumsum(count)
            first = 0
            while first < len(pos):
                last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + MOST_PAIRS, "right")))
                some = count[first:last]
                start = np.cumsum(some) - some
                where = at[np.repeat(low[first:last], some) + np.arange(int(some.sum())) - np.repeat(start, some)]
                here = np.repeat(pos[first:last], some)
                texts, found = row[here], owner[where]
                yield texts, found, (here - bounds[texts]) - (where - self.bounds[found])
                first = last

    def passage(self, item: int, text: np.ndarray, shifts: np.ndarray) -> tuple[int, int, int] | None:
        """(equal tokens, start, end) in the text of the windows that pass, the item laid on it at the best of ``shifts``.

        The best has most equal tokens, then the first start. Shifts are tried side by side,
        as many at a time as ``MOST_PAIRS`` tokens allow.
        """
        own = self.tokens[self.bounds[item]:self.bounds[item + 1]]
        window, allowed = rule(len(own))
        most = np.minimum(len(own), len(text) - shifts) - np.maximum(0, -shifts)
        shifts, most = shifts[most >= window], most[most >= window]
        starts = np.arange(len(own) - window + 1)
        ends = np.minimum(np.arange(len(own)), len(starts) - 1)
        best = None
        for k in range(0, len(shifts), max(1, MOST_PAIRS // len(own))):
            some, over = (x[k:k + max(1, MOST_PAIRS // len(own)), None] for x in (shifts, most))
            if best is not None:  # no more tokens are equal than overlap, and none before the shift
                some = some[(over > best[0]) | (over == best[0]) & (some < best[1])][:, None]
                if not len(some):
                    continue
            at = some + np.arange(len(own))
            same = (text[np.clip(at, 0, len(text) - 1)] == own) & (at >= 0) & (at < len(text))
            sums = np.zeros((len(some), len(own) + 1), np.int32)
            np.cumsum(same, axis=1, out=sums[:, 1:])
            good = (sums[:, window:] - sums[:, :-window] >= window - allowed) & (starts + some >= 0) & (starts + window + some <= len(text))
            passing = np.flatnonzero(good.any(axis=1))
            if not len(passing):
                continue
            good, same, some = good[passing], same[passing], some[passing, 0]
            met = np.cumsum(good, axis=1, dtype=np.int32)
            inside = met[:, ends]
            inside[:, window:] -= met[:, :len(own) - window]
            matched = (same & (inside > 0)).sum(axis=1)
            first = good.argmax(axis=1) + some
            last = good.shape[1] - 1 - good[:, ::-1].argmax(axis=1) + window + some
            j = np.lexsort((some, first, -matched))[0]
            got = (int(matched[j]), int(first[j]), int(last[j]))
            if best is None or (-got[0], got[1]) < (-best[0], best[1]):
                best = got
        return best


def blocks(benchmark: DataFrame, size: int):
    """The benchmark's items in blocks of at most ``size`` tokens, or one item."""
    def run(batches):
        words = tokenizer()
        for batch in slices(batches, 1):
            tokens, bounds = tokens_of(words, batch.column(1))
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.ListArray.from_arrays(bounds.astype(np.int32), tokens.view(np.int64))], ["item_id", "tokens"])

    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    rows = items.mapInArrow(run, "item_id long, tokens array<long>").filter("size(tokens) > 0").toLocalIterator()
    held, count = [], 0
    for row in rows:
        if held and count + len(row.tokens) > size:
            yield _block(held)
            held, count = [], 0
        held.append(row)
        count += len(row.tokens)
    if held:
        yield _block(held)


def _block(rows) -> Items:
    bounds = np.concatenate(([0], np.cumsum([len(r.tokens) for r in rows])))
    return Items([r.item_id for r in rows], np.concatenate([np.array(r.tokens, np.int64) for r in rows]).view(np.uint64), bounds)


def contaminated(docs: DataFrame, benchmark: DataFrame, block: int = BLOCK_TOKENS) -> DataFrame:
    """A row per row of ``docs`` (doc_id, text) and item of ``benchmark`` (item_id, text) found in it.

    ``matched`` counts equal tokens in passing windows of the best place (ties: the first),
    ``doc_start`` and ``doc_end`` are its token positions. Tokens are runs of letters and
    digits in lower case. Null and empty texts and items match nothing; repeated rows are
    reported each. Texts are read once per block of the benchmark (a block holds at most
    ``block`` tokens, so what tasks are sent is bounded) and never shuffled.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = None
    for items in blocks(benchmark, block):
        part = docs.mapInArrow(_search(spark.sparkContext.broadcast((items.ids, items.tokens, items.bounds))), SCHEMA)
        found = part if found is None else found.union(part)
    return spark.createDataFrame([], SCHEMA) if found is None else found


def _search(shared):
    def run(batches):
        words, items = tokenizer(), Items(*shared.value)
        for batch in slices(batches, 1):
            tokens, bounds = tokens_of(words, batch.column(1))
            row = rows_of(bounds)
            best: dict[tuple[int, int], tuple[int, int, int]] = {}
            for texts, found, shifts in items.hits(tokens, row, bounds):
                order = np.lexsort((shifts, found, texts))
                texts, found, shifts = texts[order], found[order], shifts[order]
                new = np.ones(len(texts), bool)
                new[1:] = (np.diff(texts) != 0) | (np.diff(found) != 0) | (np.diff(shifts) != 0)
                texts, found, shifts = texts[new], found[new], shifts[new]
                edges = np.flatnonzero(np.concatenate(([True], (np.diff(texts) != 0) | (np.diff(found) != 0), [True]))) if len(texts) else []
                for a, b in zip(edges[:-1], edges[1:]):
                    text, item = int(texts[a]), int(found[a])
                    got = items.passage(item, tokens[bounds[text]:bounds[text + 1]], shifts[a:b])
                    old = best.get((text, item))
                    if got and (old is None or (-got[0], got[1]) < (-old[0], old[1])):
                        best[text, item] = got
            if best:
                keys = list(best)
                size = np.diff(items.bounds)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(pa.array([t for t, _ in keys])), pa.array([items.ids[i] for _, i in keys], pa.int64()),
                    pa.array([best[k][0] for k in keys], pa.int64()), pa.array([int(size[i]) for _, i in keys], pa.int64()),
                    pa.array([best[k][1] for k in keys], pa.int64()), pa.array([best[k][2] for k in keys], pa.int64()),
                ], ["doc_id", "item_id", "matched", "item_tokens", "doc_start", "doc_end"])

    return run


def without_contaminated(docs: DataFrame, benchmark: DataFrame, block: int = BLOCK_TOKENS) -> DataFrame:
    """The rows of ``docs`` in which no item of ``benchmark`` is found, all columns kept.

    A narrow step over the texts for each block of the benchmark.
    """
    spark, names = docs.sparkSession, docs.columns
    at = names.index("text")
    for items in blocks(benchmark, block):
        shared = spark.sparkContext.broadcast((items.ids, items.tokens, items.bounds))
        search = _search(shared)

        def run(batches, search=search):
            for batch in slices(batches, at):
                numbered = pa.RecordBatch.from_arrays([pa.array(np.arange(batch.num_rows)), batch.column(at)], ["doc_id", "text"])
                bad = np.zeros(batch.num_rows, bool)
                for hits in search([numbered]):
                    bad[hits.column(0).to_numpy()] = True
                yield batch.filter(pa.array(~bad))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
