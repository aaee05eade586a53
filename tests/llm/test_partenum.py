"""The signature join against all pairs."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from loanloom.llm import partenum
from loanloom.llm.batches import Words

TABLE = {ord(c): ord(c) + 32 for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(TABLE))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4)))


def brute(rows):
    """(doc_id, n_shingles, component_id) by comparing all sets that share a shingle."""
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    where = {}
    for i, s in enumerate(sets):
        for x in s:
            where.setdefault(x, []).append(i)
    for i, s in enumerate(sets):
        for j in {j for x in s for j in where[x] if j < i}:
            both = len(s & sets[j])
            if 100 * both >= 75 * (len(s) + len(sets[j]) - both):
                up[max(root(i), root(j))] = min(root(i), root(j))
    least = {}
    for i, (d, _) in enumerate(rows):
        ids = least.setdefault(root(i), [])
        if d is not None:
            ids.append(d)
    return sorted(((d, len(sets[i]), (min(least[root(i)], default=None) if sets[i] else d)) for i, (d, _) in enumerate(rows)), key=str)


def run(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return sorted((tuple(r) for r in partenum.similar_components(df).collect()), key=str)


def corpus(seed, base=12):
    rnd = random.Random(seed)
    word = lambda: rnd.choice("ab cd ef gh ij kl mn op qr st uv wx yz".split()) + str(rnd.randrange(300))
    passage = [word() for _ in range(70)]
    texts = []
    for _ in range(base):
        words = [word() for _ in range(rnd.choice([3, 20, 60, 75, 90, 250, 300, 520, 1000, 1500]))]
        if rnd.random() < 0.6:
            words[2:2] = passage
        for _ in range(rnd.choice([1, 2, 9])):
            near = list(words)
            for _ in range(int(len(near) * rnd.choice([0, 0.01, 0.03, 0.05, 0.06]))):
                i = rnd.randrange(len(near))
                near[i:i + rnd.randrange(3)] = [word()] * rnd.randrange(3)
            cut = rnd.choice([0, 0, len(near) // 6, len(near) // 4])
            texts.append(" ".join(near[cut:]))
    rnd.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("seed", range(4))
def test_equals_all_pairs(spark, seed):
    rows = corpus(seed)
    assert run(spark, rows) == brute(rows)


def test_odd_rows(spark):
    copy = " ".join(f"w{i}" for i in range(40))
    rows = [(5, copy), (3, copy.upper()), (3, "other words in here now"), (None, copy), (7, None), (8, ""), (9, " \t\n"), (1, "One two"),
            (2, "one TWO"), (4, "é É"), (6, "é é"), (10, "x" * 3_000_000), (11, "x" * 3_000_000), (12, copy), (12, copy)]
    assert run(spark, rows) == brute(rows)
    assert run(spark, rows[:0]) == []
    assert run(spark, [(None, "a b"), (None, "a b")]) == [(None, 1, None)] * 2


def test_words_across_blocks():
    rnd = random.Random(5)
    texts = ["".join(rnd.choice("aé \nB") for _ in range(rnd.randrange(200))) for _ in range(40)] + ["", "z" * 700, None]
    small, large = Words(block=64).of(pa.array(texts)), Words().of(pa.array(texts))
    assert all(np.array_equal(a, b) for a, b in zip(small, large))
    words = [w for t in texts for w in re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(TABLE))]
    assert len(words) == len(large[0]) and len(set(words)) == len(set(large[0].tolist()))


@pytest.mark.parametrize("split,pick", [(2, 1), (3, 2), (4, 2)])
def test_similar_sets_share_enough_signatures(split, pick):
    rng = np.random.default_rng(3)
    scheme = partenum.PartEnum(split=split, pick=pick)
    for size in (1100, 1500, 2047, 2100):
        for _ in range(8):
            large = np.unique(rng.integers(0, 2**63, size, dtype=np.int64)).astype(np.uint64)
            dropped = rng.integers(0, len(large) // 7)
            small = np.concatenate((large[rng.permutation(len(large))[dropped:]], rng.integers(0, 2**63, dropped, dtype=np.int64).astype(np.uint64)))
            small = np.unique(small[:len(large)])
            both = len(np.intersect1d(large, small))
            if both * 4 < 3 * (len(large) + len(small) - both):
                continue
            sig, row, met = scheme.signatures(np.concatenate((large, small)), np.array([0, len(large), len(large) + len(small)]))
            level = scheme.level(np.array([len(large)]))[0]
            own = {s for s in sig[row == 0].tolist() if s & 31 == level}
            assert len(own & set(sig[row == 1].tolist())) >= met[0] - scheme.errors(np.array([len(large)]))[0] * scheme.spoilt


@pytest.mark.parametrize("split,pick", [(2, 1), (4, 2)])
def test_another_seed_cuts_a_clumped_set_elsewhere(split, pick):
    clumped = np.arange(3000, dtype=np.uint64)  # all in one part of a domain cut by value
    bounds = np.array([0, 3000])
    met = [int(partenum.PartEnum(split=split, pick=pick, seed=seed).signatures(clumped, bounds)[2][0]) for seed in range(4)]
    assert min(met) > 1000 and len(set(met)) > 1


def test_held_signatures_and_batches_are_bounded(spark):
    limit = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(limit, None)
    try:
        spark.conf.unset(limit)
        partenum.similar_components(spark.createDataFrame([(1, "a b c"), (2, "a b c")], "doc_id long, text string"))
        assert int(spark.conf.get(limit)) == 4 << 20
    finally:
        spark.conf.unset(limit) if before is None else spark.conf.set(limit, before)
    assert partenum.PACK_BYTES <= 2 << 20
