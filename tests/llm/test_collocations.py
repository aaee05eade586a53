"""Collocations against plain counts of all phrases."""

import random
import re
from collections import Counter, defaultdict

import pytest

from loanloom.llm.batches import BATCH_BYTES, BATCH_LIMIT
from loanloom.llm.collocations import bit_set, collocations, count_phrases


def pieces(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", lowered)]


def brute(rows, top, least):
    counts = defaultdict(Counter)
    for text, lang in rows:
        for words in pieces(text):
            counts["und" if lang is None else lang].update(tuple(words[i:i + n]) for n in (1, 2, 3, 4) for i in range(len(words) - n + 1))
    out = []
    for lang, c in counts.items():
        held = {x: a for x, a in c.items() if len(x) > 1 and a >= least}
        covered = {y[i:j] for y, f in held.items() for i in range(len(y)) for j in range(i + 2, len(y) + 1)
                   if j - i < len(y) and 100 * f >= 80 * c[y[i:j]]}
        lines = []
        for x, a in held.items():
            if x not in covered:
                score, k = min((2_000_000 * a // (c[x[:k]] + c[x[k:]]), k) for k in range(1, len(x)))
                lines.append((-score, -a, " ".join(x).encode(), " ".join(x), c[x[:k]], c[x[k:]]))
        n = sum(f for x, f in c.items() if len(x) == 1)
        out += [(lang, i + 1, x, -a, left, right, n, -s) for i, (s, a, _, x, left, right) in enumerate(sorted(lines)[:top])]
    return sorted(out)


def found(df):
    return sorted(tuple(r) for r in df.collect())


def corpus(seed, docs=60):
    draw = random.Random(seed)
    words = [f"w{i}" for i in range(30)] + ["Ärger", "É", "日本", "x-y", "it's", "(a"]
    fixed = ["one two three four five six", "New York City", "of the", "a rose is a rose is a rose", "y y y y y y"]
    rows = [(None, "en"), ("", "en"), ("... !", "de"), ("only words here", None), ("lone", "xx")]
    for i in range(docs):
        parts = [draw.choice(fixed) if draw.random() < 0.3 else draw.choices(words, weights=range(1, len(words) + 1))[0] for _ in range(draw.randrange(1, 60))]
        text = "".join(p + draw.choice([" ", " ", "  ", "\t", ", ", ".", "\n", "\x0b", " "]) for p in parts)
        rows.append((text, ["en", "de", None, "fr"][i % 4]))
    return rows + rows[-5:]


@pytest.mark.parametrize("seed, top, least, reach, bits", [
    (1, 2000, 3, 3, 1 << 24), (2, 5, 2, 1, 1 << 24), (3, 1, 4, 1, 1 << 15), (4, 30, 1, 1, 1 << 24), (5, 12, 2, 2, 1 << 15)])
def test_equals_plain_counts(spark, seed, top, least, reach, bits):
    rows = corpus(seed)
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "text string, lang string, phrase int, f string")
    assert found(collocations(df, top, least, reach, bits)) == brute(rows, top, least)


def test_no_rows(spark):
    assert collocations(spark.createDataFrame([], "text string, lang string")).count() == 0
    assert collocations(spark.createDataFrame([("a b", "en")], "text string, lang string")).count() == 0


def test_documents_of_the_test_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text", "lang")
    assert found(collocations(df, 50, 4, 1)) == brute([tuple(r) for r in df.collect()], 50, 4)


def test_blocks_and_sets(spark):
    rows = corpus(9)
    long = [(" ".join(t or "" for t, _ in rows), "en")]
    df = spark.createDataFrame(long, "text string, lang string")
    plain = Counter(" ".join(w[i:i + 3]) for w in pieces(long[0][0]) for i in range(len(w) - 2))
    for size in (20, 999, 1 << 20):
        three = count_phrases(df, 3, size=size)
        assert {r["phrase"]: r["f"] for r in three.collect()} == plain
    two = count_phrases(df, 2)
    only = bit_set(two.filter("phrase = 'of the'"))
    kept = {r["phrase"] for r in count_phrases(df, 3, [[(0, 2, only)]]).collect()}
    assert kept == {p for p in plain if p.startswith("of the ")}
    assert count_phrases(df, 3, [[(0, 2, bit_set(two.limit(0)))]]).count() == 0


def test_texts_come_in_batches_bounded_by_bytes(spark):
    before = spark.conf.get(BATCH_LIMIT, None)
    try:
        spark.conf.unset(BATCH_LIMIT)
        collocations(spark.createDataFrame([("a b", "en")], "text string, lang string"))
        assert int(spark.conf.get(BATCH_LIMIT)) == BATCH_BYTES
    finally:
        spark.conf.unset(BATCH_LIMIT) if before is None else spark.conf.set(BATCH_LIMIT, before)
