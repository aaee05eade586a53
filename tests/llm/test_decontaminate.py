"""Spaced seeds against a search of every placement."""

import itertools
import random
import re
import time

import numpy as np
import pyarrow as pa
import pytest

from loanloom.llm import decontaminate as D

TOKEN = re.compile(r"[0-9a-z\x80-\U0010ffff]+")


def tokens(text):
    return TOKEN.findall((text or "").lower())


def brute(docs, items):
    """{(doc_id, item_id): most equal tokens in passing windows of one placement}."""
    found = {}
    for (d, text), (i, item) in itertools.product(docs, items):
        a, b = tokens(text), tokens(item)
        if not b:
            continue
        window, allowed = (13, 2) if len(b) >= 13 else (len(b), len(b) // 6)
        for shift in range(-len(b), len(a)):
            same = {k: a[k + shift] == b[k] for k in range(len(b)) if 0 <= k + shift < len(a)}
            inside = set()
            for k in range(len(b) - window + 1):
                span = range(k, k + window)
                if all(x in same for x in span) and sum(same[x] for x in span) >= window - allowed:
                    inside |= set(span)
            if inside:
                found[d, i] = max(found.get((d, i), 0), sum(same[x] for x in inside))
    return found


def test_masks_find_any_two_substitutions():
    for n in range(1, 15):
        window, allowed = D.rule(n)
        for gone in itertools.combinations(range(window), allowed):
            places = [{o + k for k in m} for m in D.masks_of(n) for o in (range(window - m[-1]) if n >= 13 else (0,))]
            assert any(not p & set(gone) for p in places), (n, gone)


@pytest.mark.parametrize("pairs", [D.MOST_PAIRS, 40, 3])
def test_equals_search(spark, monkeypatch, pairs):
    monkeypatch.setattr(D, "MOST_PAIRS", pairs)
    rnd = random.Random(2)
    word = lambda: rnd.choice(["the", "of", "a", "Émile", "x1", "run", "blue", "sky", "go", "far"]) + str(rnd.randrange(40))
    items = [(i, " ".join(word() for _ in range(rnd.choice([1, 4, 7, 12, 13, 14, 30, 60])))) for i in range(14)] + [
        (60, " ".join(["go1", "far2"] * 12)), (61, " ".join(["sky3"] * 20))] + [(90, None), (91, ""), (None, "null id item with eight words here")]
    docs = []
    for d in range(40):
        words = ["go1", "far2"] * 15 + ["sky3"] * 25 if d % 13 == 5 else ["sky3"] * 14 + ["go1", "far2"] * 8 if d % 13 == 6 else [word() for _ in range(rnd.randrange(0, 80))]
        item = rnd.choice(items)[1]
        part = (item or "").split()
        for _ in range(rnd.randrange(5)):
            if part:
                part[rnd.randrange(len(part))] = word()
        cut = rnd.randrange(3)
        at = rnd.randrange(len(words) + 1)
        words[at:at] = part[cut:]
        docs.append((d, rnd.choice([" ", "\n", ", "]).join(words).upper()))
    docs += [(100, None), (101, ""), (102, " ".join(["same"] * 30000)), (None, items[0][1]), (3, docs[3][1])]
    df = spark.createDataFrame([(d, t, 7) for d, t in docs], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, doc_id int")
    want = brute(docs[:41] + docs[43:44], items)
    for block in (D.BLOCK_TOKENS, 20):
        got = D.contaminated(df, bench, block).collect()
        assert {(r.doc_id, r.item_id): r.matched for r in got} == want
        assert len(got) == len(want) + sum(k[0] == 3 for k in want)
    clean = D.without_contaminated(df, bench, 20)
    assert clean.columns == df.columns
    assert sorted(str(r.doc_id) for r in clean.collect()) == sorted(str(d) for d, _ in docs if d not in {k[0] for k in want})
    assert D.contaminated(df, bench.limit(0)).count() == 0 and D.contaminated(df.limit(0), bench).count() == 0


def test_repeated_tokens_take_linear_time():
    class Sent:
        value = None

    def search(item, text):
        hashes, bounds = D.tokens_of(D.tokenizer(), pa.array([item]))
        Sent.value = ([5], hashes, bounds)
        return [tuple(c[0].as_py() for c in b.columns) for b in D._search(Sent)([pa.RecordBatch.from_pydict({"doc_id": [1], "text": [text]})])]

    start = time.perf_counter()
    assert search("same " * 1000, "same " * 100_000) == [(1, 5, 1000, 1000, 0, 1000)]
    assert search("one two " * 500, "two one " * 50_000) == [(1, 5, 1000, 1000, 1, 1001)]
    assert time.perf_counter() - start < 20
    assert search("same " * 12, "same " * 5000) == [(1, 5, 12, 12, 0, 12)]
    assert np.array_equal(search("a b c d e f g h i j k l m n", "z " * 50), [])
