"""Language identification: accuracy on texts not learned from, and odd rows."""

import random

import numpy as np

from loanloom.llm import langid as L

SOUNDS = {"aa": ["ka", "to", "mi", "ru", "sha"], "bb": ["strom", "ung", "keit", "ver", "ich"], "cc": ["eau", "tion", "ê", "que", "oi"]}


def corpus(n, seed=1):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        lang = rnd.choice(list(SOUNDS))
        words = ["".join(rnd.choice(SOUNDS[lang]) for _ in range(rnd.randrange(1, 4))) for _ in range(rnd.randrange(3, 60))]
        rows.append((i, " ".join(words), lang))
    return rows


def test_held_out_accuracy_and_odd_rows(spark):
    odd = [(9001, None, "aa"), (9002, "", None), (9003, "12 34 !!", "bb"), (9004, "kato", None), (None, "eautionque oi", "cc"), (9005, "Ketome " * 400_000, None)]
    rows = corpus(600) + odd
    df = spark.createDataFrame([(i, t, g, 1, "n") for i, t, g in rows], "doc_id long, text string, lang string, score int, lang_pred string")
    got = {r.doc_id: r for r in L.identify(df).collect()}
    assert len(got) == len(rows)
    held = [(i, g) for i, _, g in rows[:600] if got[i].held_out]
    assert 100 < len(held) < 200 and np.mean([got[i].lang_pred == g for i, g in held]) > 0.97
    assert all((got[i].lang_pred, got[i].score) == ("und", 0.0) for i in (9001, 9002, 9003))
    assert got[9005].lang_pred == "aa" and all(0 <= r.score <= 1 for r in got.values())
    again = {r.doc_id: (r.lang_pred, r.score) for r in L.identify(df.repartition(5)).collect()}
    assert all(again[i] == (r.lang_pred, r.score) for i, r in got.items())


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([(1, "some text", None), (3, None, None)], "doc_id long, text string, lang string")
    assert [(r.lang_pred, r.score) for r in L.identify(df).collect()] == [("und", 0.0)] * 2
    assert L.identify(df.limit(0)).count() == 0


def test_long_texts_count_as_short_ones():
    text = "Être ou ne pas être, 12 fois! " * 50
    whole = L.gram_counts(text)
    old = L._BLOCK_CHARS
    try:
        L._BLOCK_CHARS = len("Être ou ne pas être, 12 fois! ") * 5
        assert np.abs(L.gram_counts(text) - whole).sum() <= 12 * 20
    finally:
        L._BLOCK_CHARS = old


def test_penalties_and_calibration():
    rng = np.random.default_rng(0)
    rows = [(np.array([i % 2, 5 + rng.integers(50)]), np.array([1.0, 0.3]), i % 2) for i in range(400)]
    dense, _ = L.fit_ftrl(rows, 2, l1=0.0)
    sparse, _ = L.fit_ftrl(rows, 2, l1=0.5)
    assert (sparse != 0).sum() < (dense != 0).sum() / 3 and sparse[0, 0] > 0 > sparse[1, 0]
    logits = rng.normal(size=(4000, 3))
    labels = np.array([rng.choice(3, p=p) for p in L.softmax(logits / 2.5)])
    assert abs(L.fit_temperature(logits, labels) - 2.5) < 0.3


def test_blocks_lose_no_gram(monkeypatch):
    texts = ["Être ou ne pas être, 12 fois! " * 50, "kato" * 300, "İΣ' ΑΣ a", "x", ""]
    whole = [L.gram_counts(t) for t in texts]
    for block in (1, 2, 3, 7, 64):
        monkeypatch.setattr(L, "_BLOCK_CHARS", block)
        assert all((L.gram_counts(t) == w).all() for t, w in zip(texts, whole))


def test_numerals_and_fractions_are_no_letters():
    model = L.Model(["a", "b"], np.ones(L.BUCKETS), np.zeros((L.BUCKETS, 2)), np.zeros(2))
    for text in ("\u00bd", "\u00b2 \u2167", "\u2460 12", "\u0301", "_-_", "\n"):
        assert model.predict(text) == ("und", 0.0)
    for text in ("a", "\u00aa", "1\u65e5", "\u02b0", "\U00010400"):
        assert model.predict(text)[0] in ("a", "b")
