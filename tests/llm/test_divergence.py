"""Source divergence against plain counts of every term."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from loanloom.llm import divergence as module
from loanloom.llm.divergence import LETTERS, consed, divergence, priced, term_counts
from loanloom.llm.vocab import WordBlocks, byte_table

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def brute(rows, least, top=50):
    held, counts = defaultdict(Counter), defaultdict(Counter)
    groups = {(lang or "", source or "") for _, lang, source in rows}
    for text, lang, source in rows:
        terms = TERM.findall(lowered(text or ""))
        held[lang or ""].update(set(terms))
        counts[lang or "", source or ""].update(terms)
    out = []
    for lang in {g[0] for g in groups}:
        kept = sorted(t for t, n in held[lang].items() if n >= least)
        mine = sorted(s for g, s in groups if g == lang)
        every = Counter({t: sum(counts[lang, s][t] for s in mine) for t in kept})

        def share(c):
            total = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 5) // (total + 5 * len(kept)) for t in kept}

        p, q = {s: share(counts[lang, s]) for s in mine}, share(every)
        for s in mine:
            pairs = sorted((-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode(), o) for o in mine if o != s)
            terms = sorted((q[t] - p[s][t], t.encode(), t) for t in kept if counts[lang, s][t] and p[s][t] > q[t])[:top]
            out += [(lang, s, part, i, -v, r + 1) for part, x in (("pair", pairs), ("term", terms)) for r, (v, _, i) in enumerate(x)]
    return sorted(out)


ROWS = [
    ("Der Hund, der Hund! ÄÖ äö x_y A1b", "de", "a"), ("der Hund und die Katze", "de", "b"), ("Die KATZE und der Hund", "de", "c"), (None, "de", "d"),
    ("", "de", None), ("the cat and the dog the the", "en", "a"), ("the cat and the dog the the", "en", "a"), ("a dog", "en", "b"), ("cat" * 5, "en", "é"),
    ("words here", None, "a"), ("words here too", None, None), ("12 34 !!", "xx", "a"), (None, "xx", "b"), ("alone", "yy", "only"), ("日本語 日本 ſ K", "en", "z"),
]


def found(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("least, range_terms, panel", [(1, 2048, 48), (1, 2, 48), (1, 3, 1), (2, 1, 2), (100, 8, 8)])
def test_equals_plain_counts(spark, least, range_terms, panel):
    df = spark.createDataFrame([(*r, 1, "x") for r in ROWS], "text string, lang string, source string, term int, value string")
    assert found(divergence(df, least=least, range_terms=range_terms, panel=panel)) == brute(ROWS, least)


def test_no_rows(spark):
    assert divergence(spark.createDataFrame([], "text string, lang string, source string")).count() == 0


def test_documents_of_the_test_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text", "lang", "source")
    rows = [tuple(r) for r in df.collect()]
    assert found(divergence(df, least=5, range_terms=100)) == brute(rows, 5)


def test_long_texts_are_one_document(spark):
    text = " ".join(f"w{chr(97 + i % 20)}é, {i}" for i in range(400))
    df = spark.createDataFrame([(text, "a", "b"), ("wbé", "a", "b")], "text string, lang string, source string").coalesce(1)
    for size in (8, 50, 1000, 1 << 20):
        rows = term_counts(df, size).collect()
        assert {r["term"]: (r["count"], r["documents"]) for r in rows} == {f"w{chr(97 + i)}é": (20 + (i == 1), 1 + (i == 1)) for i in range(20)}


def test_equal_subtrees_are_one_node():
    leaves = np.array([[0, 1, 0, 1, 2], [0, 1, 0, 1, 2], [0, 0, 0, 0, 1]])
    roots, levels = consed(leaves)
    assert roots[0] == roots[1] != roots[2] and [len(left) for left, _ in levels] == [2, 4, 4]


def test_prices_of_pairs():
    draw = np.random.default_rng(3)
    for width in (1, 2, 5, 64, 77):
        leaves = draw.integers(0, 3, (6, width))
        shares = draw.integers(0, 10**9, (6, 3))
        first, second = np.triu_indices(6, 1)
        whole = [np.abs(shares[a][leaves[a]] - shares[b][leaves[b]]).sum() for a, b in zip(first, second)]
        assert priced(leaves, shares, first, second).tolist() == whole


def test_blocks_keep_all_sequences():
    import pyarrow as pa

    stop = byte_table(0x2E)
    text = "aa b. ccc d e f g" * 30 + " " + "h" * 200 + " i j k l."
    words = [w for piece in text.split(".") for w in [re.findall("[A-Za-z]+", piece)] if w]
    for n in (1, 2, 3, 4):
        whole = Counter(tuple(w[i:i + n]) for w in words for i in range(len(w) - n + 1))
        for size in (1, 10, 100, 10_000):
            seen = Counter()
            for block in WordBlocks(LETTERS, stop, 3, size).of([pa.RecordBatch.from_pydict({"text": [text]})]):
                names = [w.decode() for w in block.words.to_pylist()]
                seen.update(tuple(names[block.ids[i + k]] for k in range(n)) for i in block.starts(n))
            assert seen == whole
    assert module.LEAST_DOCUMENTS == 30
