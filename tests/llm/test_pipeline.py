"""Pipeline stages against brute force on a small folder, and odd rows in every stage."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as P
from loanloom.llm import langid

from .test_decontaminate import brute as contaminated
from .test_langid import corpus
from .test_partenum import brute as components
from .test_secrets import brute as spans

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score int, node string"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    rnd = random.Random(4)
    items = [(i, " ".join(f"item{i} word{rnd.randrange(99)}" for _ in range(10))) for i in range(5)]
    rows = [(i, t, g) for i, t, g in corpus(120, 3)]
    rows += [(200 + i, t + (" extra" if i % 2 else ""), g) for i, (_, t, g) in enumerate(rows[:40])]
    rows += [(300, rows[5][1] + " " + items[2][1] + " " + rows[6][1], rows[5][2]), (301, rows[7][1] + " token = abcdef0123456789abcdef0123", None)]
    rows += [(400, None, "aa"), (401, "", None), (402, "123 !", "bb"), (7, rows[7][1], "cc"), (7, "tokami rusha " * 30, "aa"), (None, "strom ung keit ver", "bb"),
             (None, "strom ung keit ver", "bb"), (None, rows[8][1], "aa"), (403, "kato " * 60_000, None)]
    docs = [(i, t, g, "s", len(t) if t is not None else None, 1, "x") for i, t, g in rows]
    spark.createDataFrame(docs, SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, items


def rows_of(df):
    return sorted((tuple(r) for r in df.select(*P.COLUMNS).collect()), key=str)


def test_stages(spark, folder):
    path, items = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    steps = {}
    for name, stage in P.STAGES[:-1]:
        before = rows_of(docs)
        docs = P.materialized(stage(spark, docs, path), name)
        assert tuple(docs.columns) == P.COLUMNS
        steps[name] = before, rows_of(docs)
    before, after = steps["language_id"]
    assert after == [r for r in before if r[1] and langid._LETTER.search(r[1])]
    before, after = steps["near_duplicates"]
    groups = components([(r[0], r[1]) for r in before])
    assert len(after) == len({(c if c is not None else "null") for _, n, c in groups if n})  + sum(r[0] == 7 for r in after) - 1
    assert {r[0] for r in after} == {c for _, _, c in groups}
    assert [r[1][:6] for r in after if r[0] == 7] and sum(r[0] == 7 for r in after) == 2
    before, after = steps["decontamination"]
    bad = {d for d, _ in contaminated([(i, r[1]) for i, r in enumerate(before) if len(r[1]) < 9000], items)}
    assert bad and after == [r for i, r in enumerate(before) if i not in bad]
    before, after = steps["secret_scan"]
    assert [r[0] for r in before] == [r[0] for r in after]
    for old, new in zip(before, after):
        if spans(old[1]):
            assert "[secret]" in new[1] and not spans(new[1]) and new[4] == len(new[1])
        else:
            assert old == new
    assert any(spans(r[1]) for r in before)
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {(r[0], hashlib.sha256(np.array(library.encode(r[1], add_special_tokens=False).ids, "<u4").tobytes()).hexdigest()) for r in after}
    last = P.run(spark, path).collect()
    assert {(r.doc_id, r.ids_sha256) for r in last} == want and len(last) == len(after)
    assert all(hashlib.sha256(r.ids).hexdigest() == r.ids_sha256 and 4 * r.n_tokens == len(r.ids) for r in last)
    assert all(hashlib.sha256(library.decode(np.frombuffer(r.ids, "<u4").tolist(), skip_special_tokens=False).encode()).hexdigest() == r.decoded_sha256 for r in last[:50])


def test_odd_rows_in_every_stage(spark, folder):
    path, _ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    odd = docs.filter("doc_id IS NULL OR doc_id >= 400 OR doc_id = 7")
    for name, stage in P.STAGES:
        assert stage(spark, odd, path).count() <= odd.count()
        assert stage(spark, odd.limit(0), path).count() == 0


def test_texts_in_which_no_learned_language_stands_out_go(spark):
    rnd = random.Random(9)
    other = [" ".join("".join(rnd.choice(["zwo", "bly", "pni", "gdze", "wux"]) for _ in range(rnd.randrange(1, 4))) for _ in range(rnd.randrange(3, 60))) for _ in range(60)]
    rows = [(i, t, g) for i, t, g in corpus(300, 3)]
    docs = spark.createDataFrame(
        [(i, t, g, "s", len(t)) for i, t, g in rows + [(1000 + i, t, None) for i, t in enumerate(other)]],
        "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r.doc_id for r in P.language_id(spark, docs, "").collect()}
    assert {i for i, _, _ in rows} <= kept and sum(i >= 1000 for i in kept) <= 40


def test_least_score_follows_languages_and_scores():
    sure, unsure = np.full(1000, 0.999), np.linspace(0.6, 0.999, 100)
    for n in (2, 3, 4, 50):
        assert 1 / n < langid.least_score(unsure, n) < langid.least_score(sure, n) < 0.999
        assert langid.least_score(unsure, n) < 0.6 and abs(langid.least_score(np.zeros(0), n) - 1 / n) < 1e-9
    assert langid.least_score(np.ones(5), 1) <= 1


def test_texts_reach_tasks_in_batches_bounded_by_bytes(spark):
    docs = spark.range(3000).selectExpr("id AS doc_id", "repeat('ab cd ', 1000) AS text", "'en' AS lang", "'s' AS source", "6000L AS n_chars").coalesce(1)

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], ["rows"])

    before = spark.conf.get(P.BATCH_LIMIT, None)
    try:
        spark.conf.unset(P.BATCH_LIMIT)
        most = max(r.rows for r in P.columns_of(docs).mapInArrow(sizes, "rows long").collect())
        assert 1 < most <= 1.1 * P.BATCH_BYTES / 6000
        spark.conf.set(P.BATCH_LIMIT, "1m")
        P.columns_of(docs)
        assert spark.conf.get(P.BATCH_LIMIT) == "1m"  # the session's own limit stays
    finally:
        spark.conf.unset(P.BATCH_LIMIT) if before is None else spark.conf.set(P.BATCH_LIMIT, before)
