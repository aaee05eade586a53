"""Histogram-sorted shards: the law, slots, copies and odd rows."""

import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from loanloom.llm import shards

SCHEMA = "doc_id long, text string, shard string, size int"


def check(rows, got, tolerance):
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in got) == sorted(
        (str(i), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    by = defaultdict(list)
    for r in got:
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < 16
        by[r.shard].append(r)
    for own in by.values():
        assert sorted(r.slot for r in own) == list(range(len(own)))
    total = sum(r.size for r in got)
    assert all(abs(sum(r.size for r in by[s]) - total / 16) <= tolerance for s in range(16))


def test_hot_text_and_copies(spark):
    rows = [(i, f"text {i} " * (i % 50)) for i in range(2000)] + [(5000 + i, "the same page " * 20) for i in range(1000)] + [(7, "one row again")] * 300
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], SCHEMA)
    got = shards.sharded_documents(df).collect()
    check(rows, got, 500)
    homes = defaultdict(set)
    for r, (text) in ((r, r.text_crc32) for r in got):
        homes[text].add(r.shard)
    assert max(len(s) for s in homes.values()) <= 8 and sum(len(s) > 1 for s in homes.values()) <= 16
    again = {(r.doc_id, r.shard) for r in shards.sharded_documents(df).collect()}
    assert again == {(r.doc_id, r.shard) for r in got}


def test_odd_rows(spark):
    rows = [(None, None), (None, ""), (1, None), (2, "é" * 100_000), (2, "é" * 100_000)]
    got = shards.sharded_documents(spark.createDataFrame([(i, t, "x", 1) for i, t in rows], SCHEMA)).collect()
    check(rows, got, 10 ** 9)
    assert shards.sharded_documents(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("values", [range(1000), [5] * 1000, [0] * 500 + [2 ** 62] * 3])
def test_any_keys(spark, values):
    df = spark.createDataFrame([(v, i) for i, v in enumerate(values)], "key long, row long").withColumn("size", F.lit(10).cast("long"))
    got = shards.histogram_shards(df, "key", "size", 4, ["row"]).orderBy("shard", "slot").collect()
    assert [r.key for r in got] == sorted(values)
    assert all([r.slot for r in got if r.shard == s] == list(range(sum(r.shard == s for r in got))) for s in range(4))
