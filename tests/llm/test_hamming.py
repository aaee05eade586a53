"""Multi-index hashing against all distances."""

import random

import pytest

from loanloom.llm import hamming


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def brute(codes, queries, k):
    out = []
    for q, a in sorted(set(queries)):
        near = sorted({((a ^ b).bit_count(), i) for i, b in codes if i != q})
        out += [(q, i, d, n + 1) for n, (d, i) in enumerate(near[:k])]
    return sorted(out)


def frame(spark, codes):
    return spark.createDataFrame([(i, signed(c >> 64), signed(c & (1 << 64) - 1)) for i, c in codes], "id long, hi long, lo long")


@pytest.mark.parametrize("n,k", [(1, 3), (4, 3), (300, 5)])
def test_equals_all_distances(spark, n, k):
    rnd = random.Random(n)
    centres = [rnd.getrandbits(128) for _ in range(5)]
    codes = [(0, centres[0])] + [(i, rnd.choice(centres) ^ sum(1 << rnd.randrange(128) for _ in range(rnd.randrange(12)))) for i in range(1, n)]
    codes += [(1000 + i, centres[1]) for i in range(n // 3)] + codes[:2]
    codes += [(5000, rnd.getrandbits(128))]
    queries = [c for c in codes if c[0] % 50 == 0]
    got = hamming.nearest(frame(spark, codes), frame(spark, queries), k).collect()
    assert sorted(tuple(r) for r in got) == brute(codes, queries, k)


def test_codes_and_odd_rows(spark):
    rows = [(1, [1.0, 2.0, -1.0], "x"), (2, [1.0, 2.0, -1.0], "x"), (3, [-1.0, -2.0, 1.0], None), (4, None, "x"), (5, [], "x"),
            (None, [1.0, 1.0, 1.0], "x"), (6, [float("nan"), None, 0.0], "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, hi string")
    codes = {r.id: (r.hi, r.lo) for r in hamming.binary_codes(df, "vec_id", "embedding").collect()}
    assert set(codes) == {1, 2, 3, 6} and codes[1] == codes[2] and codes[6] == (0, 0)
    assert all(~a == b for a, b in zip(codes[1], codes[3]))
    empty = hamming.binary_codes(df.limit(0), "vec_id", "embedding")
    assert hamming.nearest(empty, empty, 3).count() == 0


def test_flips_are_all_ways(spark):
    from itertools import combinations

    for width, radius in ((5, 0), (5, 1), (5, 3), (5, 5), (2, 3), (32, 2), (64, 1)):
        rows = hamming._flipped(spark.createDataFrame([(9, width, 5)], "id int, width int, value long"), radius).collect()
        ways = {(5 ^ sum(1 << b for b in bits)) - (1 << 64) * (63 in bits) for bits in combinations(range(width), radius)}
        assert len(rows) == len(ways) and {r["value"] for r in rows} == ways
