"""SimHash components against plain fingerprints and all pairs."""

import random
import re

import pytest
import xxhash

from loanloom.llm import queries, simhash
from loanloom.llm.simhash import BITS, ball, bit_counts, layout, links, near_duplicates


def plain(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(words[i:i + 4]) for i in range(len(words) - 3)] if len(words) >= 4 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def classes(codes, within=4):
    """The least code reachable from each, by comparing all pairs."""
    codes, least = sorted(set(codes)), {}
    for start in codes:
        if start in least:
            continue
        reached, todo = {start}, [start]
        while todo:
            x = todo.pop()
            near = [y for y in codes if y not in reached and (x ^ y).bit_count() <= within]
            reached.update(near)
            todo += near
        least.update(dict.fromkeys(reached, start))
    return least


def brute(rows):
    prints = {i: plain(t) for i, (_, t) in enumerate(rows)}
    least = classes(prints.values())
    ids = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            ids.setdefault(least[prints[i]], []).append(key)
    return sorted(((key, f"{prints[i]:016x}", min(ids.get(least[prints[i]], []), default=None)) for i, (key, _) in enumerate(rows)), key=str)


def found(df):
    return sorted(((r["doc_id"], r["fingerprint"], r["component_id"]) for r in df.collect()), key=str)


def test_blocks_count_every_shingle_once():
    text = " ".join(f"word{i * i % 97}\t\r\nÉß" for i in range(500)).encode()
    whole = bit_counts(text)
    assert whole[1] == 997
    for block in (1, 7, 100, 5000):
        part = bit_counts(text, block=block)
        assert part[1] == whole[1] and (part[0] == whole[0]).all()


@pytest.mark.parametrize("codes", [10, 10**5, 10**7, 10**10])
def test_layout_covers(codes):
    cut = layout(codes)
    assert sum(w for _, w, _ in cut) == BITS and sum(r + 1 for _, _, r in cut) == 5
    assert sum(ball(w, r) for _, w, r in cut) < 2100


def test_odd_rows(spark):
    rows = [(5, None), (4, ""), (3, " \t\n"), (9, "One"), (8, "one"), (7, "one two three"), (6, "ONE  two\nthree four"), (6, "one two three four"),
            (None, "one two three four"), (None, "alone with nothing near it at all"), (1, "naïve café ÉCOLE naïve"), (2, "naïve café École naïve"), (0, "x" * 100_000)]
    df = spark.createDataFrame([(k, t, "a", 0, "b") for k, t in rows], "doc_id long, text string, fingerprint string, component_id int, fp string")
    assert found(near_duplicates(df)) == brute(rows)
    assert near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("crowd, codes", [(1000, None), (3, None), (0, 10), (20, 10**10)])
def test_links_connect_what_all_pairs_connect(spark, crowd, codes):
    draw = random.Random(7)
    seen = {0, 1, 0xFFFFFFFFFFFFFFFF, 0x8000000000000000}
    for _ in range(12):
        centre = draw.getrandbits(64)
        for _ in range(25):
            code = centre
            for _ in range(draw.randrange(8)):
                code ^= 1 << draw.randrange(64)
            seen.add(code)
    signed = [c - (1 << 64) * (c >> 63) for c in seen]
    prints = spark.createDataFrame([(c,) for c in signed], "fp long")
    pairs = [(r["x"], r["y"]) for r in links(prints, crowd=crowd, codes=codes).collect()]
    assert all(((x ^ y) & (1 << 64) - 1).bit_count() <= 4 for x, y in pairs)
    least, parent = classes(seen), {c: c for c in signed}

    def top(c):
        while parent[c] != c:
            c = parent[c]
        return c

    for x, y in pairs:
        parent[top(x)] = top(y)
    groups, wanted = {}, {}
    for c, s in zip(seen, signed):
        groups.setdefault(top(s), set()).add(c)
        wanted.setdefault(least[c], set()).add(c)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, wanted.values()))


@pytest.mark.parametrize("crowd", [1000, 1])
def test_probes_are_not_broadcast(spark, crowd):
    """Spark takes exploded rows for as few bytes as the rows they come from."""
    prints = spark.createDataFrame([(1 << i,) for i in range(40)], "fp long")
    plan = links(prints, crowd=crowd)._jdf.queryExecution().executedPlan().toString()
    under = None  # how far a broadcast that the lines below belong to is indented
    generated = 0
    for line in plan.splitlines():
        depth = len(line) - len(line.lstrip(" :+-"))
        under = None if under is not None and depth <= under else under
        if "BroadcastExchange" in line and under is None:
            under = depth
        if "Generate explode" in line:
            generated += 1
            assert under is None, plan
    assert generated and "SortMergeJoin" in plan


def test_query_equals_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    assert found(queries.QUERIES["op11_simhash"](spark, folder)) == brute(rows)
