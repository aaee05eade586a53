"""Archives written and read back."""

import base64
import gzip
import hashlib
import io

import pytest
from pyarrow import fs

from loanloom.llm import warc

ROWS = [(3, "http://a", "<p>x</p>"), (1, "http://b", "<p>x</p>"), (2, None, "é" * 100_000), (4, "http://c\r\nX: y", None), (5, "u", ""), (None, "v", "<p>x</p>"),
        (6, "w", "WARC/1.1\r\n\r\n\r\n"), (2, None, "é" * 100_000), (None, None, "only null ids")]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(i, u, h, "x") for i, u, h in ROWS], "page_id long, url string, html string, payload_key string")


def expected(rows):
    first = {}
    for i, _, h in rows:
        p = (h or "").encode()
        if i is not None:
            first[p] = min(first.get(p, i), i)
    out = []
    for i, _, h in rows:
        p = (h or "").encode()
        f = first.get(p)
        again = f is not None and i != f
        out.append((i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "revisit" if again else "response", f if again else None, True))
    return sorted(out, key=str)


def test_round_trip(spark, pages):
    got = [tuple(r) for r in warc.archived_pages(pages).collect()]
    assert sorted(got, key=str) == expected(ROWS)
    assert warc.archived_pages(pages.limit(0)).count() == 0


def test_small_payloads_can_stay_responses(pages):
    rows = warc.read_archives(warc.write_archives(pages, min_bytes=9)).collect()
    assert {r.record_type for r in rows if r.payload_bytes < 9} == {"response"}
    assert sum(r.record_type == "revisit" for r in rows) == 0
    rows = warc.read_archives(warc.write_archives(pages, min_bytes=8, rotate=1)).collect()
    assert sum(r.record_type == "revisit" for r in rows) == 2


def test_members_and_damage(spark, pages):
    path = warc.write_archives(pages.coalesce(1)).first().path
    store, at = fs.FileSystem.from_uri(path)
    data = store.open_input_stream(at, compression=None).read()
    plain = gzip.decompress(data)
    assert plain.count(b"WARC-Type:") == data.count(b"\x1f\x8b\x08")
    one = warc.record_bytes(1, "u", b"payload", None)
    fields, block = next(warc.read_records(io.BytesIO(one)))
    assert warc._parsed(fields, block)["digest_ok"] and not warc._parsed(fields, block.replace(b"payload", b"pay1oad"))["digest_ok"]
    with pytest.raises(EOFError):
        list(warc.read_records(io.BytesIO(one[:-20])))
    with pytest.raises(ValueError):
        list(warc.read_records(io.BytesIO(gzip.compress(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nabc\r\n\r\n"))))
    with pytest.raises(ValueError):
        list(warc.read_records(io.BytesIO(gzip.compress(b"HTTP/1.1 200\r\n\r\n"))))
