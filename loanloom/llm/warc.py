"""WARC archives: a writer of one gzip member per record and a sequential reader.

Archives lie in the shared folder. A task writes files of its own; only the paths
that successful tasks returned, kept as a table, belong to the archive set, so the
files of lost or repeated tasks are never read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..sources.tables import materialized, new_path

CHUNK = 1 << 16
ROTATE_BYTES = 256 << 20
_DATE = "2024-01-01T00:00:00Z"  # fixed, so that repeated tasks write the same bytes
RECORD_SCHEMA = (
    "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, "
    "payload binary, digest_ok boolean"
)


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _urn(page_id) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _page(urn: str | None) -> int | None:
    number = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


def _one_line(value: str) -> str:
    return "".join(c if c.isprintable() else f"%{ord(c):02X}" for c in value)


def record_bytes(page_id, url: str | None, payload: bytes, first) -> bytes:
    """A record as one gzip member; ``first`` is the page whose response this payload repeats.

    A revisit keeps the HTTP header, with the length of the payload it leaves out.
    """
    revisit = first is not None
    http = (
        f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
    ).encode()
    block = http if revisit else http + payload
    lines = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_urn(page_id)}",
        f"WARC-Date: {_DATE}", "Content-Type: application/http; msgtype=response",
        f"WARC-Block-Digest: sha1:{digest(block)}", f"WARC-Payload-Digest: sha1:{digest(payload)}",
    ]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_one_line(url)}")
    if revisit:
        lines += [
            f"WARC-Refers-To: {_urn(first)}",
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
        ]
    lines.append(f"Content-Length: {len(block)}")
    deflate = zlib.compressobj(6, zlib.DEFLATED, 31)
    data = "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    return deflate.compress(data) + deflate.flush()


class _Member:
    """Reads across gzip members with a decompressor per member, a chunk at a time."""

    def __init__(self, source):
        self.source, self.raw, self.plain = source, b"", b""
        self.inflate = zlib.decompressobj(31)

    def _fill(self) -> bool:
        """More plain bytes of this member; False at its end."""
        if self.inflate.eof:
            return False
        if not self.raw:
            self.raw = self.source.read(CHUNK)
            if not self.raw:
                raise EOFError("the archive ends within a record")
        self.plain += self.inflate.decompress(self.raw, CHUNK)
        self.raw = self.inflate.unused_data if self.inflate.eof else self.inflate.unconsumed_tail
        return True

    def next(self) -> bool:
        """Start the next member; False at the end of the file."""
        self.inflate, self.plain = zlib.decompressobj(31), b""
        self.raw = self.raw or self.source.read(CHUNK)
        return bool(self.raw)

    def until(self, mark: bytes) -> bytes:
        while mark not in self.plain:
            if not self._fill():
                raise ValueError("a record's header does not end")
        found, _, self.plain = self.plain.partition(mark)
        return found

    def exactly(self, n: int) -> bytes:
        parts, have = [], 0
        while have < n:
            if not self.plain and not self._fill():
                raise ValueError("a record is shorter than its content length")
            parts.append(self.plain[:n - have])
            self.plain = self.plain[n - have:]
            have += len(parts[-1])
        return b"".join(parts)

    def rest(self) -> bytes:
        while self._fill():
            pass
        return self.plain


def read_records(source):
    """The records of an archive in order: (header fields, block)."""
    member = _Member(source)
    while member.next():
        version, *lines = member.until(b"\r\n\r\n").decode().split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError(f"not a WARC record: {version[:40]!r}")
        fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
        block = member.exactly(int(fields["content-length"]))
        if member.rest() != b"\r\n\r\n":
            raise ValueError("a record does not end after its content length")
        yield fields, block


def _parsed(fields: dict, block: bytes) -> dict:
    """A row of RECORD_SCHEMA; ``digest_ok`` says whether the block, and a response's payload, have their digests."""
    head, _, payload = block.partition(b"\r\n\r\n")
    http = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode().split("\r\n")[1:])}
    revisit = fields["warc-type"] == "revisit"
    named = fields["warc-payload-digest"].removeprefix("sha1:")
    sound = fields["warc-block-digest"] == f"sha1:{digest(block)}"
    size = int(http["content-length"])
    if not revisit:
        sound = sound and named == digest(payload) and size == len(payload)
    return {
        "page_id": _page(fields["warc-record-id"]), "url": fields.get("warc-target-uri"),
        "record_type": fields["warc-type"], "payload_bytes": size, "payload_digest": named,
        "refers_to": _page(fields.get("warc-refers-to")), "payload": None if revisit else payload, "digest_ok": sound,
    }


def write_archives(pages: DataFrame, min_bytes: int = 0, folder: str | None = None, rotate: int = ROTATE_BYTES) -> DataFrame:
    """Write a record per row of ``pages`` (page_id, url, html); returns the table of archives (path, records).

    The payload is ``html`` in UTF-8, null as empty. Of rows with equal payloads of at
    least ``min_bytes`` those with the smallest page_id are responses and the others
    revisit it; a null page_id counts as larger than any, and where all are null each
    is a response. Repeated rows give repeated records. Other columns are left out.

    The smallest page of each payload is an aggregate with partial results, so a payload
    that a third of the pages share costs one row per task; pages then meet it in a join
    whose large side Spark may split. Rows move once.
    """
    from pyarrow import fs

    folder = folder or new_path(pages.sparkSession, "warc")
    keyed = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"),
    ).withColumn("payload_key", F.sha1(F.col("html").cast("binary")))
    first = keyed.groupBy("payload_key").agg(F.min("page_id").alias("first")).withColumnRenamed("payload_key", "first_key")
    repeats = (F.octet_length("html") >= min_bytes) & F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    records = keyed.join(first, F.col("payload_key") == F.col("first_key"), "left").select(
        "page_id", "url", "html", F.when(repeats, F.col("first")).alias("first"))

    def run(batches):
        store, at = fs.FileSystem.from_uri(folder)
        store.create_dir(at, recursive=True)
        name, out, count = "", None, 0
        for batch in batches:
            columns = [batch.column(i) for i in range(4)]
            for i in range(batch.num_rows):
                if out is None:
                    name, count = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = store.open_output_stream(f"{at}/{name}", compression=None)
                page_id, url, html, first_page = (c[i].as_py() for c in columns)
                out.write(record_bytes(page_id, url, html.encode(), first_page))
                count += 1
                if out.tell() >= rotate:
                    out.close()
                    out = None
                    yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "records": [count]})
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "records": [count]})

    written = records.mapInArrow(run, "path string, records long")
    return materialized(written, "warc-archives")


def read_archives(archives: DataFrame) -> DataFrame:
    """The records of the archives in a column ``path``, a row each (RECORD_SCHEMA).

    Each archive is read from its start to its end by one task, a chunk at a time;
    the archives are dealt out to tasks. A record that is cut off, framed wrongly or
    no WARC record raises; a wrong digest is reported in ``digest_ok``.
    """
    from pyarrow import fs

    spark = archives.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    schema = pa.schema([
        ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()),
        ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary()), ("digest_ok", pa.bool_()),
    ])

    def run(batches):
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                store, at = fs.FileSystem.from_uri(uri)
                rows, size = [], 0
                with store.open_input_stream(at, compression=None) as source:
                    for fields, block in read_records(source):
                        rows.append(_parsed(fields, block))
                        size += len(block) + 500
                        if size >= 4 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    return archives.select("path").repartition(parts, "path").mapInArrow(run, RECORD_SCHEMA)


def archived_pages(pages: DataFrame) -> DataFrame:
    """Pages written as archives and read back: what each record says of its payload."""
    return read_archives(write_archives(pages)).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "digest_ok")


def archive_set(spark: SparkSession, paths: list[str]) -> DataFrame:
    """A table of archives for :func:`read_archives` from given paths."""
    return spark.createDataFrame([(p,) for p in paths], "path string")
