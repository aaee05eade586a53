"""Secrets in texts: one keyword automaton over the text, anchored expressions only at its hits.

Kinds, in order: ``assign`` (a credential assigned to a telling name), ``access``
(cloud access key ids), ``hex`` (long hexadecimal runs), and two kinds whose last
six characters are a CRC-32 of the characters before them and are kept only where
that checksum holds: ``git`` (``ghp_`` and its siblings) and ``npm``.

Leftmost non-overlapping matches are found per kind: a match that fails its length
still uses up its characters, as with a scan by the whole expression.
"""

from __future__ import annotations

import re
import zlib
from itertools import product

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .batches import slices

KINDS = ("assign", "access", "hex", "git", "npm")
BASE_KINDS = KINDS[:3]
_ASSIGN = re.compile(r"""(?ai)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]+")
_GIT = re.compile(r"gh[oprsu]_([A-Za-z0-9]+)")
_NPM = re.compile(r"npm_([A-Za-z0-9]+)")
_HEX_GRAM = 4
_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_ASCII_LOWER = {c: c + 32 for c in range(65, 91)}


def checksum(body: str) -> str:
    """CRC-32 of a token's body in six base-62 digits."""
    value, out = zlib.crc32(body.encode()), ""
    for _ in range(6):
        value, digit = divmod(value, 62)
        out = _DIGITS[digit] + out
    return out


def _checked(match: re.Match) -> bool:
    body = match.group(1)
    return len(body) == 36 and checksum(body[:30]) == body[30:]


RULES = {
    "assign": (_ASSIGN, lambda m: len(m.group(1)) >= 6),
    "access": (_ACCESS, lambda m: m.end() - m.start() >= 20),
    "hex": (_HEX, lambda m: m.end() - m.start() >= 24),
    "git": (_GIT, _checked),
    "npm": (_NPM, _checked),
}


def automaton():
    """Keywords of every kind, in lower case; hexadecimal runs start with some four-digit word."""
    import ahocorasick

    words = {w: "assign" for w in ("password", "passwd", "secret", "token", "apikey", "api_key")}
    words |= {"akia": "access", "npm_": "npm"} | {f"gh{c}_": "git" for c in "oprsu"}
    words |= {"".join(g): "hex" for g in product("0123456789abcdef", repeat=_HEX_GRAM)}
    found = ahocorasick.Automaton()
    for word, kind in words.items():
        found.add_word(word, (kind, len(word)))
    found.make_automaton()
    return found


def scan(text: str, words) -> list[tuple[int, int, str]]:
    """(start, end, kind) of every secret, by start and then kind.

    A match of a kind can start only at one of its keywords, so trying its
    expression at the hits that lie behind its last match finds what a scan finds.
    """
    low = text.lower()
    if len(low) != len(text):  # a letter whose lower case is longer
        low = text.translate(_ASCII_LOWER)
    last, out = dict.fromkeys(KINDS, 0), []
    for end, (kind, length) in words.iter(low):
        start = end - length + 1
        if start < last[kind]:
            continue
        rule, keep = RULES[kind]
        match = rule.match(text, start)
        if match:
            last[kind] = match.end()
            if keep(match):
                out.append((start, match.end(), kind))
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def secret_spans(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``secret_spans``, an array of (start, end, kind), to the rows of ``df``.

    Null and empty texts have no spans. Positions are code points, end exclusive.
    Columns of ``df`` are kept; one named ``secret_spans`` is replaced. A narrow
    step: no shuffle, memory bounded by a megabyte of text or one long text.
    """
    kept = [c for c in df.columns if c != "secret_spans"]
    at = kept.index(text)
    spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))

    def run(batches):
        words = automaton()
        for batch in slices(batches, at):
            found = [
                [{"start": s, "end": e, "kind": k} for s, e, k in scan(t, words)] if t else []
                for t in batch.column(at).to_pylist()
            ]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(found, spans)], names=[*batch.schema.names, "secret_spans"]
            )

    schema = df.select(*[F.col(f"`{c}`") for c in kept]).withColumn(
        "secret_spans", F.lit(None).cast("array<struct<start:bigint,end:bigint,kind:string>>")
    ).schema
    return df.select(*[F.col(f"`{c}`") for c in kept]).mapInArrow(run, schema)


def redact(df: DataFrame, text: str = "text", mark: str = "[secret]") -> DataFrame:
    """The rows of ``df`` with every run of overlapping secrets in ``text`` replaced by ``mark``."""
    names = df.columns
    at = names.index(text)

    def run(batches):
        words = automaton()
        for batch in slices(batches, at):
            out = []
            for value in batch.column(at).to_pylist():
                spans = scan(value, words) if value else []
                if spans:
                    parts, done = [], 0
                    for start, end, _ in spans:
                        if start >= done:
                            parts += [value[done:start], mark]
                        done = max(done, end)
                    value = "".join(parts) + value[done:]
                out.append(value)
            columns = list(batch.columns)
            columns[at] = pa.array(out, batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return df.mapInArrow(run, df.schema)


def secret_report(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts, span digests and span lists per row, from :func:`secret_spans`."""
    found = secret_spans(df.select(F.col(f"`{key}`").alias("doc_id"), F.col(f"`{text}`").alias("text")))

    def count(kind: str):
        return F.size(F.filter("secret_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    def listed(spans):
        return F.array_join(F.transform(
            spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
        ), ",")

    base = F.filter("secret_spans", lambda s: s["kind"].isin(*BASE_KINDS))
    return found.select(
        "doc_id", *[count(k) for k in BASE_KINDS], F.sha2(listed(base), 256).alias("base_sha256"),
        listed(F.col("secret_spans")).alias("spans"), count("git"), count("npm"),
    )
