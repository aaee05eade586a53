"""A query per operator over the whole of its table, with the SQL that checks it where SQL can."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import scan_table
from . import chunks, collocations, decontaminate, divergence, hamming, langid, partenum, secrets, shards, simhash, tokens, toxicity, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


@query("op2_secret_scan")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_report(scan_table(spark, "documents", sf_dir))


_BASE32 = """array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + list_sum(list_transform(range(0, 5), lambda k: CAST(floor((instr('0123456789abcdef',
        substr(h, 1 + CAST(floor((i * 5 + k) / 4.0) AS BIGINT), 1)) - 1) / pow(2, 3 - (i * 5 + k) % 4)) AS BIGINT) % 2
        * CAST(pow(2, 4 - k) AS BIGINT)))::BIGINT, 1)), '')"""


@query("op7_warc", f"""
    WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
      f AS (SELECT h, min(page_id) AS first FROM p GROUP BY h)
    SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes, {_BASE32} AS payload_digest,
      CASE WHEN first <> page_id OR (page_id IS NULL AND first IS NOT NULL) THEN 'revisit' ELSE 'response' END AS record_type,
      CASE WHEN first <> page_id OR (page_id IS NULL AND first IS NOT NULL) THEN first END AS refers_to, true AS digest_ok
    FROM p JOIN f USING (h)""")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived_pages(scan_table(spark, "pages", sf_dir))


@query("op8_histogram_shards")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.sharded_documents(scan_table(spark, "documents", sf_dir))


@query("op5_partenum_join")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partenum.similar_components(scan_table(spark, "documents", sf_dir))


@query("op4_token_orc")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_digests(scan_table(spark, "documents", sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


@query("op10_chunk_bpe")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.round_trip(scan_table(spark, "documents", sf_dir), public_tokenizers.path("word_bpe_49k.json"))


@query("op9_spaced_seeds")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(scan_table(spark, "documents", sf_dir), scan_table(spark, "benchmark", sf_dir))


NEIGHBORS = 10


@query("op6_hamming_topk")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = hamming.binary_codes(scan_table(spark, "embeddings", sf_dir), "vec_id", "embedding")
    return hamming.nearest(codes, codes.filter("id % 50 = 0"), NEIGHBORS).withColumnRenamed("id", "vec_id")


@query("op1_langid")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(scan_table(spark, "documents", sf_dir))


@query("op3_pu_toxicity")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.rate_documents(scan_table(spark, "documents", sf_dir), scan_table(spark, "labels", sf_dir))


@query("op11_simhash")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(scan_table(spark, "documents", sf_dir)).select("doc_id", "fingerprint", "component_id")


_LOWERED = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query("op12_collocations", f"""
    WITH t AS (SELECT coalesce(lang, 'und') AS lang,
        unnest(regexp_split_to_array({_LOWERED.format("coalesce(text, '')")}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
      p AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM t),
      s AS (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM p, (SELECT unnest([1, 2, 3, 4]) AS k)),
      c AS (SELECT lang, k, list_slice(w, i, i + k - 1) AS x, count(*) AS f FROM s GROUP BY ALL),
      q AS (SELECT * FROM c WHERE k > 1 AND f >= 30),
      cuts AS (SELECT *, unnest(range(1, k)) AS j FROM q),
      v AS (SELECT cuts.lang, cuts.k, cuts.x, cuts.f AS a, j, l.f AS l, r.f AS r, ((2000000::HUGEINT * cuts.f) // (l.f + r.f))::BIGINT AS score
        FROM cuts JOIN c l ON l.lang = cuts.lang AND l.x = list_slice(cuts.x, 1, j)
          JOIN c r ON r.lang = cuts.lang AND r.x = list_slice(cuts.x, j + 1, cuts.k)),
      b AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY lang, x ORDER BY score, j) = 1),
      inner_parts AS (SELECT lang, f, x, k, m, unnest(range(1, k - m + 2)) AS i FROM q, (SELECT unnest([2, 3]) AS m) WHERE m < k),
      longest AS (SELECT lang, list_slice(x, i, i + m - 1) AS x, max(f) AS longest FROM inner_parts GROUP BY ALL),
      n AS (SELECT lang, sum(f)::BIGINT AS n FROM c WHERE k = 1 GROUP BY lang)
    SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, array_to_string(b.x, ' ')) AS rank,
      array_to_string(b.x, ' ') AS phrase, a, l, r, n.n, score
    FROM b JOIN n ON n.lang = b.lang LEFT JOIN longest g ON g.lang = b.lang AND g.x = b.x
    WHERE g.longest IS NULL OR 100 * g.longest < 80 * a QUALIFY rank <= 2000""")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(scan_table(spark, "documents", sf_dir))


@query("op13_divergence", f"""
    WITH d AS (SELECT row_number() OVER () AS n, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
        {_LOWERED.format("coalesce(text, '')")} AS text FROM documents),
      o AS (SELECT n, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
      k AS (SELECT lang, term, count(*) AS every FROM o GROUP BY lang, term HAVING count(DISTINCT n) >= 30),
      v AS (SELECT lang, count(*) AS terms, sum(every) AS total FROM k GROUP BY lang),
      c AS (SELECT lang, source, term, count(*) AS n FROM o GROUP BY lang, source, term),
      g AS (SELECT DISTINCT lang, source FROM d),
      f AS (SELECT lang, source, term, every, coalesce(c.n, 0) AS n, sum(coalesce(c.n, 0)) OVER (PARTITION BY lang, source) AS total
        FROM g JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)),
      p AS (SELECT lang, source, term, f.n, 1 + (1000000000 * (f.n + 5)::HUGEINT) // (f.total + 5 * terms) AS p,
        1 + (1000000000 * (every + 5)::HUGEINT) // (v.total + 5 * terms) AS q FROM f JOIN v USING (lang)),
      pairs AS (SELECT a.lang, a.source, b.source AS item,
          coalesce((SELECT sum(abs(x.p - y.p)) FROM p x JOIN p y USING (lang, term)
            WHERE x.lang = a.lang AND x.source = a.source AND y.source = b.source), 0)::BIGINT AS value
        FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source)
    SELECT lang, source, 'pair' AS part, item, value,
      row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INT AS rank FROM pairs
    UNION ALL
    SELECT lang, source, 'term', term, (p - q)::BIGINT,
      row_number() OVER (PARTITION BY lang, source ORDER BY p - q DESC, term)::INT AS rank
    FROM p WHERE n > 0 AND p > q QUALIFY rank <= 50""")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(scan_table(spark, "documents", sf_dir))
