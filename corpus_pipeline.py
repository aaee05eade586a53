"""Documents cleaned stage by stage; each stage is an operator of ``loanloom.llm`` whose decision takes effect.

``run(spark, sf_dir)`` applies STAGES to the documents of a folder. Every stage takes
(spark, docs, sf_dir), works on all rows it is given, is written as Parquet to the shared
folder and read again for the next one. All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from loanloom.llm import chunks, decontaminate, langid, partenum, secrets
from loanloom.llm.batches import BATCH_BYTES, BATCH_LIMIT, bounded  # noqa: F401
from loanloom.sources.tables import materialized, scan_table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def columns_of(docs: DataFrame) -> DataFrame:
    """The columns of documents, which reach Python tasks in batches of limited bytes."""
    return bounded(docs).select(*COLUMNS)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without a letter (null and empty ones too) and those in which no language stands out.

    The model learns from the text and language of the given rows that are not held out.
    None stands out below ``model.least``, which follows the number of learned languages and
    the scores of right predictions for texts not fitted on.
    Without any labelled row nothing can stand out, and only texts without a letter go.
    """
    docs = columns_of(docs)
    model = langid.train(docs.filter(~langid.held_out("doc_id", 4, 2)))
    if not model.languages:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    seen = langid.predict(docs, model)
    return columns_of(seen.filter((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= model.least)))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of similar documents the one with the smallest doc_id."""
    return columns_of(partenum.one_per_component(columns_of(docs)))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a passage of a benchmark item."""
    return decontaminate.without_contaminated(columns_of(docs), scan_table(spark, "benchmark", sf_dir))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts ``[secret]`` in the place of secrets and counts the characters of changed texts anew."""
    docs = columns_of(docs)
    clean = secrets.redact(docs.withColumn("before", F.col("text")))
    changed = ~F.col("before").eqNullSafe(F.col("text"))
    return columns_of(clean.withColumn("n_chars", F.when(changed, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))))


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, ids_sha256, decoded_sha256) of each document; ids are little-endian unsigned 32-bit integers."""
    path = public_tokenizers.path("word_bpe_49k.json")
    coded = chunks.decode_documents(chunks.encode_documents(columns_of(docs), path), path)
    return coded.select(
        "doc_id", F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("bpe", bpe),
]
ORACLE_SQL = None  # model scores and tokenizers are beyond SQL; tests hold the stages against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for all documents of a folder."""
    docs = scan_table(spark, "documents", sf_dir)
    for name, stage in STAGES[:-1]:
        docs = materialized(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
