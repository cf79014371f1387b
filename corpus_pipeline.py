"""From raw documents to token ids: clean, drop near copies, redact secrets, mix sources, encode.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; every stage but the last returns the columns of
``docs``.  ``run`` writes each stage to the shared folder and reads it back as the next one's documents, so a lost
executor never costs more than one stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from panelweave.llm import mixing, near_dedup, quality_rules, secret_scan, sentencepiece_codec
from panelweave.llm.near_links import NearSpec
from panelweave.sources.staging import new_path

#: Rows that Spark hands to a Python worker at a time, at most: whole texts, held by the executor and by the worker.
BATCH_ROWS = 1000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batches to ``BATCH_ROWS`` rows; a smaller setting stays."""
    rows = int(spark.conf.get(_BATCH))
    if rows <= 0 or rows > BATCH_ROWS:
        spark.conf.set(_BATCH, str(BATCH_ROWS))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; the others lose their failing lines."""
    small_batches(spark)
    return quality_rules.clean_documents(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, 80 percent) stays: the one with the least id."""
    small_batches(spark)
    return near_dedup.one_of_each(docs, NearSpec(percent=80))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Found secrets are masked in the text."""
    small_batches(spark)
    return secret_scan.redacted(docs, secret_scan.BlobLedger(spark))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target asks for."""
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row, with digests and the number of source bytes that they stand for."""
    small_batches(spark)
    return sentencepiece_codec.encode_documents(docs, sentencepiece_codec.public_model(), ids=True)


STAGES = [("quality rules", quality), ("near copies", near_copies), ("secrets", secrets), ("mix", mix), ("encode", encode)]

#: The encoder is no SQL: tests compare the whole pipeline with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to the table ``documents``, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = new_path(spark, f"pipeline-{name.replace(' ', '-')}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
