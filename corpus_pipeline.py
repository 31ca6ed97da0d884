"""A cleaning pipeline over documents: each stage reads what the one before it wrote.

language_id drops documents whose language cannot be told; near_dedup keeps one document of each group of near copies (exact copies
included), the one of the least id; decontaminate drops documents that hold a benchmark item; pii replaces personal data by its
kind; encode gives the piece ids. Rows with a null text have no language and go in the first stage. An empty table passes through
every stage. Extra columns of documents stay up to the last stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retort.llm import decontaminate, language_id, near_copies, pii, sentencepiece_lattice
from retort.llm.common import shared_folder, table


def stage_language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.keep_identified(docs, language_id.fit(language_id.known_documents(docs)))


def stage_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays; texts link where their five-word shingles have a Jaccard similarity of 0.8 or more."""
    return near_copies.keep_representatives(docs)


def stage_decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def stage_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact_documents(docs)


def stage_encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sentencepiece_lattice.encode_documents(docs, keep=tuple(c for c in ("lang", "source") if c in docs.columns))


STAGES = [("language_id", stage_language_id), ("near_dedup", stage_near_dedup), ("decontaminate", stage_decontaminate), ("pii", stage_pii), ("encode", stage_encode)]
ORACLE_SQL = None


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; each result is written to the shared folder and read again, and goes once the next is written."""
    docs, folder, before = table(spark, sf_dir, "documents"), f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}", None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        if before:
            _delete(spark, before)
        before = f"{folder}/{name}"
        docs = spark.read.parquet(before)
    return docs
