"""From raw documents to packed sequences, in stages that are written and read again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from quillstone.llm import decontamination, linededup, nearcopies, packing, quality
from quillstone.llm.common import scratch, shared_dir, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops failing lines, and the documents that are rejected, such as those of null or empty text; see quality.clean for ties, repeats and very long texts."""
    return quality.clean(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the lines of templates that recur across documents, but for the first document's; all documents stay.

    Long passages that few documents share stay: they make up most of a near copy, which the next stage must still know as one.
    """
    return linededup.clean(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies: five-word shingles of Jaccard similarity 0.8 or more, met by SimHash and by bands of minima, each verified. The smallest doc_id stays, null ids last."""
    return nearcopies.deduplicate(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold an item of the benchmark; null texts hold none."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 2048 tokens; null text is the end id alone."""
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("pack", pack),
]

#: Tokenisation, fingerprints and BM25 have no SQL; tests/llm/test_pipeline.py holds run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each but the last is written to the shared folder and read again.

    Nulls in any column, empty and very long texts, repeated rows, an empty table and columns of any other
    name are borne by every stage, each of which says what becomes of them. The stages' tables stay in the folder, as the result reads the last of them.
    """
    docs = table(spark, sf_dir, "documents")
    top = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        with scratch(spark):  # what a stage wrote on its way goes once its result is written
            stage(spark, docs, sf_dir).write.parquet(f"{top}/{name}")
        docs = spark.read.parquet(f"{top}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
