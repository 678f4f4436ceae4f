"""A training corpus from documents: reject poor text, drop exact and near copies, drop benchmark passages, encode.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept; run() writes each result as
Parquet into the folder that all executors share, and the next stage reads it from there. A stage's files are removed once the
next stage's are whole, and all of them if a stage fails; those of the last stay, since the result reads them. All but the last return the columns of documents.

Odd input: each stage has the operator's own defined cases (null and empty texts are rejected by quality(), rows with a null doc_id or repeated rows go through, an empty
table gives an empty result, further columns stay until encode()).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from quillspark.llm import op2_decontamination, op4_bpe, op5_quality, op6_exact_dedup, op10_jaccard_join
from quillspark.llm.common import remove, shared_dir, table
from quillspark.llm.queries import vocabulary_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject."""
    return op5_quality.keep_good(docs, table(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id."""
    return op6_exact_dedup.dedup(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return op10_jaccard_join.near_dedup(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark window stands."""
    return op2_decontamination.filter_clean(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The number of tokens of each document, and the hashes of its ids and of the text that they decode to."""
    return op4_bpe.roundtrip(docs, vocabulary_path())


STAGES = [("quality", quality), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("encode", encode)]

#: The model, the search and the transducer have no SQL; tests/llm compares run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents table."""
    docs, at, before = table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/corpus-{uuid.uuid4().hex}", None
    try:
        for i, (name, stage) in enumerate(STAGES):
            path = f"{at}/{i}-{name}"
            stage(spark, docs, sf_dir).write.parquet(path)
            docs = spark.read.parquet(path)
            if before:
                remove(spark, before)
            before = path
    except BaseException:
        remove(spark, at)
        raise
    return docs
