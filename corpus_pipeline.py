"""From raw documents to encoded ones: quality, exact copies, near copies, mixture, encoding.

Each stage works on all that the one before kept; run() writes its rows to the shared checkpoint folder and reads them
again for the next one.

Null and empty texts count as empty and pass through as documents without words, as far as the classifier keeps them; of
those one stays. Null ids are values like others. Rows that repeat an id with other texts are documents of their own, rows
that repeat id and text are one from the exact stage on. Very long texts are read whole everywhere. Other columns of the
table stay as they are up to the last stage, whatever their names. An empty table gives empty stages; without labels the classifier keeps all.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from dynspark.llm import bpe, byte_cnn, exact_dedup, mixing, shingle_dedup
from dynspark.llm.common import shared_dir, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. It learns from the labelled ones among docs."""
    return byte_cnn.keep(docs, byte_cnn.train(docs, table(spark, sf_dir, "labels")))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents whose sets of five-word shingles have a Jaccard similarity of at least 0.8 one stays: candidates by SimHash and its
    covering code (op4's search), and by shingles for pairs whose fingerprints differ in more bits; each is decided by its shingles."""
    return shingle_dedup.drop(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256; a document that the mixture repeats has a row each time."""
    return bpe.digests(docs)


STAGES = [
    ("quality classifier", quality),
    ("exact dedup", exact_copies),
    ("near-dedup", near_copies),
    ("mixing sources", mixture),
    ("BPE encoding", encoding),
]

#: The classifier and the encoding aren't SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{k}")
            docs = spark.read.parquet(f"{folder}/{k}")
    return docs
