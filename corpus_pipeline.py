"""The training-data pipeline: five stages over documents, each written as Parquet and read again.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame, the
next stage's docs. All but the last return the columns of documents, texts as the stage left them and
n_chars brought up to date; the last returns the token ids of each text.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm import bpe, decontaminate, line_dedup, quality_classifier, simhash
from quillstone.llm.common import checkpoint_folder, remove, table
from quillstone.llm.queries import vocabulary


def measured(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    net = quality_classifier.train(docs, table(spark, sf_dir, "labels"))
    return quality_classifier.keep_good(docs, net)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines similar to an earlier line go, and documents that lose all their lines."""
    return measured(line_dedup.clean(docs))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return simhash.keep_one(docs)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark windows are cut from texts; a document that is nothing else goes."""
    return measured(decontaminate.clean(docs, table(spark, sf_dir, "benchmark")))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit integers), ids_sha256, decoded_sha256."""
    return bpe.encode(docs, vocabulary())


STAGES = [("quality_classifier", keep_good), ("line_dedup", drop_lines), ("simhash_near_dedup", one_of_each), ("decontamination", remove_benchmark), ("bpe", tokens)]

#: Scores of a fitted network and byte-pair merges are beyond SQL; tests/llm holds each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; their tables lie in the shared checkpoint folder, of which the last stays."""
    docs, last = table(spark, sf_dir, "documents"), None
    folder = f"{checkpoint_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        at = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(at)
        docs = spark.read.parquet(at)
        if last:
            remove(spark, last)
        last = at
    return docs
