"""A corpus pipeline of five stages over ``documents``, each the operator of its name at production parameters.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next stage's docs.  All but the last return the columns of documents.  Each stage works
on all that its predecessor kept: what a stage drops is gone.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.llm import bpe, decontaminate, near_dedup, quality_classifier, quality_rules
from tidewright.llm.frames import checkpoint_dir, table


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps."""
    return quality_classifier.judge(docs, table(spark, sf_dir, "labels"), carry=True)


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the risk-controlled quality rules keep."""
    return quality_rules.keep(docs, table(spark, sf_dir, "labels"))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of texts linked by a similarity of 0.8 or more; repeated rows are one."""
    return near_dedup.keep_one(docs, percent=80, bands=40)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found."""
    return decontaminate.clean(docs, decontaminate.questions(table(spark, sf_dir, "benchmark")))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, token_ids and whether decoding gives the text's bytes back."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    decoded = bpe.encode(docs, vocabulary=path, pattern=public_tokenizers.PATTERN, from_files=True, decoded=True)
    n_tokens = F.size("token_ids").cast("long").alias("n_tokens")
    return decoded.select("doc_id", n_tokens, "token_ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality classifier", classify),
    ("quality rules", rules),
    ("near-duplicates", deduplicate),
    ("decontamination", decontaminated),
    ("byte-level BPE", encode),
]

#: SQL has no way to say these stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared checkpoint folder and read again."""
    docs, folder = table(spark, sf_dir, "documents"), f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
