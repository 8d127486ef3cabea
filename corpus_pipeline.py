"""From raw documents to packed training sequences, in four stages.

Each stage takes ``(spark, docs, sf_dir)``, works on every row that the stage before kept, and returns a DataFrame that
is written as Parquet and read again as the next one's ``docs``. All but the last return the columns of ``docs``.
"""

from __future__ import annotations

from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casemill.llm import packing, quality, simhash, subword
from casemill.sources.session import written

#: Documents whose score for label 1 is below this are rejected.
THRESHOLD = 0.3
FOLDS = 5
#: Most rows and bytes that go to a Python worker at once: the JVM and the worker each hold such a batch of whole texts,
#: in every task, beside what they keep anyway.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": 500, "spark.sql.execution.arrow.maxBytesPerBatch": 4 << 20}


def small_batches(stage):
    """The stage with ``BATCH``, which stays set in the session, as a stage's result is written after it returned."""
    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        for name, most in BATCH.items():
            spark.conf.set(name, str(most))
        return stage(spark, docs, sf_dir)
    return run


@small_batches
def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts. It learns from labelled rows outside the held-out fold."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = subword.train(docs, labels, F.crc32(F.col("doc_id").cast("string")) % FOLDS != 0)
    return docs.filter(subword.scorer(model)("text") >= THRESHOLD)


@small_batches
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule of the policy rejects."""
    return docs.filter(quality.passes(quality.entry(F.col("text"))["failed"], quality.V1))


@small_batches
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id."""
    return simhash.deduplicated(docs)


@small_batches
def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the remaining documents, in sequences of 2048 tokens."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("packed_sequences", packed_sequences),
]

#: Training, components and tokenisation are beyond SQL; the pipeline is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir))
    return docs
