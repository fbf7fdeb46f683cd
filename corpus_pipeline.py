"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame, which is written and read again as
the next one's docs. All but the last give the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stripewise.llm.common import delete_at_end, shared_dir, table
from stripewise.llm.exact_dedup import drop_copies
from stripewise.llm.minhash import drop_near_copies
from stripewise.llm.mixing import mix_sources, mixed_documents
from stripewise.llm.packing import pack
from stripewise.llm.quality_crf import THRESHOLD, score_quality, train
from stripewise.llm.queries import vocabulary


SCORE = "__quality"  # beside any column of documents


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose score reaches the classifier's threshold, fitted on the labels beside them. Where
    the labels do not hold both values nothing can be fitted, and all rows stay."""
    field = train(docs, table(spark, sf_dir, "labels"))
    if field is None:
        return docs
    return score_quality(docs, field, score_col=SCORE).where(F.col(SCORE) >= THRESHOLD).select(*docs.columns)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts."""
    return drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of texts alike in four fifths of their five-word shingles."""
    return drop_near_copies(docs, width=5, percent=80)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix takes of each text, once for each time that it takes them."""
    return mixed_documents(mix_sources(docs)).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 1024 tokens: doc_id, start, length, ids (bytes), doc_tokens,
    sequence_id, offset."""
    return pack(docs, vocabulary())


STAGES = [("quality", quality), ("exact_dedup", exact), ("near_dedup", near), ("mixing", mix), ("packing", packed)]

#: SQL has no conditional random field; the tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the cluster's shared folder and read again; the
    stages are deleted when the driver's JVM ends."""
    base = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    delete_at_end(spark, base)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.option("compression", "zstd").parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
