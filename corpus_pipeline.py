"""From raw documents to packed training sequences: five stages over one corpus.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept. `run`
writes every stage as Parquet to the shared folder and reads it back, so a lost
executor costs the tasks of one stage at most.

All stages: null texts count as empty, null and repeated ids are ordinary rows, an empty table
gives an empty one, other columns travel along under any names (packing returns pieces
instead), very long texts are held whole by one task.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimgrove.llm.common import documents, labels
from claimgrove.llm.exact_dedup import drop_copies
from claimgrove.llm.packing import pack_documents
from claimgrove.llm.simhash import drop_near
from claimgrove.llm.substring import remove_repeats
from claimgrove.llm.toxicity import drop_toxic
from claimgrove.session import prepare, shared_folder


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity score rejects go."""
    return drop_toxic(docs, documents(spark, sf_dir), labels(spark, sf_dir))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (A-Z lower-cased) the row with the largest id stays."""
    return drop_copies(docs)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts whose shingles of five words are similar to 0.8 or more, one stays."""
    return drop_near(docs, width=5)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of 35-word windows that occur more than once go; other texts stay as they are."""
    cut = remove_repeats(docs, window=35, keep_spacing=True)
    n_chars = F.when(cut["n_removed"] > 0, F.length("text")).otherwise(F.col("n_chars"))
    return cut.withColumn("n_chars", n_chars.cast("bigint")).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of every document in sequences of at most 2048 tokens."""
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", toxicity),
    ("exact_dedup", exact_dedup),
    ("simhash_dedup", simhash_dedup),
    ("substring_dedup", substring_dedup),
    ("packing", packing),
]

# A learned screen, SimHash components, window removal and packing are not SQL;
# tests/llm/test_pipeline.py holds the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
