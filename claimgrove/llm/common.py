"""Helpers shared by the operators of this package."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimgrove.session import cut_lineage

# ASCII white space separates words; everything else belongs to one.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def stored(df: DataFrame) -> DataFrame:
    """`df`, written once to the shared checkpoint folder; survives lost executors."""
    return cut_lineage(df)


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def labels(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/labels.parquet")


def conversations(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/conversations.parquet")


def embeddings(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/embeddings.parquet")


def text_or_empty(column: Column | str) -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def lower_ascii(column: Column) -> Column:
    """A-Z only, so that equality does not depend on a locale or on Unicode tables."""
    return F.translate(column, UPPER, LOWER)


def words_of(text: Column) -> Column:
    """Array of words; an empty array for empty text."""
    return F.array_remove(F.split(text, SPACE), "")


def held_out(doc_id: Column | str) -> Column:
    """True for the fifth of the documents that no model may learn from."""
    name = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(name.cast("string").cast("binary")) % 5 == 0, F.lit(False))
