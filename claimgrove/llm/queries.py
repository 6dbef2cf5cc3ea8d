"""One registered query per operator, over the whole documents table."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimgrove.llm.bpe import bpe_round_trip
from claimgrove.llm.common import conversations, documents, embeddings, labels
from claimgrove.llm.exact_dedup import exact_groups
from claimgrove.llm.licenses import licenses_sql, scan_licenses
from claimgrove.llm.packing import pack_documents
from claimgrove.llm.prefix_trie import prefix_trie, trie_sql
from claimgrove.llm.quality_classifier import quality_scores
from claimgrove.llm.quality_rules import apply_rules, rules_sql
from claimgrove.llm.registry import QUERIES, SQL, query
from claimgrove.llm.sharding import balanced_shards
from claimgrove.llm.simhash import near_groups
from claimgrove.llm.substring import remove_repeats
from claimgrove.llm.token_files import read_documents, write_sequences
from claimgrove.llm.toxicity import toxicity_scores
from claimgrove.llm.whitening import whiten
from claimgrove.session import shared_folder

__all__ = ["QUERIES", "SQL"]


@query("op1_toxicity")
def op1_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Toxicity score of every whole text."""
    return toxicity_scores(documents(spark, folder), labels(spark, folder))


@query("op2_licenses", licenses_sql())
def op2_licenses(spark: SparkSession, folder: str) -> DataFrame:
    """Licence of every whole text and of every whole line."""
    return scan_licenses(documents(spark, folder))


@query(
    "op3_exact_dedup",
    """
    WITH hashed AS (
      SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                      'abcdefghijklmnopqrstuvwxyz')) AS h
      FROM documents)
    SELECT doc_id,
           max(doc_id) OVER (PARTITION BY h) AS keep_id,
           count(*) OVER (PARTITION BY h) AS group_size,
           doc_id = max(doc_id) OVER (PARTITION BY h) AS kept,
           h AS text_sha256
    FROM hashed
    """,
)
def op3_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Groups of equal texts and the row of each that stays."""
    return exact_groups(documents(spark, folder))


@query("op4_bpe")
def op4_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """Every whole text encoded by the rank file and decoded again."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe_round_trip(documents(spark, folder), path, public_tokenizers.PATTERN)


@query(
    "op5_substring_dedup",
    r"""
    WITH base AS (
      SELECT doc_id, row_number() OVER () AS r,
             regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
      FROM documents),
    windows AS (
      SELECT r, i, sha256(array_to_string(w[i:i + 34], ' ')) AS g
      FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM base WHERE len(w) >= 35)),
    repeated AS (SELECT r, i FROM windows QUALIFY count(*) OVER (PARTITION BY g) > 1),
    gone AS (SELECT DISTINCT r, i + d AS p FROM repeated, (SELECT unnest(range(0, 35)) AS d)),
    placed AS (SELECT r, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM base),
    kept AS (
      SELECT r, string_agg(word, ' ' ORDER BY p) AS text, count(*) AS n
      FROM placed ANTI JOIN gone USING (r, p) GROUP BY r)
    SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed,
           sha256(coalesce(kept.text, '')) AS kept_sha256
    FROM base LEFT JOIN kept USING (r)
    """,
)
def op5_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Texts without the words of 35-word windows that occur more than once."""
    docs = documents(spark, folder).select("doc_id", "text")
    return remove_repeats(docs, window=35, keep_spacing=False).select(
        "doc_id",
        "n_words",
        "n_removed",
        F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"),
    )


@query("op6_packing")
def op6_packing(spark: SparkSession, folder: str) -> DataFrame:
    """All documents in sequences of at most 2048 tokens."""
    return pack_documents(documents(spark, folder), public_tokenizers.path("word_bpe_49k.json"))


@query("op7_quality_rules", rules_sql())
def op7_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Statistics of every text and the verdict of certified rules."""
    return apply_rules(documents(spark, folder), labels(spark, folder)).select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
    )


@query("op8_quality_classifier")
def op8_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    """Quality score of every text by a sparse ensemble of rules."""
    return quality_scores(documents(spark, folder), labels(spark, folder), threshold=0.3)


@query("op9_simhash")
def op9_simhash(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprints over three words, linked at three bits or fewer."""
    return near_groups(documents(spark, folder), width=3, bits=3)


@query("op10_sharding")
def op10_sharding(spark: SparkSession, folder: str) -> DataFrame:
    """All documents in 8 shards of nearly equal bytes, equal texts together."""
    return balanced_shards(documents(spark, folder)).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query("op11_prefix_trie", trie_sql())
def op11_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    """The trie of all conversations, rebuilt on their templates."""
    return prefix_trie(conversations(spark, folder))


@query("op12_whitening")
def op12_whitening(spark: SparkSession, folder: str) -> DataFrame:
    """Every embedding on the four leading components, whitened."""
    return whiten(embeddings(spark, folder), components=4)


@query("op13_token_files")
def op13_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """All documents as token ids in files of equal-length sequences, read back per document."""
    target = f"{shared_folder(spark)}/sequences-{uuid.uuid4().hex}"
    write_sequences(documents(spark, folder), target, public_tokenizers.path("word_bpe_49k.json"))
    return read_documents(spark, target).select(
        "doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32")
    )
