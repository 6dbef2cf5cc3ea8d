"""Exact deduplication with a heavy-hitter split.

A frequent-items summary of the Misra-Gries family (Spark's `approx_top_k`:
bounded counters per task, merged by decrement) names the digests that may be
frequent. Their exact counts and winners are then verified by a partial
aggregation, broadcast (their number is bounded by `HEAVY`) and applied map-side,
so no copy of a hot text is shuffled. All other digests hold less than
1/`HEAVY` of the rows each and take one ordinary shuffle.

Texts are equal when identical after lower-casing A-Z; null counts as empty.
The row with the largest id stays. Defined edge cases: a null id is smaller than
any other; of rows with equal id and equal text exactly one stays; an empty
table gives an empty result; other columns are ignored, whatever their names. Very long texts
are hashed whole where they are read; only their digests move.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimgrove.llm.common import lower_ascii, stored, text_or_empty
from claimgrove.session import small_side

# A digest is heavy when it holds at least this share of the rows, so there are
# at most HEAVY of them; the summary tracks more counters than that.
HEAVY = 1024
COUNTERS = 8192


def text_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One narrow row per document: id, SHA-256 of the normalised text, row number."""
    text = lower_ascii(text_or_empty(docs[text_col]))
    return docs.select(
        docs[id_col].alias("doc_id"),
        F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"),
        F.monotonically_increasing_id().alias("row_no"),
    )


def heavy_winners(rows: DataFrame) -> DataFrame:
    """Exact count and winner of every digest with at least 1/HEAVY of the rows."""
    summary = rows.agg(
        F.expr(f"approx_top_k(hex(digest), {HEAVY}, {COUNTERS})").alias("top"),
        F.count("*").alias("n_rows"),
    )
    candidates = summary.select(F.explode("top").alias("top"), "n_rows").select(
        F.unhex("top.item").alias("digest"), "n_rows"
    )
    counted = (
        rows.join(F.broadcast(candidates), "digest")
        .groupBy("digest")
        .agg(
            F.count("*").alias("group_size"),
            F.max("doc_id").alias("keep_id"),
            F.max("n_rows").alias("n_rows"),
        )
        .where((F.col("group_size") > 1) & (F.col("group_size") * HEAVY >= F.col("n_rows")))
        .drop("n_rows")
    )
    counted = stored(counted)
    first = (
        rows.join(F.broadcast(counted.drop("group_size")), "digest")
        .where(F.col("doc_id").eqNullSafe(F.col("keep_id")))
        .groupBy("digest")
        .agg(F.min("row_no").alias("keep_row"))
    )
    return counted.join(F.broadcast(first), "digest")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row per input row."""
    rows = stored(text_digests(docs, id_col, text_col))
    winners = stored(heavy_winners(rows))
    marked = rows.join(F.broadcast(winners), "digest", "left")
    hot = marked.where(F.col("group_size").isNotNull()).withColumn(
        "kept", F.col("row_no") == F.col("keep_row")
    )
    group = Window.partitionBy("digest")
    ranked = group.orderBy(F.col("doc_id").desc_nulls_last(), "row_no")
    rest = (
        marked.where(F.col("group_size").isNull())
        .select("doc_id", "digest", "row_no")
        .withColumn("kept", F.row_number().over(ranked) == 1)
        .withColumn("group_size", F.count("*").over(group))
        .withColumn("keep_id", F.max("doc_id").over(group))
    )
    columns = ("doc_id", "keep_id", "group_size", "kept", "digest")
    return (
        hot.select(*columns)
        .unionByName(rest.select(*columns))
        .withColumn("text_sha256", F.lower(F.hex("digest")))
        .drop("digest")
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` without the rows that `exact_groups` drops; all columns stay, whatever their names.

    The decisions that change anything are joined by id and digest: pairs that go, and pairs of
    several rows, of which one stays. Where they are few they are broadcast and no text moves.
    """
    decided = exact_groups(docs, id_col, text_col).groupBy("doc_id", "text_sha256")
    decided = decided.agg(F.max("kept").alias("stays"), F.count("*").alias("same"))
    decided = decided.where("NOT stays OR same > 1").drop("same")
    keyed = docs.select(
        F.struct(*docs.columns).alias("row"),
        docs[id_col].alias("own_id"),
        F.sha2(lower_ascii(text_or_empty(docs[text_col])).cast("binary"), 256).alias("own_sha"),
    )
    same = F.col("own_id").eqNullSafe(F.col("doc_id")) & (F.col("own_sha") == F.col("text_sha256"))
    marked = keyed.join(small_side(stored(decided)), same, "left")
    once = marked.where("stays IS NULL").select("row")
    again = marked.where("stays").dropDuplicates(["own_id", "own_sha"]).select("row")
    return once.unionByName(again).select("row.*")
