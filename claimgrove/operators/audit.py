"""Append-only records: chains, revisions, request windows, retention."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from claimgrove.functions.arrays import first_reason
from claimgrove.functions.canonical import canonical_hash
from claimgrove.operators.ordered import neighbours

STREAM = ("tenant_id", "run_id")
EVENT_FIELDS = (
    "tenant_id",
    "run_id",
    "event_id",
    "sequence",
    "actor_sub",
    "action",
    "target_id",
    "before_hash",
    "after_hash",
    "revision",
    "previous_event_hash",
    "timestamp",
    "reason",
)
SEQUENCE_BUCKET = 10_000


def event_hash(fields: Sequence[str] = EVENT_FIELDS) -> Column:
    return canonical_hash(**{f: F.col(f) for f in fields})


def verify_chain(
    events: DataFrame,
    heads: DataFrame | None = None,
    stream: Sequence[str] = STREAM,
    fields: Sequence[str] = EVENT_FIELDS,
    computed: Column | None = None,
) -> DataFrame:
    """Events with the first broken rule: sequence, link, hash (null = intact).

    The sequence itself buckets the stream, so one very long chain is checked in
    parallel and only bucket edges travel along it. With `heads`, see
    `chain_heads` for streams that do not reach their head.
    """
    rows = neighbours(
        events,
        stream,
        ["sequence"],
        previous={"__seq": F.col("sequence"), "__hash": F.col("event_hash")},
        bucket=F.floor(F.col("sequence") / SEQUENCE_BUCKET),
    )
    expected = event_hash(fields) if computed is None else computed
    reason = first_reason(
        (F.coalesce("__seq", F.lit(0)) + 1 != F.col("sequence"), "sequence_invalid"),
        (
            ~F.col("previous_event_hash").eqNullSafe(F.col("__hash")),
            "previous_hash_invalid",
        ),
        (~F.col("event_hash").eqNullSafe(expected), "event_hash_invalid"),
    )
    out = rows.withColumn("broken", reason).drop("__seq", "__hash")
    return out if heads is None else out.join(
        chain_heads(events, heads, stream), list(stream), "left"
    )


def chain_heads(
    events: DataFrame, heads: DataFrame, stream: Sequence[str] = STREAM
) -> DataFrame:
    """Per stream: does the last event reach the expected head?"""
    last = events.groupBy(*stream).agg(
        F.max("sequence").alias("__n"), F.max_by("event_hash", "sequence").alias("__h")
    )
    return heads.join(last, list(stream), "left").select(
        *stream,
        (
            F.coalesce(F.col("__n"), F.lit(0)).eqNullSafe(F.col("head_sequence"))
            & F.col("__h").eqNullSafe(F.col("head_hash"))
        ).alias("head_reached"),
    )


def continuity(
    df: DataFrame, key: Sequence[str], seq: str, bucket: Column | None = None
) -> DataFrame:
    """Rows with `gap`: the sequence does not start at 1 or skips/repeats a number."""
    bucket = F.floor(F.col(seq) / SEQUENCE_BUCKET) if bucket is None else bucket
    rows = neighbours(df, key, [seq], previous={"__p": F.col(seq)}, bucket=bucket)
    return rows.withColumn("gap", F.col(seq) != F.coalesce("__p", F.lit(0)) + 1).drop("__p")


def sliding_excess(
    events: DataFrame,
    key: Sequence[str],
    time: str,
    seconds: int = 60,
    limit: int = 20,
) -> DataFrame:
    """Events with the count of the last `seconds` (an event exactly that old is out).

    Time is cut into slots of the window's width. A slot needs only itself and
    its predecessor, so events are copied once and the window runs per
    (key, slot): a hot key is spread over all its slots.
    """
    width = int(seconds) * 1_000_000
    micros = F.unix_micros(F.col(time).cast("timestamp"))
    slot = F.floor(micros / width)
    both = events.withColumns({"__t": micros, "__slot0": slot}).withColumn(
        "__slot", F.explode(F.array(slot, slot + 1))
    )
    w = (
        W.partitionBy(*key, "__slot")
        .orderBy("__t")
        .rangeBetween(-(width - 1), W.currentRow)
    )
    counted = both.withColumn("n_recent", F.count("*").over(w))
    return (
        counted.filter(F.col("__slot") == F.col("__slot0"))
        .withColumn("excess", F.col("n_recent") > limit)
        .drop("__t", "__slot", "__slot0")
    )


def exclude_deleted(
    df: DataFrame, tombstones: DataFrame, key: Sequence[str] = ("tenant_id", "document_version_id")
) -> DataFrame:
    """Rows of documents without a tombstone."""
    return df.join(tombstones.select(*key).distinct(), list(key), "left_anti")


def retention(
    documents: DataFrame, policies: DataFrame, now: int, key: Sequence[str] = ("tenant_id", "document_id")
) -> DataFrame:
    """Deletion eligibility: blocked without approval, on legal hold or before the date."""
    joined = documents.join(policies, list(key), "left")
    reason = first_reason(
        (F.col("policy_id").isNull(), "policy_missing"),
        (~F.col("approved"), "policy_not_approved"),
        (F.col("legal_hold"), "legal_hold"),
        (F.col("retain_until") > F.lit(now), "retained"),
    )
    return joined.select(
        *documents.columns, "policy_id", reason.isNull().alias("eligible"), reason.alias("blocked_reason")
    )


def deletion_result(
    targets: DataFrame,
    remaining: DataFrame,
    eligibility: DataFrame,
    errors: DataFrame,
    key: Sequence[str] = ("tenant_id", "document_id"),
) -> DataFrame:
    """Status per document from what is still there, not from acknowledgments."""
    key = list(key)
    wanted = targets.groupBy(*key).agg(F.count("*").alias("n_targets"))
    left = remaining.groupBy(*key).agg(F.count("*").alias("n_remaining"))
    failed = errors.groupBy(*key).agg(F.count("*").alias("n_errors"))
    joined = (
        eligibility.select(*key, "eligible")
        .join(wanted, key, "left")
        .join(left, key, "left")
        .join(failed, key, "left")
        .na.fill(0, ["n_targets", "n_remaining", "n_errors"])
    )
    status = (
        F.when(~F.col("eligible"), F.lit("blocked_retention"))
        .when(F.col("n_errors") > 0, F.lit("failed"))
        .when(F.col("n_remaining") > 0, F.lit("running"))
        .otherwise(F.lit("completed"))
    )
    return joined.withColumn("status", status)
