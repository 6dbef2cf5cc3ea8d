"""Structured Streaming operators.

Stateful ones keep one small record per key (a hash and a sequence, or the at
most `limit` admitted times). Chains, admissions and idempotent requests wait until the watermark
has passed them and are then judged in event-time order (`streaming.ordered`), so
results do not depend on which micro-batch brings a row and match the batch
operators. What waits is bounded by the lateness times the rate of a key.
"""

from __future__ import annotations

import time as clock
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimgrove.operators.summary import COUNTERS, coverage_status
from claimgrove.streaming.ordered import AT, in_event_order


# ---------------------------------------------------------------- idempotent ingest


def idempotent_stream(
    df: DataFrame,
    key: Sequence[str],
    body: str,
    time: str = "ts",
    ttl: str = "24 hours",
    lateness: str = "10 minutes",
    also: Sequence[str] = (),
) -> DataFrame:
    """Each request as new, replay (same key and body) or conflict (same key, other body).

    A key expires `ttl` after its first request in event time; requests may come up to `lateness` late.
    `also` names columns that belong to the body (such as the model), compared with it.
    """
    key = list(key)
    seconds = int(pd.Timedelta(ttl).total_seconds())
    parts = F.to_json(F.struct(body, *also), {"ignoreNullFields": "false"})
    rows = df.withColumn("body_hash", F.sha2(parts, 256) if also else F.sha2(body, 256))
    at = len(key) + 1

    def judge(held, ready):
        first, since = held or (None, 0)
        results = []
        for row in ready:
            digest, moment = row[at - 1], row[at]
            if first is None or moment - since >= seconds * 1_000_000:
                first, since, outcome = digest, moment, "new"
            else:
                outcome = "replay" if digest == first else "conflict"
            results.append((*row, outcome))
        return (first, since), results

    return in_event_order(
        rows, key, time, ["body_hash"], [AT, "body_hash"], judge,
        "first string, since long", "outcome string", lateness, ttl,
    )


# ---------------------------------------------------------------- exactly-once effect


def upsert_stream(
    df: DataFrame,
    path: str,
    checkpoint: str,
    key: Sequence[str],
    revision: str,
    trigger: dict | None = None,
):
    """Start a query whose effect is exactly once although delivery is at least once.

    Each micro-batch owns one folder named by its query and epoch and overwrites it, so a
    replayed batch leaves the same files, and a query that starts anew without its
    checkpoint never overwrites those of another; readers fold by key (`read_upserted`). Of equal
    revisions the query that was started last wins, then the larger epoch.
    `trigger` is passed on; by default all available rows are taken and the query ends.
    """
    key, started = list(key), clock.time_ns()

    def write(batch: DataFrame, epoch: int) -> None:
        rest = [c for c in batch.columns if c not in key]
        newest = batch.groupBy(*key).agg(F.max_by(F.struct(*rest), revision).alias("r"))
        query = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        newest.select(*key, "r.*", F.lit(started).alias("started")).write.mode("overwrite").parquet(f"{path}/query={query}/epoch={epoch}")

    return (
        df.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def read_upserted(spark: SparkSession, path: str, key: Sequence[str], revision: str) -> DataFrame:
    """Current row per key over all epochs."""
    rows = spark.read.parquet(path)
    rest = [c for c in rows.columns if c not in key]
    folded = rows.groupBy(*key).agg(
        F.max_by(F.struct(*rest), F.struct(revision, "started", "epoch")).alias("r")
    )
    return folded.select(*key, "r.*").drop("started", "epoch", "query")


# ---------------------------------------------------------------- audit chain


def audit_stream(
    df: DataFrame,
    stream: Sequence[str] = ("tenant_id", "run_id"),
    sequence: str = "sequence",
    previous: str = "previous_event_hash",
    digest: str = "event_hash",
    time: str = "occurred_at",
    lateness: str = "10 minutes",
    idle: str = "30 days",
) -> DataFrame:
    """Append verdict per event: accepted, or the first rule it breaks.

    Events wait for the watermark and are judged by sequence, so a chain that comes in any order within
    `lateness` is accepted whole. Rejected events do not move the head, so a gap rejects everything
    after it. The head of a stream without events for `idle` is forgotten.
    """
    stream = list(stream)
    columns = [sequence, previous, digest]
    n, before, own = (len(stream) + i for i in range(3))

    def append(held, ready):
        head, at = held or (None, 0)
        results = []
        for row in ready:
            if row[n] != at + 1:
                outcome = "sequence_invalid"
            elif row[before] != head:
                outcome = "previous_hash_invalid"
            else:
                head, at, outcome = row[own], row[n], "accepted"
            results.append((*row, outcome))
        return (head, at), results

    return in_event_order(
        df, stream, time, columns, [sequence, digest], append,
        "head string, at long", "outcome string", lateness, idle,
    )


# ---------------------------------------------------------------- settlement


def settle_stream(
    calls: DataFrame, usage: DataFrame, key: str = "request_id", bound: str = "300 seconds"
) -> DataFrame:
    """Calls with the usage that settled them within the bound; unsettled stay null.

    `calls` carry requested_at, `usage` carries provider_at; both are watermarked,
    so state is dropped once the bound has passed.
    """
    c = calls.withWatermark("requested_at", bound).alias("c")
    u = (
        usage.withWatermark("provider_at", bound)
        .select(F.col(key).alias("usage_key"), *[x for x in usage.columns if x != key])
        .alias("u")
    )
    condition = F.expr(
        f"{key} = usage_key AND provider_at BETWEEN requested_at - INTERVAL {bound} "
        f"AND requested_at + INTERVAL {bound}"
    )
    return c.join(u, condition, "left_outer").withColumn(
        "settled", F.col("usage_key").isNotNull()
    ).drop("usage_key")


# ---------------------------------------------------------------- live counters


def coverage_stream(events: DataFrame, run: Sequence[str] = ("run_id",)) -> DataFrame:
    """Running coverage per run (update or complete mode)."""
    totals = events.groupBy(*run).agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in COUNTERS],
        F.bool_and("full_scope").alias("full_scope"),
        F.max_by("status", "event_time").alias("run_status"),
        # A later event without a reason does not take one away.
        F.max_by("stop_reason", F.when(F.col("stop_reason").isNotNull(), F.col("event_time"))).alias("stop_reason"),
    )
    return coverage_status(totals)


def admission_stream(
    events: DataFrame,
    key: Sequence[str],
    limit: int,
    seconds: int = 60,
    time: str = "ts",
    event_id: str = "event_id",
    lateness: str = "1 minute",
) -> DataFrame:
    """Exact sliding admission: rejected events are not counted, an event exactly
    `seconds` old is out of the window. State is the admitted times, at most `limit`;
    it is dropped once a key has been idle for the window."""
    key = list(key)
    width = seconds * 1_000_000

    def admit(held, ready):
        recent = list(held[0]) if held else []
        results = []
        for row in ready:
            now = row[-1]
            recent = [t for t in recent if t > now - width]
            if len(recent) >= limit:
                results.append((*row, False, -(-(recent[0] + width - now) // 1000)))
            else:
                recent.append(now)
                results.append((*row, True, None))
        return (recent,), results

    return in_event_order(
        events, key, time, [event_id], [AT, event_id], admit,
        "recent array<long>", "admitted boolean, retry_after_ms long", lateness, f"{seconds} seconds",
    )


# ---------------------------------------------------------------- windows


def metrics_stream(
    emitted: DataFrame, lateness: str = "10 minutes", width: str = "1 minute", labels: Sequence[str] = ()
) -> DataFrame:
    """Tumbling windows per metric; rows later than the watermark are left out."""
    return (
        emitted.withWatermark("ts", lateness)
        .groupBy(F.window("ts", width).alias("w"), "name", *labels)
        .agg(F.count("*").alias("n"), F.sum("value").alias("total"))
        .select(F.col("w.start").alias("window_start"), "name", *labels, "n", "total")
    )


def run_sessions(
    events: DataFrame, run: Sequence[str] = ("run_id",), gap: str = "120 seconds", lateness: str = "10 minutes"
) -> DataFrame:
    """Activity sessions of a run; a gap longer than the lease ends one."""
    watermarked = events.withWatermark("ts", lateness) if events.isStreaming else events
    return (
        watermarked.groupBy(*run, F.session_window("ts", gap).alias("s"))
        .agg(F.count("*").alias("n_events"))
        .select(*run, F.col("s.start").alias("started"), F.col("s.end").alias("ended"), "n_events")
    )


def visible_stream(
    df: DataFrame, tombstones: DataFrame, key: Sequence[str] = ("tenant_id", "document_version_id")
) -> DataFrame:
    """Rows of documents without a tombstone; the static side is re-read per micro-batch."""
    return df.join(tombstones.select(*key).distinct(), list(key), "left_anti")
