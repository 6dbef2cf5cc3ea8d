"""Telemetry events: sanitising, metric emission and roll-up."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimgrove.functions.canonical import hmac_sha256

UNKNOWN = "UNKNOWN"
MAX_COUNT = 2**63 - 1


def sanitize_events(
    events: DataFrame,
    key: bytes,
    enums: Mapping[str, Sequence[str]],
    counts: Sequence[str] = (),
    identifiers: Sequence[str] = (),
    latency: str | None = None,
    http_status: str | None = None,
) -> DataFrame:
    """Closed vocabulary, bounded numbers, keyed hashes of identifiers.

    Other values become UNKNOWN (or `unknown` for the event name) or null; no
    free text passes. Hashed columns are replaced by `<name>_hash`.
    """
    new = {}
    for name, allowed in enums.items():
        fallback = "unknown" if name == "event" else UNKNOWN
        new[name] = F.when(F.col(name).isin(*allowed), F.col(name)).otherwise(F.lit(fallback))
    for name in counts:
        new[name] = F.when(F.col(name) >= 0, F.col(name))
    if latency:
        ok = (F.col(latency) >= 0) & (F.col(latency) <= float(2**53)) & ~F.isnan(latency)
        new[latency] = F.when(ok, F.col(latency))
    if http_status:
        new[http_status] = F.when(F.col(http_status).between(100, 599), F.col(http_status))
    for name in identifiers:
        sized = F.length(name).between(1, 1024)
        new[f"{name}_hash"] = F.when(sized, hmac_sha256(key, F.col(name)))
    return events.withColumns(new).drop(*identifiers)


def metrics(
    events: DataFrame, amounts: Sequence[str] = (), labels: Sequence[str] = ("stage", "code")
) -> DataFrame:
    """One row per emitted metric: (event columns, name, value)."""
    rows = [
        F.struct(F.lit(a).alias("name"), F.when(F.col(a) >= 0, F.col(a).cast("double")).alias("value"))
        for a in amounts
    ]
    api = F.col("event") == "api_request"
    rows += [
        F.struct(F.lit("api_requests_total").alias("name"), F.when(api, F.lit(1.0)).alias("value")),
        F.struct(
            F.lit("api_latency_ms").alias("name"),
            F.when(api, F.col("latency_ms").cast("double")).alias("value"),
        ),
        F.struct(
            F.lit("model_tokens").alias("name"),
            (F.col("input_tokens") + F.col("output_tokens")).cast("double").alias("value"),
        ),
        F.struct(
            F.lit("lease_lost_total").alias("name"),
            F.when(F.col("code") == "LEASE_LOST", F.lit(1.0)).alias("value"),
        ),
    ]
    return (
        events.select("ts", *labels, F.explode(F.array(*rows)).alias("m"))
        .select("ts", *labels, "m.name", "m.value")
        .filter(F.col("value").isNotNull())
    )


def rollup_metrics(
    emitted: DataFrame, labels: Sequence[str] = ("stage", "code"), width: str = "1 minute"
) -> DataFrame:
    """Tumbling windows per metric and label set."""
    return (
        emitted.groupBy(F.window("ts", width).alias("w"), "name", *labels)
        .agg(F.count("*").alias("n"), F.sum("value").alias("total"), F.max("value").alias("peak"))
        .select(F.col("w.start").alias("window_start"), "name", *labels, "n", "total", "peak")
    )
