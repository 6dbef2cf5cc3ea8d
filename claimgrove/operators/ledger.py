"""Usage ledger: exact cost, budgets, billing match and settlement bound."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimgrove.session import small_side

RUN = ("tenant_id", "run_id")
PRICE_KEY = ("model_id", "region")
BUCKETS = {
    "input": "input_per_million",
    "output": "output_per_million",
    "cache_read": "cache_read_per_million",
    "cache_write": "cache_write_per_million",
}
# Amounts per attempt: tokens (integers) times a price with 12 decimals.
MONEY = "decimal(38,18)"
PRICE = "decimal(20,12)"
TOKENS = "decimal(15,0)"


def cost_columns() -> Column:
    """Exact cost of one attempt, null when any token count or needed price is unknown."""
    tokens = {
        "input": F.col("input_tokens") - F.col("cache_read_tokens") - F.col("cache_write_tokens"),
        "output": F.col("output_tokens"),
        "cache_read": F.col("cache_read_tokens"),
        "cache_write": F.col("cache_write_tokens"),
    }
    total = F.lit(0).cast(MONEY)
    for bucket, price in BUCKETS.items():
        n = tokens[bucket]
        # tokens * price / 10^6 as an exact shift of the price by six places.
        part = (n.cast(TOKENS) * F.col(price).cast(PRICE)).cast("decimal(35,12)")
        shifted = (part * F.lit("0.000001").cast("decimal(7,6)")).cast(MONEY)
        total = total + F.when(n == 0, F.lit(0).cast(MONEY)).otherwise(shifted)
    return total.cast(MONEY)


def usage_cost(
    attempts: DataFrame, prices: DataFrame, key: Sequence[str] = PRICE_KEY
) -> DataFrame:
    """Attempts with `cost` (null = unknown) from the price snapshot of model and region."""
    priced = attempts.join(
        small_side(prices.select(*key, "snapshot_id", *BUCKETS.values())), list(key), "left"
    )
    return priced.withColumn("cost", cost_columns()).drop(*BUCKETS.values())


def cost_summary(attempts: DataFrame, run: Sequence[str] = RUN) -> DataFrame:
    """Token sums, attempts, cache hits and the exact amount per run.

    The amount is given only if every active attempt has a known cost. Released
    attempts leave the sums, but their response-cache hits still count.
    """
    active = F.col("state") != "released"
    settled = active & (F.col("state") == "settled")
    known = settled & F.col("cost").isNotNull()
    n_active, n_known = F.count_if(active), F.count_if(known)
    status = (
        F.when((F.col("__a") > 0) & (F.col("__k") == F.col("__a")), F.lit("known"))
        .when(F.col("__k") > 0, F.lit("partial"))
        .otherwise(F.lit("unknown_cost"))
    )
    folded = attempts.groupBy(*run).agg(
        F.coalesce(F.sum(F.when(settled, F.col("input_tokens"))), F.lit(0)).alias("input_tokens"),
        F.coalesce(F.sum(F.when(settled, F.col("output_tokens"))), F.lit(0)).alias("output_tokens"),
        F.count_if(F.col("state").isin("dispatched", "settled")).alias("attempt_count"),
        (
            F.count_if(settled & (F.coalesce("cache_read_tokens", F.lit(0)) > 0))
            + F.count_if(F.coalesce("response_cache_hit", F.lit(False)))
        ).alias("cache_hit_count"),
        n_active.alias("__a"),
        n_known.alias("__k"),
        F.try_sum(F.when(known, F.col("cost"))).alias("__amount"),
        F.min(F.when(settled, F.col("pricing_snapshot_id"))).alias("__lo"),
        F.max(F.when(settled, F.col("pricing_snapshot_id"))).alias("__hi"),
        F.count_if(settled & F.col("pricing_snapshot_id").isNull()).alias("__unpriced"),
    )
    one_price = (F.col("__lo") == F.col("__hi")) & (F.col("__unpriced") == 0)
    return folded.select(
        *run,
        "input_tokens",
        "output_tokens",
        "attempt_count",
        "cache_hit_count",
        F.when(status == "known", F.col("__amount")).alias("amount"),
        F.when(one_price, F.col("__lo")).alias("pricing_snapshot_id"),
        status.alias("cost_status"),
    )


def budget_usage(
    attempts: DataFrame, limits: DataFrame, run: Sequence[str] = RUN
) -> DataFrame:
    """Consumption per run and role: the actual count if settled, else the reserved one."""
    active = attempts.filter(F.col("state") != "released")
    used = lambda actual, reserved: F.sum(F.coalesce(actual, reserved))
    per_role = active.groupBy(*run, "role").agg(
        F.count("*").alias("calls"),
        used("input_tokens", "reserved_input").alias("used_input"),
        used("output_tokens", "reserved_output").alias("used_output"),
        F.bool_or(
            F.coalesce(
                (F.col("input_tokens") > F.col("reserved_input"))
                | (F.col("output_tokens") > F.col("reserved_output")),
                F.lit(False),
            )
        ).alias("overrun"),
    )
    return per_role.join(small_side(limits), "role", "left").withColumns(
        {
            "calls_left": F.col("max_calls") - F.col("calls"),
            "exhausted": F.col("overrun")
            | F.coalesce(
                (F.col("calls") >= F.col("max_calls"))
                | (F.col("used_input") >= F.col("max_input"))
                | (F.col("used_output") >= F.col("max_output")),
                F.lit(False),
            ),
        }
    )


def aggregate_bound(
    calls: DataFrame, bill: DataFrame, start: str, end: str, run: Sequence[str] = ()
) -> DataFrame:
    """Replace the reserved amounts of unsettled calls by the billed total of a window.

    Valid only when the window covers the earliest evidence of the ledger and
    the bill's first usage; otherwise the bound is null with a reason.
    """
    run = list(run)
    lo, hi = F.lit(start).cast("date"), F.lit(end).cast("date")
    in_window = F.col("usage_date").between(lo, hi)
    billed = bill.groupBy(*run).agg(
        F.sum(F.when(in_window, F.col("item_cost"))).alias("billed"),
        F.count_if(~in_window).alias("outside"),
        F.min("usage_date").alias("first_usage"),
    )
    ledger = calls.groupBy(*run).agg(
        F.sum("committed").alias("before"),
        F.coalesce(F.sum(F.when(~F.col("settled"), F.col("committed"))), F.lit(0)).alias("reserved"),
        F.count_if(~F.col("settled")).alias("affected"),
        F.min("requested_at").cast("date").alias("earliest"),
    )
    if run:
        joined = ledger.join(billed, run, "left")
    else:
        one = billed.select(F.struct("*").alias("b")).scalar()
        joined = ledger.withColumn("__b", one).select(*ledger.columns, "__b.*")
    reason = F.coalesce(
        F.when(F.col("billed").isNull(), F.lit("no_billing_evidence")),
        F.when(F.col("outside") > 0, F.lit("usage_outside_window")),
        F.when(lo > F.col("earliest"), F.lit("window_misses_earliest_evidence")),
        F.when(F.col("affected") == 0, F.lit("nothing_unsettled")),
    )
    return joined.select(
        *run,
        "before",
        "reserved",
        "billed",
        "affected",
        F.when(
            reason.isNull(), F.col("before") - F.col("reserved") + F.col("billed")
        ).alias("after"),
        reason.alias("reason"),
    )


def match_billing(
    calls: DataFrame,
    export: DataFrame,
    keys: Mapping[str, str],
    seconds: int = 300,
    call_time: str = "requested_at",
    export_time: str = "provider_at",
    equal: Sequence[tuple[str, str]] = (),
    how: str = "inner",
) -> DataFrame:
    """Interval join of calls and billing rows: same keys, |time difference| <= seconds.

    Times are cut into bins as wide as the bound; a call meets its own and the
    two neighbouring bins by equality, so a hot key compares only rows close in
    time. `equal` lists further column pairs that must agree. With `how="left"` a call
    without a match stays once, and equal calls stay as many as they are.
    """
    width = max(1, int(seconds))
    stamp = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    own = F.floor(stamp(call_time) / (width * 1_000_000))
    left = calls.withColumn("__bin", F.explode(F.array(own - 1, own, own + 1)))
    right = export.withColumn("__obin", F.floor(stamp(export_time) / (width * 1_000_000)))
    condition = F.col("__bin") == F.col("__obin")
    for a, b in [*keys.items(), *equal]:
        condition = condition & (F.col(a) == F.col(b))
    condition = condition & (
        F.abs(stamp(call_time) - stamp(export_time)) <= width * 1_000_000
    )
    if how == "left":
        # Only a call's own bin may keep it without a match; the matches of its
        # three copies meet again by the hash of the whole call, pre-aggregated to a flag.
        hits = left.join(right, condition).drop("__bin", "__obin")
        whole = lambda: F.sha2(F.to_json(F.struct(*calls.columns), {"ignoreNullFields": "false"}), 256)
        seen = hits.select(whole().alias("__call")).distinct()
        lone = calls.withColumn("__call", whole()).join(seen, "__call", "left_anti").drop("__call")
        return hits.unionByName(lone, allowMissingColumns=True)
    return left.join(right, condition, how).drop("__bin", "__obin")
