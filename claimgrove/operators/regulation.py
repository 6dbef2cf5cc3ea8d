"""Dated obligations and industry applicability as joins that refuse to guess."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimgrove.functions.arrays import is_subset
from claimgrove.session import small_side


def resolve_timeline(
    contexts: DataFrame, entries: DataFrame, key: Sequence[str] = ("company_id",)
) -> DataFrame:
    """Outcome of the only entry valid at `as_of` whose conditions all hold, else undetermined.

    The distinct (as_of, conditions) situations are resolved, not every row:
    each situation meets the months of the entries' validity, so the range test
    runs behind an equality. `contexts`: key, as_of DATE, condition_ids ARRAY;
    `entries`: entry_id, outcome, condition_ids, starts_on, ends_before.
    """
    key = list(key)
    sorted_ids = F.array_sort(F.array_distinct("condition_ids"))
    rows = contexts.withColumn("__ids", sorted_ids)
    situations = rows.select("as_of", "__ids").distinct()
    month = lambda c: F.trunc(c, "month")
    horizon = situations.agg(F.max("as_of").alias("m")).scalar()
    last = F.least(F.coalesce(F.date_sub("ends_before", 1), horizon), horizon)
    spread = (
        entries.withColumn("__last", last)
        .filter(F.col("starts_on") <= F.col("__last"))
        .withColumn(
            "__month",
            F.explode(
                F.sequence(month(F.col("starts_on")), month(F.col("__last")), F.expr("interval 1 month"))
            ),
        )
        .select(
            "__month", "entry_id", "outcome", F.col("condition_ids").alias("__need"), "starts_on", "ends_before"
        )
    )
    valid = (
        situations.withColumn("__month", month(F.col("as_of")))
        .join(small_side(spread), "__month")
        .filter(
            (F.col("starts_on") <= F.col("as_of"))
            & (F.col("ends_before").isNull() | (F.col("as_of") < F.col("ends_before")))
            & is_subset(F.col("__need"), F.col("__ids"))
        )
        .groupBy("as_of", "__ids")
        .agg(F.count("*").alias("n_matches"), F.min("outcome").alias("outcome"))
    )
    return rows.join(valid, ["as_of", "__ids"], "left").select(
        *contexts.columns,
        F.coalesce("n_matches", F.lit(0)).alias("n_matches"),
        F.when(F.col("n_matches") == 1, F.col("outcome"))
        .otherwise(F.lit("undetermined"))
        .alias("outcome"),
    )


def resolve_applicability(topics: DataFrame, mapping: DataFrame) -> DataFrame:
    """Applicability of each (industry, topic); a missing or unverified mapping is
    undetermined and never N_A.

    `mapping`: version, verification_status, industry_system, industry_code,
    topic_id, applicability, mandatory. A repeated key is undetermined.
    """
    keys = ["industry_system", "industry_code", "topic_id"]
    one = mapping.groupBy(*keys).agg(
        F.count("*").alias("__n"),
        F.min(F.struct("applicability", "mandatory", "version", "verification_status")).alias("m"),
    )
    joined = topics.join(small_side(one), keys, "left")
    usable = (
        (F.col("__n") == 1)
        & (F.col("m.verification_status") == "verified")
        & (F.lower("industry_system") != "unknown")
        & F.col("industry_code").isNotNull()
    )
    usable = F.coalesce(usable, F.lit(False))
    return joined.select(
        *topics.columns,
        F.when(usable, F.col("m.applicability")).otherwise(F.lit("undetermined")).alias("applicability"),
        F.when(
            usable & (F.col("m.applicability") == "applicable"), F.col("m.mandatory")
        ).alias("mandatory"),
        F.col("m.version").alias("mapping_version"),
    )
