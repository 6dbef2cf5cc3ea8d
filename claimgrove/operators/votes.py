"""Votes of model replicas: majority, unanimity and per-field agreement.

Every operator first counts equal votes (partial aggregation), so the rows that
reach one key are the distinct votes of that key and never the raw ones.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REPLICAS = 3
# Weakest scope first.
SCOPE_PRIORITY = ("global_bound", "same_table", "local_claim")


def _weakest_scope(scope: str = "source_scope") -> Column:
    place = F.lit(len(SCOPE_PRIORITY))
    for i, name in reversed(list(enumerate(SCOPE_PRIORITY))):
        place = F.when(F.col(scope) == name, F.lit(i)).otherwise(place)
    return F.min(place)


def _scope_name(place: Column) -> Column:
    out = F.lit("local_claim")
    for i, name in enumerate(SCOPE_PRIORITY):
        out = F.when(place == i, F.lit(name)).otherwise(out)
    return out


def majority_vote(
    votes: DataFrame,
    key: Sequence[str] = ("claim_id", "element_id"),
    vote: Sequence[str] = ("state", "normalized_value", "binding_hash"),
    replicas: int = REPLICAS,
) -> DataFrame:
    """2-of-3 candidate per key: votes, winner, confirmable flag and review reason.

    A failed replica has no vote but stays in the denominator. A tie of single
    votes has no majority; a 2:1 majority is a candidate that needs review, as
    are unknown and conflict.
    """
    key, vote = list(key), list(vote)
    scoped = "source_scope" in votes.columns
    extra = [_weakest_scope().alias("__scope")] if scoped else []
    counted = votes.groupBy(*key, *vote).agg(F.count("*").alias("n"), *extra)
    best = F.max_by(F.struct(*vote), F.struct(F.col("n"), *[F.col(v) for v in vote]))
    per_key = counted.groupBy(*key).agg(
        F.max("n").alias("n_agree"),
        F.sum("n").alias("n_votes"),
        best.alias("__best"),
        *([F.min("__scope").alias("__scope")] if scoped else []),
    )
    has = F.col("n_agree") >= 2
    state = F.when(has, F.col("__best.state")) if "state" in vote else F.lit(None).cast("string")
    reason = F.when(~has, F.lit("NO_MAJORITY")).when(
        (F.col("n_agree") != replicas)
        | (state.isin("unknown", "conflict") if "state" in vote else F.lit(False)),
        F.lit("REVIEW"),
    )
    return per_key.select(
        *key,
        "n_agree",
        "n_votes",
        *[F.when(has, F.col(f"__best.{v}")).alias(v) for v in vote],
        *([_scope_name(F.col("__scope")).alias("source_scope")] if scoped else []),
        reason.isNull().alias("confirmable"),
        reason.alias("reason"),
    )


def partial_facts(
    votes: DataFrame,
    key: Sequence[str] = ("claim_id", "element_id"),
    vote: Sequence[str] = ("state", "normalized_value", "binding_hash", "source_scope"),
    replicas: int = REPLICAS,
) -> DataFrame:
    """Strict profile: any disagreement is conflict, any missing vote unknown.

    Only three equal, bound and verified `present` votes stay present; a voted
    absence or non-applicability never becomes absent.
    """
    key, vote = list(key), list(vote)
    verified = "refs_verified" in votes.columns
    counted = votes.groupBy(*key, *vote).agg(
        F.count("*").alias("n"),
        *([F.bool_and("refs_verified").alias("ok")] if verified else []),
    )
    per_key = counted.groupBy(*key).agg(
        F.count("*").alias("n_distinct"),
        F.sum("n").alias("n_votes"),
        F.max("n").alias("n_agree"),
        F.first(F.struct(*vote)).alias("__one"),
        *([F.bool_and("ok").alias("ok")] if verified else [F.lit(True).alias("ok")]),
    )
    one = F.col("__one")
    state = (
        F.when(F.col("n_distinct") > 1, F.lit("conflict"))
        .when(F.col("n_votes") < replicas, F.lit("unknown"))
        .when(
            (one["state"] == "present") & one["binding_hash"].isNotNull() & F.col("ok"),
            F.lit("present"),
        )
        .otherwise(F.lit("unknown"))
    )
    return per_key.select(
        *key,
        "n_agree",
        "n_votes",
        state.alias("state"),
        F.when(state == "present", one["normalized_value"]).alias("normalized_value"),
        F.when(state != "present", F.lit("REVIEW")).alias("reason"),
    )


def with_required_facts(
    facts: DataFrame, required: DataFrame, claims: DataFrame, key: Sequence[str] = ("claim_id",)
) -> DataFrame:
    """Add every required fact a claim has no vote for, as unknown.

    `required` is (track, name) of the pinned rule pack, `claims` (key, track).
    """
    key = list(key)
    wanted = claims.select(*key, "track").join(F.broadcast(required), "track")
    unseen = wanted.join(facts.select(*key, "name"), [*key, "name"], "left_anti")
    return facts.select(*key, "name", "state").unionByName(
        unseen.select(*key, "name", F.lit("unknown").alias("state"))
    )


def field_agreement(
    votes: DataFrame,
    key: Sequence[str] = ("claim_id", "field"),
    value: str = "value",
    replicas: int = REPLICAS,
) -> DataFrame:
    """agreed | conflict | unresolved per field, with the number of distinct values.

    Null is a reported value; `validated` (default true) marks usable replicas.
    """
    key = list(key)
    usable = votes.filter("validated") if "validated" in votes.columns else votes
    counted = usable.groupBy(*key, value).agg(F.count("*").alias("n"))
    per_key = counted.groupBy(*key).agg(
        F.sum("n").alias("n_votes"), F.count("*").alias("n_distinct")
    )
    return per_key.withColumn(
        "state",
        F.when(F.col("n_votes") != replicas, F.lit("unresolved"))
        .when(F.col("n_distinct") == 1, F.lit("agreed"))
        .otherwise(F.lit("conflict")),
    )
