"""Assurance statements: field extraction inside one opinion and scope matching."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimgrove.functions.arrays import is_subset
from claimgrove.functions.periods import single_year
from claimgrove.functions.text import nfc, strip
from claimgrove.operators.claims import DOC, contained_in

# --- fixed values: fields and levels -------------------------------------------------------
SCALARS = ("provider", "standard_raw", "level", "reporting_period")
LISTS = (
    "entities",
    "facilities",
    "covered_metrics",
    "excluded_entities",
    "excluded_facilities",
    "excluded_metrics",
    "excluded_periods",
    "explicit_exclusions",
)
LEVELS = {
    "limited": "limited",
    "reasonable": "reasonable",
    "none": "none",
    "제한적 보증": "limited",
    "합리적 보증": "reasonable",
}
# --- end of fixed values ---------------------------------------------------------------------


def _clean(c: Column) -> Column:
    return strip(nfc(c))


def within_boundary(
    refs: DataFrame, boundary: DataFrame, key: Sequence[str] = (*DOC, "statement_id", "source_id")
) -> DataFrame:
    """References that lie inside a declared span of their opinion (semi join)."""
    spans = boundary.select(
        *key, F.col("char_start").alias("outer_start"), F.col("char_end").alias("outer_end")
    )
    return contained_in(refs, spans, key, how="left_semi")


def assurance_fields(
    refs: DataFrame,
    boundary: DataFrame,
    statement: Sequence[str] = (*DOC, "statement_id"),
) -> DataFrame:
    """One row per statement with its scalar and list fields and what is unresolved.

    `refs`: statement key, ref_id, field, source_id, char span, quote, verified.
    A field outside the opinion, unverified, or a scalar with two values is
    unresolved; several multi-valued scope lists leave the scope group open.
    """
    statement = list(statement)
    inside = within_boundary(refs, boundary, [*statement, "source_id"]).withColumn(
        "__in", F.lit(True)
    )
    marked = refs.join(inside.select("ref_id", "__in"), "ref_id", "left").withColumn(
        "ok", F.coalesce("__in", F.lit(False)) & F.col("verified")
    )
    values = (
        marked.withColumn("value", _clean(F.col("quote")))
        .groupBy(*statement, "field", "value")
        .agg(F.bool_and("ok").alias("ok"))
        .groupBy(*statement, "field")
        .agg(
            F.bool_and("ok").alias("ok"),
            F.count("*").alias("n"),
            # Distinct literals of one opinion field; an opinion is one document part.
            F.array_sort(F.collect_set("value")).alias("values"),
        )
    )
    is_scalar = F.col("field").isin(*SCALARS)
    bad = ~F.col("ok") | (is_scalar & (F.col("n") > 1))
    pairs = [F.lit(x) for k, v in LEVELS.items() for x in (k, v)]
    level = F.create_map(*pairs)
    fields = values.groupBy(*statement).agg(
        *[
            F.max(F.when((F.col("field") == s) & ~bad, F.get("values", F.lit(0)))).alias(s)
            for s in SCALARS
        ],
        *[
            F.max(F.when((F.col("field") == name) & ~bad, F.col("values"))).alias(name)
            for name in LISTS
        ],
        F.count_if(
            F.col("field").isin("covered_metrics", "entities", "facilities") & ~bad & (F.col("n") > 1)
        ).alias("__multi"),
        F.array_sort(F.collect_set(F.when(bad, F.col("field")))).alias("__bad"),
    )
    known = level[F.col("level")]
    open_ = F.array_sort(
        F.array_distinct(
            F.array_compact(
                F.concat(
                    "__bad",
                    F.array(
                        F.when(F.col("level").isNotNull() & known.isNull(), F.lit("level")),
                        F.when(F.col("__multi") > 1, F.lit("scope_group")),
                    ),
                )
            )
        )
    )
    empty = F.array().cast("array<string>")
    return fields.select(
        *statement,
        "provider",
        "standard_raw",
        known.alias("level"),
        "reporting_period",
        *[F.coalesce(name, empty).alias(name) for name in LISTS],
        open_.alias("unresolved_fields"),
    )


def _covers(claimed: Column, covered: Column) -> Column:
    """yes | no | unknown: every claimed name is covered."""
    claimed = F.coalesce(claimed, F.array().cast("array<string>"))
    covered = F.coalesce(covered, F.array().cast("array<string>"))
    return (
        F.when((F.size(claimed) == 0) | (F.size(covered) == 0), F.lit("unknown"))
        .when(is_subset(claimed, covered), F.lit("yes"))
        .otherwise(F.lit("no"))
    )


def match_assurance(pairs: DataFrame) -> DataFrame:
    """Scope match of a claim with one opinion: covered, not_covered, undetermined.

    Row columns: statement_id (null = no statement) and the statement fields;
    metric, claim_period, claim_entities, claim_facilities. Names are compared
    as given (normalise with `clean_names` first), years as exact literals.
    """
    metric_list = F.when(
        F.coalesce(F.col("metric"), F.lit("")) != "", F.array("metric")
    ).otherwise(F.array().cast("array<string>"))
    metric = _covers(metric_list, F.col("covered_metrics"))
    claim_year, year = single_year(F.col("claim_period")), single_year(F.col("reporting_period"))
    period = (
        F.when(claim_year.isNull() | year.isNull(), F.lit("unknown"))
        .when(claim_year == year, F.lit("yes"))
        .otherwise(F.lit("no"))
    )
    entity = _covers(F.col("claim_entities"), F.col("entities"))
    facility = _covers(F.col("claim_facilities"), F.col("facilities"))
    boundary = (
        F.when((entity == "no") | (facility == "no"), F.lit("no"))
        .when((entity == "yes") & (facility == "yes"), F.lit("yes"))
        .otherwise(F.lit("unknown"))
    )
    empty = F.array().cast("array<string>")
    lists = lambda c: F.coalesce(F.col(c), empty)
    overlap = lambda a, b: F.size(F.array_intersect(a, b)) > 0
    # The year of each excluded period, by plain patterns (no Python inside a lambda).
    years = F.transform(
        lists("excluded_periods"),
        lambda v: F.nullif(F.regexp_extract(v, r"^([0-9]{4})(?:년|\s*년도)?$", 1), F.lit("")),
    )
    period_list = F.when(
        F.coalesce(F.col("claim_period"), F.lit("")) != "", F.array("claim_period")
    ).otherwise(empty)
    excluded = (
        overlap(metric_list, lists("excluded_metrics"))
        | overlap(period_list, lists("excluded_periods"))
        | overlap(lists("claim_entities"), lists("excluded_entities"))
        | overlap(lists("claim_facilities"), lists("excluded_facilities"))
        | F.coalesce(F.array_contains(F.array_compact(years), claim_year), F.lit(False))
    )
    uncertain = (
        (F.size(lists("unresolved_fields")) > 0)
        | F.exists(years, lambda y: y.isNull())
        | (F.size(lists("explicit_exclusions")) > 0)
    )
    rows = pairs.withColumns(
        {"metric_match": metric, "period_match": period, "boundary_match": boundary}
    )
    m, p, b = F.col("metric_match"), F.col("period_match"), F.col("boundary_match")
    mismatch = (F.col("level") == "none") | (m == "no") | (p == "no") | (b == "no")
    covered = (
        (m == "yes")
        & (p == "yes")
        & (b == "yes")
        & (F.coalesce("provider", F.lit("")) != "")
        & (F.coalesce("standard_raw", F.lit("")) != "")
        & F.col("level").isin("limited", "reasonable")
    )
    absent = F.col("statement_id").isNull()
    reason = (
        F.when(absent, F.lit("statement_unavailable"))
        .when(
            F.array_contains(lists("unresolved_fields"), "scope_group"),
            F.lit("ambiguous_scope_group"),
        )
        .when(excluded, F.lit("explicit_exclusion"))
        .when(uncertain, F.lit("unresolved_statement"))
        .when(F.coalesce(mismatch, F.lit(False)), F.lit("scope_mismatch_or_no_assurance"))
        .when(~F.coalesce(covered, F.lit(False)), F.lit("insufficient_scope_information"))
    )
    rows = rows.withColumn("reason", reason)
    return rows.withColumns(
        {
            "status": F.when(F.col("reason").isNull(), F.lit("covered"))
            .when(
                F.col("reason").isin("explicit_exclusion", "scope_mismatch_or_no_assurance"),
                F.lit("not_covered"),
            )
            .otherwise(F.lit("undetermined")),
            "metric_match": F.when(absent, F.lit("unknown")).otherwise(m),
            "period_match": F.when(absent, F.lit("unknown")).otherwise(p),
            "boundary_match": F.when(absent, F.lit("unknown")).otherwise(b),
        }
    )
