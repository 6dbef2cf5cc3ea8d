"""Year-on-year comparison of approved document versions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COMPANY = ("tenant_id", "company_id")


def compare_versions(
    current: DataFrame, prior: DataFrame, key: Sequence[str] = ("comparison_key",)
) -> DataFrame:
    """Changes between two versions: new, removed_candidate, modified, ambiguous.

    A key repeated on either side makes all its rows ambiguous; equal content
    gives no row. Keys are counted first, so only rows of repeated keys and one
    row per unique key are joined, and the repeated rows never meet each other.
    """
    key = list(key)

    def side(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(*key).agg(
            F.count("*").alias(f"{name}_n"),
            F.min("claim_id").alias(f"{name}_id"),
            F.min("content_sha256").alias(f"{name}_sha"),
        )

    keys = side(current, "c").join(side(prior, "p"), key, "full")
    cn, pn = F.coalesce("c_n", F.lit(0)), F.coalesce("p_n", F.lit(0))
    ambiguous = (cn > 1) | (pn > 1)
    marked = keys.withColumn("__ambiguous", ambiguous)
    change = (
        F.when(pn == 0, F.lit("new"))
        .when(cn == 0, F.lit("removed_candidate"))
        .when(F.col("c_sha") != F.col("p_sha"), F.lit("modified"))
    )
    reasons = {
        "new": "target_new_in_current_version",
        "removed_candidate": "target_missing_from_current_version",
        "modified": "target_content_changed",
    }
    named = F.create_map(*[F.lit(x) for pair in reasons.items() for x in pair])
    plain = (
        marked.filter(~F.col("__ambiguous"))
        .withColumn("change", change)
        .filter(F.col("change").isNotNull())
        .select(
            *key,
            F.col("c_id").alias("current_claim_id"),
            F.col("p_id").alias("prior_claim_id"),
            "change",
            named[F.col("change")].alias("reason"),
        )
    )
    doubtful = marked.filter("__ambiguous").select(*key)
    null = F.lit(None)

    def rows(df: DataFrame, current_id: Column, prior_id: Column) -> DataFrame:
        return df.join(doubtful, key, "left_semi").select(
            *key,
            current_id.alias("current_claim_id"),
            prior_id.alias("prior_claim_id"),
            F.lit("ambiguous").alias("change"),
            F.lit("comparison_key_not_unique").alias("reason"),
        )

    kind = current.schema["claim_id"].dataType
    return (
        plain.unionByName(rows(current, F.col("claim_id"), null.cast(kind)))
        .unionByName(rows(prior, null.cast(kind), F.col("claim_id")))
    )


def prior_version(versions: DataFrame, company: Sequence[str] = COMPANY) -> DataFrame:
    """Each approved version with the one prior version it may be compared to.

    The prior must be approved, of the same company and document type, one year
    earlier with the same fiscal month and day bounds; otherwise `not_run` with
    a reason. Several candidates are ambiguous and not picked from.
    """
    company = list(company)
    approved = versions.filter("approved")
    previous = approved.select(
        *company,
        (F.col("report_year") + 1).alias("report_year"),
        "document_type",
        F.date_format("period_start", "MM-dd").alias("__from"),
        F.date_format("period_end", "MM-dd").alias("__to"),
        F.col("document_version_id").alias("prior_id"),
    )
    same = previous.groupBy(*company, "report_year", "document_type", "__from", "__to").agg(
        F.count("*").alias("n"), F.min("prior_id").alias("prior_id")
    )
    any_prior = (
        approved.select(*company, (F.col("report_year")).alias("__y"))
        .groupBy(*company)
        .agg(F.min("__y").alias("__first"))
    )
    rows = versions.withColumns(
        {
            "__from": F.date_format("period_start", "MM-dd"),
            "__to": F.date_format("period_end", "MM-dd"),
        }
    )
    joined = rows.join(
        same, [*company, "report_year", "document_type", "__from", "__to"], "left"
    ).join(any_prior, company, "left")
    reason = F.coalesce(
        F.when(~F.col("approved"), F.lit("version_not_approved")),
        F.when(F.col("n") > 1, F.lit("prior_document_version_ambiguous")),
        F.when(
            F.col("n").isNull() & (F.col("__first") < F.col("report_year")),
            F.lit("prior_document_version_not_previous_year"),
        ),
        F.when(F.col("n").isNull(), F.lit("prior_document_version_missing")),
    )
    return joined.select(
        *versions.columns,
        F.when(reason.isNull(), F.col("prior_id")).alias("prior_document_version_id"),
        F.when(reason.isNull(), F.lit("completed")).otherwise(F.lit("not_run")).alias("status"),
        reason.alias("reason"),
    )
