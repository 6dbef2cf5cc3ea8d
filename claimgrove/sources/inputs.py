"""Validated inputs: billing exports, collection manifests, review submissions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimgrove.functions.arrays import violations
from claimgrove.functions.text import is_blank

# --- fixed values: export header, manifest vocabulary, submission columns -----------------
BILLING_COLUMNS = (
    "date",
    "api_key_id",
    "api_key_name",
    "usage_type",
    "billing_source",
    "product",
    "pricing_options",
    "quantity",
    "item_cost",
    "used_credit",
    "subtotal",
)
SOURCE_SYSTEMS = ("DART", "integrated_report")
CONSOLIDATIONS = ("consolidated", "separate", "unknown")
STATUSES = ("retrieved", "not_available", "failed")
SUBMISSION_TABLES = ("claims", "elements", "numeric", "assurance")
# --- end of fixed values --------------------------------------------------------------------


def read_csv(spark: SparkSession, path: str, columns: tuple[str, ...]) -> DataFrame:
    """All-text CSV whose header must be exactly `columns`; a bad record fails the read."""
    schema = ", ".join(f"`{c}` string" for c in columns)
    return (
        spark.read.schema(schema)
        .option("header", True)
        .option("enforceSchema", False)
        .option("mode", "FAILFAST")
        .option("multiLine", True)
        .option("escape", '"')
        .csv(path)
    )


def check_billing(rows: DataFrame, start: str, end: str) -> DataFrame:
    """Billing rows with typed amounts and `violations` (empty = usable)."""
    money = lambda c: F.regexp_replace(F.col(c), r"[$,]", "").try_cast("decimal(38,12)")
    day = F.try_to_timestamp(F.col("date"), F.lit("yyyy-MM-dd")).cast("date")
    typed = rows.withColumns(
        {
            "usage_date": day,
            "quantity_n": money("quantity"),
            "item_cost_n": money("item_cost"),
            "used_credit_n": money("used_credit"),
            "subtotal_n": money("subtotal"),
        }
    )
    filled = [(~is_blank(F.coalesce(F.col(c), F.lit(""))), f"{c}_missing") for c in BILLING_COLUMNS]
    checks = (
        *filled,
        (F.col("usage_date").isNotNull(), "date_invalid"),
        (F.col("usage_date").between(F.lit(start).cast("date"), F.lit(end).cast("date")), "outside_window"),
        (F.col("quantity_n") >= 0, "quantity_invalid"),
        ((F.col("usage_type") == "api") & (F.col("billing_source") == "payg"), "usage_type_invalid"),
        (F.col("item_cost_n") >= 0, "item_cost_invalid"),
        (F.col("used_credit_n") >= 0, "used_credit_invalid"),
        (F.col("subtotal_n") >= 0, "subtotal_invalid"),
    )
    return typed.withColumn("violations", violations(*checks))


def billing_total(checked: DataFrame) -> DataFrame:
    """One row: total cost and first usage day; both null if any row is violated."""
    folded = checked.agg(
        F.count("*").alias("n_rows"),
        F.count_if(F.size("violations") > 0).alias("n_violated"),
        F.sum("item_cost_n").alias("total"),
        F.min("usage_date").alias("first_usage"),
    )
    ok = (F.col("n_rows") > 0) & (F.col("n_violated") == 0)
    return folded.select(
        "n_rows",
        "n_violated",
        F.when(ok, F.col("total")).alias("total"),
        F.when(ok, F.col("first_usage")).alias("first_usage"),
    )


def read_billing_csv(spark: SparkSession, path: str, window: tuple[str, str]) -> DataFrame:
    return billing_total(check_billing(read_csv(spark, path, BILLING_COLUMNS), *window))


def validate_manifest(artifacts: DataFrame, generated_at: str | None = None) -> DataFrame:
    """Manifest rows with `violations`; a source listed twice violates each of its rows.

    Retrieved artifacts need hash and locator and no error code, others the
    reverse. No artifact may be fetched after the manifest was generated.
    """
    retrieved = F.col("status") == "retrieved"
    has = lambda c: ~is_blank(F.coalesce(F.col(c), F.lit("")))
    not_blank = lambda c: F.col(c).isNull() | has(c)
    counts = artifacts.groupBy("source_id").agg(F.count("*").alias("__n"))
    joined = artifacts.join(counts, "source_id", "left")
    fetched = F.try_to_timestamp(F.col("fetched_at"))
    late = F.lit(True) if generated_at is None else fetched <= F.lit(generated_at).cast("timestamp")
    checks = (
        (has("source_id"), "source_id_missing"),
        (has("document_version_id"), "document_version_missing"),
        (F.col("corp_code").rlike("^[0-9]{8}$"), "corp_code_invalid"),
        (F.col("fy").isNotNull(), "fiscal_year_missing"),
        (F.col("consolidation").isin(*CONSOLIDATIONS), "consolidation_unknown"),
        (F.col("source_system").isin(*SOURCE_SYSTEMS), "source_system_unknown"),
        (F.col("status").isin(*STATUSES), "status_unknown"),
        (
            F.col("artifact_sha256").isNull() | F.col("artifact_sha256").rlike("^[0-9a-f]{64}$"),
            "hash_invalid",
        ),
        (not_blank("rcept_no"), "receipt_blank"),
        (not_blank("locator"), "locator_blank"),
        (not_blank("error_code"), "error_code_blank"),
        (~retrieved | F.col("artifact_sha256").isNotNull(), "retrieved_without_hash"),
        (~retrieved | F.col("locator").isNotNull(), "retrieved_without_locator"),
        (~retrieved | F.col("error_code").isNull(), "retrieved_with_error"),
        (retrieved | F.col("artifact_sha256").isNull(), "absent_with_hash"),
        (retrieved | F.col("locator").isNull(), "absent_with_locator"),
        (retrieved | F.col("error_code").isNotNull(), "absent_without_error"),
        (F.col("fetched_at").rlike("Z$") & fetched.isNotNull(), "fetched_at_invalid"),
        (late, "fetched_after_manifest"),
        (F.coalesce(F.col("__n"), F.lit(1)) == 1, "duplicate_source"),
    )
    return joined.withColumn("violations", violations(*checks)).drop("__n")


def validate_submission(tables: dict[str, DataFrame]) -> DataFrame:
    """Violations of a four-table review submission: (table, claim_id, reason).

    Claim ids are unique, every child row names a known claim, quotes are filled
    and all rows belong to one document. Any row here rejects the whole batch.
    """
    claims = tables["claims"]
    reason = lambda df, table, why: df.select(
        F.lit(table).alias("table"), "claim_id", F.lit(why).alias("reason")
    )
    out = reason(
        claims.groupBy("claim_id").agg(F.count("*").alias("n")).filter("n > 1"),
        "claims",
        "duplicate_claim_id",
    )
    blank = lambda c: is_blank(F.coalesce(F.col(c), F.lit("")))
    out = out.unionByName(
        reason(claims.filter(blank("claim_id") | blank("quote")), "claims", "required_value_missing")
    )
    page = F.col("physical_page").try_cast("int")
    out = out.unionByName(
        reason(claims.filter(F.coalesce(page < 1, F.lit(True))), "claims", "page_invalid")
    )
    documents = claims.agg(
        F.min("document_id").alias("lo"), F.max("document_id").alias("hi"), F.min("claim_id").alias("claim_id")
    ).filter("lo <> hi")
    out = out.unionByName(reason(documents, "claims", "several_documents"))
    known = claims.select("claim_id").distinct()
    for name in SUBMISSION_TABLES[1:]:
        child = tables[name]
        out = out.unionByName(reason(child.join(known, "claim_id", "left_anti"), name, "claim_unknown"))
    return out


def read_review_csvs(
    spark: SparkSession, folder: str, columns: dict[str, tuple[str, ...]]
) -> tuple[dict[str, DataFrame], DataFrame]:
    """(tables, violations) of a submission folder; use the tables only if none."""
    tables = {n: read_csv(spark, f"{folder}/{n}.csv", columns[n]) for n in SUBMISSION_TABLES}
    return tables, validate_submission(tables)
