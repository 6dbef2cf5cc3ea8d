"""Snapshot of parsed documents: blocks, edges and issues under explicit schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BOX = "struct<x0:double,y0:double,x1:double,y1:double>"
IDENTITY = "tenant_id string, document_version_id string, parse_manifest_id string, source_sha256 string"
SCHEMAS = {
    "blocks": (
        f"{IDENTITY}, source_id string, page_num int, printed_page_label string, kind string, "
        "quality string, winner int, raw_text string, raw_text_sha256 string, "
        f"normalized_text string, bbox {BOX}, table_native_id string, row_number int, "
        "column_number int, row_span int, column_span int, context array<string>"
    ),
    "edges": (
        "tenant_id string, document_version_id string, source_id string, target_id string, "
        "relation string"
    ),
    "issues": (
        "tenant_id string, document_version_id string, issue_id string, kind string, page_num int, "
        "source_ids array<string>, state string, reason string"
    ),
}


def read_graph(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Lazy frames of one epoch directory; nothing is inferred from the files."""
    return {
        name: spark.read.schema(schema).parquet(f"{path}/{name}")
        for name, schema in SCHEMAS.items()
    }


def write_graph(frames: dict[str, DataFrame], path: str) -> None:
    """Write an epoch directory, blocks and edges laid out by document."""
    for name, df in frames.items():
        laid_out = df.repartition("tenant_id", "document_version_id") if name != "issues" else df
        laid_out.write.mode("errorifexists").parquet(f"{path}/{name}")


def identity_violations(blocks: DataFrame) -> DataFrame:
    """Documents whose rows disagree on manifest or source hash, or repeat a source id."""
    doc = ["tenant_id", "document_version_id"]
    mixed = (
        blocks.groupBy(*doc)
        .agg(
            F.min("parse_manifest_id").alias("m_lo"),
            F.max("parse_manifest_id").alias("m_hi"),
            F.min("source_sha256").alias("h_lo"),
            F.max("source_sha256").alias("h_hi"),
            F.count_if(F.col("parse_manifest_id").isNull() | F.col("source_sha256").isNull()).alias("nulls"),
        )
        .filter("m_lo <> m_hi or h_lo <> h_hi or nulls > 0")
        .select(*doc, F.lit("identity_mismatch").alias("reason"))
    )
    repeated = (
        blocks.groupBy(*doc, "source_id")
        .agg(F.count("*").alias("n"))
        .filter("n > 1")
        .select(*doc, F.lit("duplicate_source_id").alias("reason"))
        .distinct()
    )
    stale = (
        blocks.filter(~F.col("raw_text_sha256").eqNullSafe(F.sha2("raw_text", 256)))
        .select(*doc, F.lit("text_hash_mismatch").alias("reason"))
        .distinct()
    )
    return mixed.unionByName(repeated).unionByName(stale)


def valid_documents(frames: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The snapshot without documents that fail identity checks."""
    doc = ["tenant_id", "document_version_id"]
    bad = identity_violations(frames["blocks"]).select(*doc).distinct()
    return {name: df.join(bad, doc, "left_anti") for name, df in frames.items()}
