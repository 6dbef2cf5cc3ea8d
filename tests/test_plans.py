"""Composite jobs and every registered query on the smallest tables."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as driver
from claimgrove.plans import grade_claims, reconcile_disclosures, retrieve
from workload import QUERIES as WORKLOAD

SMALL = "/root/testdata/sf0.001"
# One query per area; the full list runs in tools/check.py against SQL.
SAMPLE = ("bm25_topk", "budgeted_pick", "run_summary", "audit_chain", "span_gaps", "cost_ledger", "set_ops")


def test_names_and_contract():
    queries, sql = driver.queries(), driver.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 90
    # Those names belong to the training-data operators, which may be absent.
    assert not [n for n in WORKLOAD if "pipeline" in n or n.startswith("op")]


@pytest.mark.parametrize("name", SAMPLE)
def test_query_runs(spark, name):
    assert driver.queries()[name](spark, SMALL).count() > 0


def test_retrieve_blocks_on_unread_own_source(spark):
    doc = ("t", "v")
    blocks = spark.createDataFrame(
        [(*doc, s, 1, k, q, 0, x, x) for s, k, q, x in [
            ("a", "paragraph", "verified", "we cut energy use"), ("b", "paragraph", "verified", "energy use fell"),
            ("c", "paragraph", "unverified", "energy"), ("n", "footnote", "verified", "energy note")]],
        "tenant_id string, document_version_id string, source_id string, page_num int, kind string, quality string, winner int, raw_text string, normalized_text string",
    )
    edges = spark.createDataFrame([], "tenant_id string, document_version_id string, source_id string, target_id string, relation string")
    issues = spark.createDataFrame([], "tenant_id string, document_version_id string, issue_id string, state string, source_ids array<string>")
    claims = spark.createDataFrame(
        [(*doc, "k1", "a", 1, "energy use", True), (*doc, "k2", "c", 1, "energy", True)],
        "tenant_id string, document_version_id string, claim_id string, source_id string, page_num int, quote string, verified boolean",
    )
    packets, candidates = retrieve(claims, blocks, edges, issues)
    got = {r["claim_id"]: r for r in packets.collect()}
    assert got["k1"]["status"] == "ready" and got["k1"]["picked"][:2] == ["a", "b"]
    assert got["k2"]["status"] == "blocked_evidence"
    aside = {r["source_id"] for r in candidates.filter("set_aside").collect()}
    assert aside == {"c", "n"}


def test_grade_claims_from_votes(spark):
    names = {"G1": 2024, "G2": 5}
    ballots = spark.createDataFrame(
        [("c", e, "present", str(v), "h", "local_claim", True) for e, v in names.items() for _ in range(3)],
        "claim_id string, element_id string, state string, normalized_value string, binding_hash string, source_scope string, refs_verified boolean",
    )
    claims = spark.createDataFrame(
        [("c", "goal", None, None, None, False)],
        "claim_id string, track string, superlative_quote string, superlative_cited boolean, safe_harbor_category string, product_variant boolean",
    )
    got = grade_claims(ballots, claims).first()
    assert (got["decision_status"], got["grade_floor"], got["grade_ceiling"]) == ("blocked_evidence", "E1", "E3")


def test_reconcile_rejects_unregistered_sources(spark):
    from workload.tables import _packets

    packets = _packets(spark, SMALL).withColumn("packet_id", F.col("claim_id"))
    ids = "tenant_id company_id package_id corp_code fiscal_year consolidation sustainability_version financial_version rcept_no sustainability_published_at financial_published_at as_of_date period_start period_end financial_period_start financial_period_end decision_binding".split()
    sources = packets.select(
        "packet_id", "item", F.lit("s").alias("source_id"), F.lit("unknown").alias("document_id"), F.lit("h").alias("artifact_sha256"),
        F.lit("l").alias("locator"), F.lit("q").alias("quote"),
        F.struct(F.lit(False).alias("synthetic"), *[F.lit("x").alias(i) for i in ids]).alias("packet"),
    )
    fields = [f"{i} string" for i in ids if not i.startswith(("sustainability", "financial"))]
    registry = spark.createDataFrame(
        [], "document_id string, synthetic boolean, document_role string, document_version_id string, published_at string, available_on string, artifact_sha256 string, "
        "relevant_items array<string>, source_bindings map<string,struct<locator:string,quote:string>>, " + ", ".join(fields)
    )
    outcomes, rejected = reconcile_disclosures(packets, sources, registry)
    assert outcomes.count() == 0
    assert {r["reason"] for r in rejected.collect()} == {"document_registry_missing"}
