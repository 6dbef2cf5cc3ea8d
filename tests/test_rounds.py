"""Results that must not depend on arrival order, chunking or cardinality."""

import hashlib
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from claimgrove.operators import claims, ledger, numeric
from claimgrove.streaming import streams
from tests.test_streaming import drain, source  # noqa: F401  fixture

CHAIN = "tenant_id string, run_id string, sequence long, previous_event_hash string, event_hash string"


def test_long_chain_in_one_batch_is_accepted_whatever_its_order(source, tmp_path):  # noqa: F811
    n = 25_000
    h = [None, *(hashlib.sha256(str(i).encode()).hexdigest() for i in range(n))]
    rows = [("t", "r", i, h[i - 1], h[i]) for i in range(1, n + 1)]
    random.Random(1).shuffle(rows)
    got = drain(streams.audit_stream(source(rows, CHAIN)), tmp_path, name="long_chain")
    assert len(got) == n and {r["outcome"] for r in got} == {"accepted"}


def test_admission_of_shuffled_rows_equals_a_plain_loop(source, tmp_path):  # noqa: F811
    n = 25_000
    start = pd.Timestamp("2024-01-01")
    rows = [("u", i, str(start + pd.Timedelta(seconds=i))) for i in range(n)]
    random.Random(2).shuffle(rows)
    got = drain(
        streams.admission_stream(source(rows, "user string, event_id int, ts string"), ["user"], 2),
        tmp_path,
        name="long_admission",
    )
    recent, want = [], {}
    for i in range(n):
        recent = [t for t in recent if t > i - 60]
        want[i] = len(recent) < 2
        if want[i]:
            recent.append(i)
    assert {r["event_id"]: r["admitted"] for r in got} == want


def test_idempotence_of_shuffled_rows(source, tmp_path):  # noqa: F811
    rows = [("k", "first" if i == 0 else "other", str(pd.Timestamp("2024-01-01") + pd.Timedelta(seconds=i))) for i in range(25_000)]
    random.Random(3).shuffle(rows)
    got = drain(streams.idempotent_stream(source(rows, "key string, body string, ts string"), ["key"], "body"), tmp_path, name="long_idem")
    outcomes = pd.Series([r["outcome"] for r in got]).value_counts().to_dict()
    assert outcomes == {"conflict": 24_999, "new": 1}


def numeric_rows(spark, bindings, values):
    dims = {"metric_raw": "m", "scope": None, "subject": "s", "scope2_basis": None, "organizational_boundary": None, "denominator": None}
    doc = {"tenant_id": "t", "document_version_id": "d"}
    null = lambda d: {k: F.lit(v).cast("string") for k, v in d.items()}
    b = spark.createDataFrame(bindings, "claim_id string, kind string, observation_ids array<string>, reported_value string").withColumns(
        null({**doc, **dims, "unit": "t", "reporting_period": "2024", "baseline_period": None, "quantity_kind": "absolute", "baseline_subject": None})
    ).withColumns({"claim_verified": F.lit(True), "product_accepted": F.lit(True), "aggregation_accepted": F.lit(True)})
    o = spark.createDataFrame(values, "observation_id string, value_raw string").withColumns(
        null({**doc, **dims, "unit_canonical": "t", "reporting_period": "2024", "value_state": "value"})
    ).withColumns({"value_source_id": F.col("observation_id"), "issue_open": F.lit(False), "notes_open": F.lit(False)})
    return b, o


def test_two_bindings_of_one_claim_have_a_verdict_each(spark):
    b, o = numeric_rows(
        spark,
        [("c", "comparison", ["a"], "10"), ("c", "comparison", ["b"], "20"), ("c", "comparison", ["b"], "20"), ("c", "sum", ["a", "b"], "31")],
        [("a", "10"), ("b", "20")],
    )
    got = sorted((r["kind"], r["reported_value"], r["status"], r["computed"]) for r in numeric.check_numeric(b, o).collect())
    assert got == [("comparison", "10", "consistent", "10"), ("comparison", "20", "consistent", "20"), ("sum", "31", "consistent", "30")]


@pytest.mark.parametrize("text,status,reason", [
    ("1.0000000001", "consistent", None),
    ("1.00000000000000000002", "consistent", None),
    ("1" + "0" * 50, "not_computable", "precision_exceeded"),
    ("none", "not_computable", "value_missing_or_unresolved"),
])
def test_numbers_with_many_decimals_equal_themselves(spark, text, status, reason):
    b, o = numeric_rows(spark, [("c", "comparison", ["a"], text)], [("a", text)])
    got = numeric.check_numeric(b, o).first()
    assert (got["status"], got["reason"]) == (status, reason)
    reported = spark.createDataFrame([(1, text)], "claim_id int, reported_value string")
    parts = spark.createDataFrame([(1, text, "x")], "claim_id int, value_raw string, value_source_id string")
    got = numeric.check_sum(reported, parts).first()
    assert (got["status"], got["reason"]) == (status, reason)


def test_nested_spans_leave_no_gap(spark):
    texts = spark.createDataFrame([("s", "x" * 60)], "source_id string, text string")
    spans = spark.createDataFrame([("s", 0, 50), ("s", 5, 10), ("s", 20, 30)], "source_id string, char_start int, char_end int")
    got = [(r["char_start"], r["char_end"]) for r in claims.uncovered_spans(texts, spans).collect()]
    assert got == [(50, 60)]


def test_left_billing_join_keeps_equal_calls_apart(spark):
    call = ("k", "2024-01-01 00:00:00")
    calls = spark.createDataFrame([call, call, ("lone", "2024-01-01 00:00:00")], "call_key string, requested_at string")
    export = spark.createDataFrame([("k", "2024-01-01 00:01:00")], "export_key string, provider_at string")
    got = ledger.match_billing(calls, export, {"call_key": "export_key"}, how="left").collect()
    assert sorted((r["call_key"], r["provider_at"] is not None) for r in got) == [("k", True), ("k", True), ("lone", False)]


def test_whole_text_of_a_candidate(spark):
    doc = "tenant_id string, document_version_id string, source_id string"
    hits = spark.createDataFrame([("t", "d", "s")], doc)
    blocks = spark.createDataFrame([("t", "d", "s", "y" * 9000, "verified", 0)], doc + ", raw_text string, quality string, winner int")
    assert claims.raw_candidates(hits, blocks).first()["char_end"] == 9000
    assert claims.raw_candidates(hits, blocks, 100).first()["truncated"]
