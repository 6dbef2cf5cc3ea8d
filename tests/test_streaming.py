"""Streaming operators run over file sources to completion, against plain expectations."""

import datetime
import hashlib
import random
import time

import pytest
from pyspark.sql import functions as F

from claimgrove.operators.summary import COUNTERS
from claimgrove.streaming import ordered, streams


@pytest.fixture()
def source(spark, tmp_path):
    """Write rows as files and read them back as a stream."""

    def make(rows, schema, parts=1, name="in"):
        path = str(tmp_path / name)
        df = spark.createDataFrame(rows, schema)
        for c in ("ts", "requested_at", "provider_at", "event_time", "occurred_at"):
            if c in df.columns:
                df = df.withColumn(c, F.col(c).cast("timestamp"))
        df.coalesce(parts).write.mode("append").parquet(path)
        return spark.readStream.schema(df.schema).parquet(path)

    return make


def drain(df, tmp_path, mode="append", name="out"):
    q = (
        df.writeStream.format("memory").queryName(name).outputMode(mode)
        .option("checkpointLocation", str(tmp_path / f"cp_{name}"))
        .trigger(availableNow=True).start()
    )
    q.awaitTermination(120)
    return [r.asDict() for r in df.sparkSession.sql(f"select * from {name}").collect()]


def test_idempotent(source, tmp_path):
    rows = [("k", "a", "2024-01-01 00:00:00"), ("k", "a", "2024-01-01 01:00:00"), ("k", "b", "2024-01-01 02:00:00"),
            ("k", "b", "2024-01-02 03:00:00")]
    df = source(rows + [("last", "a", "2024-01-03 00:00:00")], "key string, body string, ts string")
    got = drain(streams.idempotent_stream(df, ["key"], "body"), tmp_path, name="idem")
    assert [r["outcome"] for r in sorted(got, key=lambda r: r["ts"])] == ["new", "replay", "conflict", "new"]


def test_idempotent_compares_what_belongs_to_the_body(source, tmp_path):
    rows = [("k", "a", "m1", "2024-01-01 00:00:00"), ("k", "a", "m1", "2024-01-01 01:00:00"),
            ("k", "a", "m2", "2024-01-01 02:00:00"), ("k", "a", None, "2024-01-01 03:00:00"), ("z", "a", "m", "2024-01-02 00:00:00")]
    df = source(rows, "key string, body string, model string, ts string")
    got = drain(streams.idempotent_stream(df, ["key"], "body", also=["model"]), tmp_path, name="idem_also")
    assert [r["outcome"] for r in sorted(got, key=lambda r: r["ts"])] == ["new", "replay", "conflict", "conflict"]


def test_admission_does_not_count_rejected(source, tmp_path):
    rows = [("u", i, f"2024-01-01 00:00:{s:02d}") for i, s in enumerate([0, 10, 20, 30, 59])] + [("u", 9, "2024-01-01 00:01:00")]
    rows += [("last", 0, "2024-01-01 01:00:00")]
    df = source(rows, "user string, event_id int, ts string")
    got = drain(streams.admission_stream(df, ["user"], 2), tmp_path, name="adm")
    assert [r["admitted"] for r in sorted(got, key=lambda r: r["ts"])] == [True, True, False, False, False, True]


def test_audit_chain_rejects_gap(source, tmp_path):
    h = [hashlib.sha256(str(i).encode()).hexdigest() for i in range(4)]
    rows = [("t", "r", 1, None, h[0]), ("t", "r", 2, h[0], h[1]), ("t", "r", 3, "bad", h[2]), ("t", "r", 5, h[2], h[3])]
    rows = [(*r, f"2024-01-01 00:00:0{i}") for i, r in enumerate(rows)] + [("t", "last", 1, None, "x", "2024-01-02 00:00:00")]
    df = source(rows, "tenant_id string, run_id string, sequence long, previous_event_hash string, event_hash string, occurred_at string")
    got = drain(streams.audit_stream(df), tmp_path, name="chain")
    assert [r["outcome"] for r in sorted(got, key=lambda r: r["sequence"])] == [
        "accepted", "accepted", "previous_hash_invalid", "sequence_invalid",
    ]


def in_batches(spark, tmp_path, name, batches, schema):
    """A stream that takes one file per micro-batch."""
    path = str(tmp_path / name)
    for rows in batches:
        df = spark.createDataFrame(rows, schema)
        df.coalesce(1).write.mode("append").parquet(path)
        time.sleep(0.02)  # files are taken by age
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def moment(seconds):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=seconds)


def dealt(rows, parts, seed):
    rows = list(rows)
    random.Random(seed).shuffle(rows)
    return [rows[i::parts] for i in range(parts)]


def test_chains_in_any_order_over_batches_are_accepted(spark, tmp_path):
    chains, length = 5, 5000
    rows = []
    for c in range(chains):
        digests = [None] + [f"{c}-{i}" for i in range(length)]
        rows += [("t", f"r{c}", i + 1, digests[i], digests[i + 1], moment(i)) for i in range(length)]
    batches = dealt(rows, 5, 1) + [[("t", "last", 1, None, "x", moment(10**6))]]
    schema = "tenant_id string, run_id string, sequence long, previous_event_hash string, event_hash string, occurred_at timestamp"
    df = in_batches(spark, tmp_path, "chains", batches, schema)
    got = drain(streams.audit_stream(df, lateness="3 hours"), tmp_path, name="chains")
    assert len(got) == chains * length == 25_000
    assert {r["outcome"] for r in got} == {"accepted"}


def test_admission_over_batches_equals_one_pass_in_order(spark, tmp_path):
    rng = random.Random(4)
    rows = [(f"u{rng.randrange(4)}", i, moment(rng.randrange(3000))) for i in range(3000)]
    want, recent = {}, {}
    for user, i, ts in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        held = [t for t in recent.get(user, []) if t > ts - datetime.timedelta(seconds=60)]
        want[i] = len(held) < 5
        recent[user] = held + [ts] if want[i] else held
    batches = dealt(rows, 5, 2) + [[("last", i, moment(10**5))] for i in (-1, -3)] + [[("u0", -2, moment(0))]]
    df = in_batches(spark, tmp_path, "adm5", batches, "user string, event_id int, ts timestamp")
    q = (
        streams.admission_stream(df, ["user"], 5, lateness="1 hour").writeStream.format("memory").queryName("adm5")
        .option("checkpointLocation", str(tmp_path / "cp_adm5")).trigger(availableNow=True).start()
    )
    q.awaitTermination(200)
    got = {r["event_id"]: r["admitted"] for r in spark.sql("select * from adm5").collect()}
    assert got == want
    # Two rows wait for the watermark, one came behind it.
    assert ordered.late_rows(q) == 1 and len(got) + 2 + ordered.late_rows(q) == sum(map(len, batches))
    rows_left = [o.numRowsTotal for o in q.lastProgress.stateOperators]
    assert rows_left and rows_left[0] < 20  # idle keys hold nothing


def test_upsert_of_a_new_query_wins_over_a_dead_one(spark, source, tmp_path):
    path = str(tmp_path / "both")
    for n, value in enumerate(["old", "older", "new"]):
        if n < 2:
            df = source([("e", 1, value)], "event_id string, rev int, v string", name="first")
            streams.upsert_stream(df, path, str(tmp_path / "cp_a"), ["event_id"], "rev").awaitTermination(60)
        else:
            df = source([("e", 1, value)], "event_id string, rev int, v string", name="second")
            streams.upsert_stream(df, path, str(tmp_path / "cp_b"), ["event_id"], "rev").awaitTermination(60)
    (row,) = streams.read_upserted(spark, path, ["event_id"], "rev").collect()
    assert row["v"] == "new" and set(row.asDict()) == {"event_id", "rev", "v"}


def test_settlement_within_bound(source, tmp_path):
    calls = source([("a", "2024-01-01 00:00:00"), ("b", "2024-01-01 00:00:00"), ("z", "2024-01-01 02:00:00")], "request_id string, requested_at string", name="calls")
    usage = source([("a", "2024-01-01 00:05:00"), ("b", "2024-01-01 00:06:00"), ("z", "2024-01-01 02:00:00")], "request_id string, provider_at string", name="usage")
    got = drain(streams.settle_stream(calls, usage), tmp_path, name="settle")
    assert {r["request_id"] for r in got if r["settled"]} == {"a", "z"}


def test_coverage_counts(source, tmp_path):
    zero = dict.fromkeys(COUNTERS, 0)
    one = tuple((zero | {"pages_total": 2, "pages_processed": 1, "pages_unprocessed": 1}).values())
    rows = [one + ("r", True, "completed", None, "2024-01-01 00:00:00")]
    rows += [one + ("s", True, "completed", why, f"2024-01-01 00:00:0{i}") for i, why in enumerate(["budget", "time", None])]
    schema = ", ".join(f"{c} long" for c in COUNTERS) + ", run_id string, full_scope boolean, status string, stop_reason string, event_time string"
    got = drain(streams.coverage_stream(source(rows, schema)), tmp_path, "complete", "cov")
    got = {r["run_id"]: r for r in got}
    assert (got["r"]["status"], got["r"]["complete"]) == ("partial", False)
    assert got["s"]["stop_reason"] == "time"


def test_metrics_and_sessions_match_batch(spark, source, tmp_path):
    rows = [("m", float(i), f"2024-01-01 00:{i:02d}:30") for i in range(6)] + [("m", 1.0, "2024-01-01 02:00:00")]
    df = source(rows, "name string, value double, ts string")
    got = drain(streams.metrics_stream(df, "1 minute", "2 minutes"), tmp_path, name="met")
    # Windows behind the watermark are final; the last one stays open.
    assert sorted(r["n"] for r in got) == [2, 2, 2]
    batch = spark.createDataFrame(rows, "run_id string, value double, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    assert sorted(r["n_events"] for r in streams.run_sessions(batch).collect()) == [1, 6]


def test_upsert_is_idempotent_and_tombstones_hide(spark, source, tmp_path):
    df = source([("e1", 1, "a"), ("e1", 2, "b"), ("e2", 1, "c")], "event_id string, rev int, v string")
    path = str(tmp_path / "table")
    for run in (1, 2):  # a replay from scratch leaves the same rows
        streams.upsert_stream(df, path, str(tmp_path / f"cp{run}"), ["event_id"], "rev").awaitTermination(60)
        got = streams.read_upserted(spark, path, ["event_id"], "rev").orderBy("event_id").collect()
        assert [(r["event_id"], r["v"]) for r in got] == [("e1", "b"), ("e2", "c")]
    hidden = spark.createDataFrame([("e1",)], "event_id string")
    rows = drain(streams.visible_stream(df, hidden, ["event_id"]), tmp_path, name="vis")
    assert [r["event_id"] for r in rows] == ["e2"]
