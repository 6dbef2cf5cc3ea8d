"""Ledgers, audit records, comparison, regulation and telemetry queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimgrove.functions.canonical import content_hash
from claimgrove.operators import audit, compare, ledger, ordered, regulation, telemetry
from workload.common import cents, query, read

# ---------------------------------------------------------------- comparison


@query(
    "compare_versions",
    """WITH c AS (SELECT year(o_orderdate) AS report_year, o_custkey, o_orderpriority, o_orderkey AS claim_id,
                  sha256(CAST(CAST(round(o_totalprice * 100) AS BIGINT) // 10000000 AS VARCHAR)) AS sha FROM orders),
    p AS (SELECT report_year + 1 AS report_year, o_custkey, o_orderpriority, claim_id, sha FROM c),
    cn AS (SELECT report_year, o_custkey, o_orderpriority, count(*) AS n, min(claim_id) AS id, min(sha) AS sha FROM c GROUP BY ALL),
    pn AS (SELECT report_year, o_custkey, o_orderpriority, count(*) AS n, min(claim_id) AS id, min(sha) AS sha FROM p GROUP BY ALL),
    k AS (SELECT report_year, o_custkey, o_orderpriority, coalesce(cn.n, 0) AS a, coalesce(pn.n, 0) AS b,
                 cn.id AS cid, pn.id AS pid, cn.sha AS csha, pn.sha AS psha
          FROM cn FULL JOIN pn USING (report_year, o_custkey, o_orderpriority))
    SELECT report_year, o_custkey, o_orderpriority, cid AS current_claim_id, pid AS prior_claim_id,
           CASE WHEN b = 0 THEN 'new' WHEN a = 0 THEN 'removed_candidate' ELSE 'modified' END AS change,
           CASE WHEN b = 0 THEN 'target_new_in_current_version' WHEN a = 0 THEN 'target_missing_from_current_version'
                ELSE 'target_content_changed' END AS reason
    FROM k WHERE a <= 1 AND b <= 1 AND (a = 0 OR b = 0 OR csha <> psha)
    UNION ALL SELECT k.report_year, k.o_custkey, k.o_orderpriority, claim_id, NULL, 'ambiguous', 'comparison_key_not_unique'
      FROM k JOIN c USING (report_year, o_custkey, o_orderpriority) WHERE a > 1 OR b > 1
    UNION ALL SELECT k.report_year, k.o_custkey, k.o_orderpriority, NULL, claim_id, 'ambiguous', 'comparison_key_not_unique'
      FROM k JOIN p USING (report_year, o_custkey, o_orderpriority) WHERE a > 1 OR b > 1""",
)
def compare_versions(spark, folder):
    """Orders of every year against the year before, per customer and priority."""
    current = read(spark, folder, "orders").select(
        F.year("o_orderdate").cast("bigint").alias("report_year"),
        "o_custkey",
        "o_orderpriority",
        F.col("o_orderkey").alias("claim_id"),
        content_hash(F.floor(cents("o_totalprice") / 10000000).cast("string")).alias("content_sha256"),
    )
    prior = current.withColumn("report_year", F.col("report_year") + 1)
    return compare.compare_versions(current, prior, ["report_year", "o_custkey", "o_orderpriority"])


_VERSIONS = """
v AS (SELECT o_custkey AS company_id, year(o_orderdate) AS report_year, o_orderpriority AS document_type,
             min(o_orderkey) AS document_version_id, count(*) % 2 = 1 AS approved,
             CASE WHEN o_custkey % 2 = 0 THEN 1 ELSE CASE WHEN min(o_orderkey) % 3 = 0 THEN 4 ELSE 1 END END AS m
      FROM orders GROUP BY o_custkey, year(o_orderdate), o_orderpriority)
"""


@query(
    "prior_version",
    f"""WITH {_VERSIONS},
    f AS (SELECT company_id, min(report_year) AS first_year FROM v WHERE approved GROUP BY 1),
    j AS (SELECT v.*, p.document_version_id AS pid, first_year FROM v
          LEFT JOIN v p ON p.approved AND p.company_id = v.company_id AND p.document_type = v.document_type
                       AND p.report_year + 1 = v.report_year AND p.m = v.m
          LEFT JOIN f ON f.company_id = v.company_id)
    SELECT company_id, report_year, document_type, document_version_id,
           CASE WHEN approved AND pid IS NOT NULL THEN pid END AS prior_document_version_id,
           CASE WHEN approved AND pid IS NOT NULL THEN 'completed' ELSE 'not_run' END AS status,
           CASE WHEN NOT approved THEN 'version_not_approved' WHEN pid IS NOT NULL THEN NULL
                WHEN first_year < report_year THEN 'prior_document_version_not_previous_year'
                ELSE 'prior_document_version_missing' END AS reason FROM j""",
)
def prior_version(spark, folder):
    """Customer-year documents and the version of the year before."""
    versions = (
        read(spark, folder, "orders")
        .groupBy(
            F.col("o_custkey").alias("company_id"),
            F.year("o_orderdate").cast("bigint").alias("report_year"),
            F.col("o_orderpriority").alias("document_type"),
        )
        .agg(
            F.min("o_orderkey").alias("document_version_id"),
            (F.count("*") % 2 == 1).alias("approved"),
        )
    )
    late = (F.col("company_id") % 2 != 0) & (F.col("document_version_id") % 3 == 0)
    month = F.when(late, F.lit(4)).otherwise(F.lit(1))
    versions = versions.withColumns(
        {
            "period_start": F.make_date(F.col("report_year").cast("int"), month, F.lit(1)),
            "period_end": F.date_sub(F.make_date((F.col("report_year") + 1).cast("int"), month, F.lit(1)), 1),
        }
    )
    out = compare.prior_version(versions, ["company_id"])
    return out.drop("approved", "period_start", "period_end")


# ---------------------------------------------------------------- regulation

_TIMELINE = [
    ("t1", "advisory", [], "1995-01-01", "1997-07-01"),
    ("t2", "required", ["O"], "1997-01-01", "1999-01-01"),
    ("t3", "required", ["F"], "1996-06-01", None),
    ("t4", "advisory", [], "2000-03-15", None),
    ("t5", "required", ["F", "P"], "1995-01-01", None),
]
_TIMELINE_SQL = ", ".join(
    f"('{i}', '{o}', {c!r}::VARCHAR[], DATE '{s}', {'NULL::DATE' if e is None else f'DATE {e!r}'})"
    for i, o, c, s, e in _TIMELINE
)


@query(
    "range_timeline",
    f"""WITH e(id, outcome, need, s, x) AS (VALUES {_TIMELINE_SQL}),
    o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, [o_orderstatus] AS have FROM orders),
    j AS (SELECT o_orderkey, count(*) AS n, min(outcome) AS outcome FROM o JOIN e
          ON s <= d AND (x IS NULL OR d < x) AND list_has_all(have, need) GROUP BY 1)
    SELECT o.o_orderkey, coalesce(n, 0) AS n_matches,
           CASE WHEN n = 1 THEN outcome ELSE 'undetermined' END AS outcome
    FROM o LEFT JOIN j USING (o_orderkey)""",
)
def range_timeline(spark, folder):
    """Obligation in force on each order's date under its status."""
    entries = spark.createDataFrame(
        _TIMELINE, "entry_id string, outcome string, condition_ids array<string>, s string, e string"
    ).select(
        "entry_id",
        "outcome",
        "condition_ids",
        F.col("s").cast("date").alias("starts_on"),
        F.col("e").cast("date").alias("ends_before"),
    )
    contexts = read(spark, folder, "orders").select(
        "o_orderkey", F.to_date("o_orderdate").alias("as_of"), F.array("o_orderstatus").alias("condition_ids")
    )
    out = regulation.resolve_timeline(contexts, entries, ["o_orderkey"])
    return out.select("o_orderkey", "n_matches", "outcome")


_INDUSTRY = [
    ("v1", "verified", "KSIC", "BUILDING", "1", "applicable", True),
    ("v1", "verified", "KSIC", "MACHINERY", "1", "applicable", False),
    ("v1", "verified", "KSIC", "MACHINERY", "2", "N_A", None),
    ("v1", "unverified", "KSIC", "FURNITURE", "1", "applicable", True),
]
_INDUSTRY_SQL = ", ".join(
    f"('{c}', '{t}', '{vs}', '{a}', {'NULL::BOOLEAN' if m is None else str(m).lower()})"
    for _, vs, _, c, t, a, m in _INDUSTRY
)


@query(
    "industry_applicability",
    f"""WITH m(code, topic, vs, ap, mand) AS (VALUES {_INDUSTRY_SQL}),
    t AS (SELECT c_custkey, c_mktsegment, CAST(c_nationkey % 3 AS VARCHAR) AS topic_id FROM customer)
    SELECT c_custkey, topic_id, CASE WHEN vs = 'verified' THEN ap ELSE 'undetermined' END AS applicability,
           CASE WHEN vs = 'verified' AND ap = 'applicable' THEN mand END AS mandatory
    FROM t LEFT JOIN m ON code = c_mktsegment AND topic = topic_id""",
)
def industry_applicability(spark, folder):
    mapping = spark.createDataFrame(
        _INDUSTRY,
        "version string, verification_status string, industry_system string, industry_code string, "
        "topic_id string, applicability string, mandatory boolean",
    )
    topics = read(spark, folder, "customer").select(
        "c_custkey",
        F.lit("KSIC").alias("industry_system"),
        F.col("c_mktsegment").alias("industry_code"),
        (F.col("c_nationkey") % 3).cast("string").alias("topic_id"),
    )
    out = regulation.resolve_applicability(topics, mapping)
    return out.select("c_custkey", "topic_id", "applicability", "mandatory")


# ---------------------------------------------------------------- ledger

_PRICES = [
    ("s1", "A", "F", "3.25", "15.5", "0.3", "3.75"),
    ("s2", "N", "O", "1.1", "5.4", "0.11", None),
    ("s3", "N", "F", "0.25", "1.25", "0.03", "0.3"),
]
_PRICE_SQL = ", ".join(
    "('{}', '{}', '{}', {})".format(
        *p[:3],
        ", ".join("NULL::DECIMAL(20,12)" if x is None else f"{x}::DECIMAL(20,12)" for x in p[3:]),
    )
    for p in _PRICES
)
_ATTEMPTS = """
a AS (SELECT l_suppkey AS run_id, l_returnflag AS model_id, l_linestatus AS region, l_linenumber,
       CAST(l_quantity * 1000 AS BIGINT) AS input_tokens, CAST(l_quantity * 37 AS BIGINT) AS output_tokens,
       CAST(l_quantity * 400 AS BIGINT) AS cache_read_tokens,
       CASE WHEN l_tax >= 0.04 THEN CAST(0 AS BIGINT) ELSE CAST(l_quantity * 10 AS BIGINT) END AS cache_write_tokens,
       CASE WHEN l_linenumber = 7 THEN 'released' WHEN l_linenumber = 6 THEN 'dispatched' ELSE 'settled' END AS state,
       l_linenumber % 2 = 0 AS hit, CAST(l_quantity * 1100 AS BIGINT) AS reserved_input FROM lineitem)
"""


def _attempts(spark, folder):
    q = F.col("l_quantity")
    n = F.col("l_linenumber")
    return read(spark, folder, "lineitem").select(
        F.col("l_suppkey").alias("run_id"),
        F.col("l_returnflag").alias("model_id"),
        F.col("l_linestatus").alias("region"),
        F.rint(q * 1000).cast("bigint").alias("input_tokens"),
        F.rint(q * 37).cast("bigint").alias("output_tokens"),
        F.rint(q * 400).cast("bigint").alias("cache_read_tokens"),
        F.when(F.col("l_tax") >= 0.04, F.lit(0)).otherwise(F.rint(q * 10)).cast("bigint").alias("cache_write_tokens"),
        F.when(n == 7, F.lit("released")).when(n == 6, F.lit("dispatched")).otherwise(F.lit("settled")).alias("state"),
        (n % 2 == 0).alias("response_cache_hit"),
        F.rint(q * 1100).cast("bigint").alias("reserved_input"),
        F.rint(q * 30).cast("bigint").alias("reserved_output"),
    )


def _prices(spark):
    raw = spark.createDataFrame(
        _PRICES, "snapshot_id string, model_id string, region string, i string, o string, r string, w string"
    )
    money = lambda c, n: F.col(c).cast("decimal(20,12)").alias(n)
    return raw.select(
        "snapshot_id",
        "model_id",
        "region",
        money("i", "input_per_million"),
        money("o", "output_per_million"),
        money("r", "cache_read_per_million"),
        money("w", "cache_write_per_million"),
    )


@query(
    "cost_ledger",
    f"""WITH {_ATTEMPTS}, p(sid, model_id, region, pi, po, pr, pw) AS (VALUES {_PRICE_SQL}),
    c AS (SELECT a.*, sid,
             (input_tokens - cache_read_tokens - cache_write_tokens) * pi + output_tokens * po + cache_read_tokens * pr
             + CASE WHEN cache_write_tokens = 0 THEN 0 ELSE cache_write_tokens * pw END AS micro
          FROM a LEFT JOIN p USING (model_id, region)),
    s AS (SELECT run_id, coalesce(sum(input_tokens) FILTER (state = 'settled'), 0) AS input_tokens,
             coalesce(sum(output_tokens) FILTER (state = 'settled'), 0) AS output_tokens,
             count(*) FILTER (state IN ('settled', 'dispatched')) AS attempt_count,
             count(*) FILTER (state = 'settled' AND cache_read_tokens > 0) + count(*) FILTER (hit) AS cache_hit_count,
             count(*) FILTER (state <> 'released') AS n_active,
             count(*) FILTER (state = 'settled' AND micro IS NOT NULL) AS n_known,
             sum(micro) FILTER (state = 'settled' AND micro IS NOT NULL) AS micro,
             min(sid) FILTER (state = 'settled') AS lo, max(sid) FILTER (state = 'settled') AS hi,
             count(*) FILTER (state = 'settled' AND sid IS NULL) AS unpriced FROM c GROUP BY run_id)
    SELECT run_id, CAST(input_tokens AS BIGINT) AS input_tokens, CAST(output_tokens AS BIGINT) AS output_tokens,
           attempt_count, cache_hit_count,
           CASE WHEN n_active > 0 AND n_known = n_active THEN round(CAST(micro AS DOUBLE) / 1000000, 6) END AS amount,
           CASE WHEN lo = hi AND unpriced = 0 THEN lo END AS pricing_snapshot_id,
           CASE WHEN n_active > 0 AND n_known = n_active THEN 'known' WHEN n_known > 0 THEN 'partial' ELSE 'unknown_cost' END AS cost_status
    FROM s""",
)
def cost_ledger(spark, folder):
    """Order lines as model calls; amounts only where every price is known."""
    costed = ledger.usage_cost(_attempts(spark, folder), _prices(spark)).withColumnRenamed(
        "snapshot_id", "pricing_snapshot_id"
    )
    out = ledger.cost_summary(costed, ["run_id"])
    return out.withColumn("amount", F.round(F.col("amount").cast("double"), 6))


@query(
    "usage_cost",
    f"""WITH {_ATTEMPTS}, p(sid, model_id, region, pi, po, pr, pw) AS (VALUES {_PRICE_SQL})
    SELECT model_id, region, state, count(*) AS n, count(micro) AS n_known, round(CAST(sum(micro) AS DOUBLE) / 1000000, 6) AS amount
    FROM (SELECT a.*, (input_tokens - cache_read_tokens - cache_write_tokens) * pi + output_tokens * po + cache_read_tokens * pr
             + CASE WHEN cache_write_tokens = 0 THEN 0 ELSE cache_write_tokens * pw END AS micro
          FROM a LEFT JOIN p USING (model_id, region)) GROUP BY ALL""",
)
def usage_cost(spark, folder):
    """Exact cost per model, region and state."""
    costed = ledger.usage_cost(_attempts(spark, folder), _prices(spark))
    return costed.groupBy("model_id", "region", "state").agg(
        F.count("*").alias("n"),
        F.count("cost").alias("n_known"),
        F.round(F.sum("cost").cast("double"), 6).alias("amount"),
    )


@query(
    "budget_usage",
    f"""WITH {_ATTEMPTS}, b AS (SELECT *, CASE WHEN state = 'settled' THEN input_tokens END AS actual FROM a WHERE state <> 'released')
    SELECT run_id, model_id AS role, count(*) AS calls, CAST(sum(coalesce(actual, reserved_input)) AS BIGINT) AS used_input,
           count(*) >= 100 OR sum(coalesce(actual, reserved_input)) >= 3000000 AS exhausted FROM b GROUP BY ALL""",
)
def budget_usage(spark, folder):
    """Calls and tokens per run and role, reserved where not settled."""
    settled = F.col("state") == "settled"
    attempts = _attempts(spark, folder).select(
        "run_id",
        F.col("model_id").alias("role"),
        "state",
        F.when(settled, F.col("input_tokens")).alias("input_tokens"),
        F.lit(0).cast("bigint").alias("output_tokens"),
        "reserved_input",
        "reserved_output",
    )
    limits = spark.createDataFrame(
        [(r, 100, 3_000_000, 10**12) for r in "ANR"],
        "role string, max_calls long, max_input long, max_output long",
    )
    out = ledger.budget_usage(attempts, limits, ["run_id"])
    return out.select("run_id", "role", "calls", "used_input", "exhausted")


@query(
    "billing_interval_join",
    """SELECT a.event_id AS call_id, b.event_id AS billing_id, a.user_id AS user_id
    FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'purchase' AND b.event_type = 'signup'
     AND abs(epoch_us(a.ts) - epoch_us(b.ts)) <= 3600000000""",
)
def billing_interval_join(spark, folder):
    """Purchases within an hour of a signup of the same user."""
    e = read(spark, folder, "events")
    calls = e.filter("event_type = 'purchase'").select(
        F.col("event_id").alias("call_id"), "user_id", F.col("ts").alias("requested_at")
    )
    export = e.filter("event_type = 'signup'").select(
        F.col("event_id").alias("billing_id"), F.col("user_id").alias("owner"), F.col("ts").alias("provider_at")
    )
    out = ledger.match_billing(calls, export, {"user_id": "owner"}, 3600)
    return out.select("call_id", "billing_id", "user_id")


@query(
    "settlement_bound",
    """WITH c AS (SELECT l_suppkey AS run_id, CAST(round(l_extendedprice * 100) AS BIGINT) AS committed,
                    l_linestatus = 'F' AS settled, l_shipdate FROM lineitem),
    b AS (SELECT o_custkey AS run_id, sum(CAST(round(o_totalprice * 100) AS BIGINT)) FILTER (CAST(o_orderdate AS DATE) BETWEEN DATE '1995-01-01' AND DATE '2001-12-31') AS billed,
             count(*) FILTER (NOT CAST(o_orderdate AS DATE) BETWEEN DATE '1995-01-01' AND DATE '2001-12-31') AS outside FROM orders GROUP BY 1),
    l AS (SELECT run_id, sum(committed) AS before, coalesce(sum(committed) FILTER (NOT settled), 0) AS reserved,
             count(*) FILTER (NOT settled) AS affected, CAST(min(l_shipdate) AS DATE) AS earliest FROM c GROUP BY 1),
    r AS (SELECT l.*, billed, CASE WHEN billed IS NULL THEN 'no_billing_evidence' WHEN outside > 0 THEN 'usage_outside_window'
             WHEN DATE '1995-01-01' > earliest THEN 'window_misses_earliest_evidence' WHEN affected = 0 THEN 'nothing_unsettled' END AS reason
          FROM l LEFT JOIN b USING (run_id))
    SELECT run_id, CAST(before AS BIGINT) AS before, CAST(reserved AS BIGINT) AS reserved, CAST(billed AS BIGINT) AS billed, affected,
           CAST(CASE WHEN reason IS NULL THEN before - reserved + billed END AS BIGINT) AS after, reason FROM r""",
)
def settlement_bound(spark, folder):
    """Reserved cents of unsettled lines replaced by the billed total of the window."""
    calls = read(spark, folder, "lineitem").select(
        F.col("l_suppkey").alias("run_id"),
        cents("l_extendedprice").alias("committed"),
        (F.col("l_linestatus") == "F").alias("settled"),
        F.col("l_shipdate").alias("requested_at"),
    )
    bill = read(spark, folder, "orders").select(
        F.col("o_custkey").alias("run_id"),
        F.to_date("o_orderdate").alias("usage_date"),
        cents("o_totalprice").alias("item_cost"),
    )
    return ledger.aggregate_bound(calls, bill, "1995-01-01", "2001-12-31", ["run_id"])


# ---------------------------------------------------------------- audit

_CHAIN = """
n AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS seq FROM events),
h AS (SELECT *, sha256(user_id || ':' || seq || ':' || event_id) AS good FROM n),
s AS (SELECT user_id, seq, event_id, good, CASE WHEN event_id % 97 = 0 THEN sha256('x') ELSE good END AS event_hash FROM h),
c AS (SELECT *, lag(event_hash) OVER w AS lag_hash,
             CASE WHEN event_id % 89 = 0 THEN sha256('y') ELSE lag(event_hash) OVER w END AS prev
      FROM s WINDOW w AS (PARTITION BY user_id ORDER BY seq))
"""


def _chain(spark, folder):
    """Events of each user as a hash chain with planted faults."""
    e = read(spark, folder, "events").select("user_id", "event_id")
    day = F.floor(F.col("event_id") / 2000)
    n = ordered.numbered(e, ["user_id"], ["event_id"], "sequence", day)
    good = content_hash(F.concat_ws(":", "user_id", "sequence", "event_id"))
    n = n.withColumn("good", good).withColumn(
        "event_hash",
        F.when(F.col("event_id") % 97 == 0, content_hash(F.lit("x"))).otherwise(F.col("good")),
    )
    linked = ordered.neighbours(n, ["user_id"], ["sequence"], previous={"p": F.col("event_hash")}, bucket=day)
    previous = F.when(F.col("event_id") % 89 == 0, content_hash(F.lit("y"))).otherwise(F.col("p"))
    return linked.withColumn("previous_event_hash", previous).drop("p")


@query(
    "audit_chain",
    f"""WITH {_CHAIN} SELECT user_id, seq AS sequence, event_id,
           CASE WHEN prev IS DISTINCT FROM lag_hash THEN 'previous_hash_invalid'
                WHEN event_hash <> good THEN 'event_hash_invalid' END AS broken FROM c""",
)
def audit_chain(spark, folder):
    out = audit.verify_chain(_chain(spark, folder), stream=["user_id"], computed=F.col("good"))
    return out.select("user_id", "sequence", "event_id", "broken")


@query(
    "chain_heads",
    f"""WITH {_CHAIN}, l AS (SELECT user_id, max(seq) AS n, arg_max(event_hash, seq) AS h FROM c GROUP BY 1)
    SELECT user_id, n = 60 + user_id % 10 OR user_id % 2 = 0 AS head_reached FROM l""",
)
def chain_heads(spark, folder):
    """Streams that reach the head recorded for them."""
    chain = _chain(spark, folder)
    last = chain.groupBy("user_id").agg(
        F.max("sequence").alias("n"), F.max_by("event_hash", "sequence").alias("head_hash")
    )
    heads = last.select(
        "user_id",
        F.when(F.col("user_id") % 2 == 0, F.col("n")).otherwise(60 + F.col("user_id") % 10).alias("head_sequence"),
        "head_hash",
    )
    return audit.chain_heads(chain, heads, ["user_id"])


@query(
    "latest_head",
    """SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey,
              arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS o_orderstatus FROM orders GROUP BY o_custkey""",
)
def latest_head(spark, folder):
    """Latest order of each customer."""
    o = read(spark, folder, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_orderdate")
    return ordered.latest(o, ["o_custkey"], ["o_orderdate", "o_orderkey"]).drop("o_orderdate")


@query(
    "first_by",
    """SELECT l_orderkey, min(l_suppkey) AS source_id FROM lineitem WHERE l_returnflag = 'N' GROUP BY 1""",
)
def first_by(spark, folder):
    """Smallest verified source of each key."""
    from claimgrove.operators.claims import first_verified

    refs = read(spark, folder, "lineitem").select(
        "l_orderkey",
        F.col("l_suppkey").alias("source_id"),
        F.when(F.col("l_returnflag") == "N", F.lit("verified")).otherwise(F.lit("rejected")).alias("verification_state"),
    )
    return first_verified(refs, ["l_orderkey"])


@query(
    "revision_continuity",
    """SELECT conv_id, turn, turn + 1 + CASE WHEN turn > 2 AND conv_id % 3 = 0 THEN 1 ELSE 0 END AS revision,
              turn > 2 AND conv_id % 3 = 0 AND turn = 3 AS gap FROM conversations""",
)
def revision_continuity(spark, folder):
    """Turns as revisions, one skipped in every third conversation."""
    skip = F.when((F.col("turn") > 2) & (F.col("conv_id") % 3 == 0), 1).otherwise(0)
    rows = read(spark, folder, "conversations").select(
        "conv_id", "turn", (F.col("turn") + 1 + skip).alias("revision")
    )
    return audit.continuity(rows, ["conv_id"], "revision")


@query(
    "sliding_limit",
    """SELECT event_id, count(*) OVER w AS n_recent, count(*) OVER w > 3 AS excess FROM
       (SELECT event_id, user_id, epoch_us(ts) AS t FROM events)
       WINDOW w AS (PARTITION BY user_id ORDER BY t RANGE BETWEEN 21599999999 PRECEDING AND CURRENT ROW)""",
)
def sliding_limit(spark, folder):
    """Events of a user within six hours, flagged above three."""
    e = read(spark, folder, "events").select("event_id", "user_id", "ts")
    return audit.sliding_excess(e, ["user_id"], "ts", 6 * 3600, 3).select("event_id", "n_recent", "excess")


@query(
    "tombstones",
    """SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)""",
)
def tombstones(spark, folder):
    """Documents that are not tombstoned by their label."""
    deleted = read(spark, folder, "labels").filter("toxic = 1")
    return audit.exclude_deleted(read(spark, folder, "documents"), deleted, ["doc_id"]).select("doc_id", "lang")


@query(
    "retention",
    """WITH p AS (SELECT c_custkey, 'p' || c_nationkey AS policy_id, c_acctbal > 0 AS approved,
                    c_mktsegment = 'BUILDING' AS hold, c_custkey * 10 AS until FROM customer WHERE c_nationkey < 20)
    SELECT c.c_custkey, p.policy_id, coalesce(approved AND NOT hold AND until <= 5000, false) AS eligible,
           CASE WHEN p.policy_id IS NULL THEN 'policy_missing' WHEN NOT approved THEN 'policy_not_approved'
                WHEN hold THEN 'legal_hold' WHEN until > 5000 THEN 'retained' END AS blocked_reason
    FROM customer c LEFT JOIN p USING (c_custkey)""",
)
def retention(spark, folder):
    c = read(spark, folder, "customer")
    policies = c.filter("c_nationkey < 20").select(
        "c_custkey",
        F.concat(F.lit("p"), "c_nationkey").alias("policy_id"),
        (F.col("c_acctbal") > 0).alias("approved"),
        (F.col("c_mktsegment") == "BUILDING").alias("legal_hold"),
        (F.col("c_custkey") * 10).alias("retain_until"),
    )
    return audit.retention(c.select("c_custkey"), policies, 5000, ["c_custkey"])


# ---------------------------------------------------------------- telemetry

_KEY = b"telemetry-test-key"
_INNER = bytes(b ^ 0x36 for b in _KEY.ljust(64, b"\0")).hex()
_OUTER = bytes(b ^ 0x5C for b in _KEY.ljust(64, b"\0")).hex()


@query(
    "sanitize_events",
    f"""SELECT event_id, CASE WHEN event_type IN ('view', 'click', 'purchase') THEN event_type ELSE 'unknown' END AS event,
           CASE WHEN value >= 0 AND value <= 9007199254740992 THEN value END AS latency_ms,
           CASE WHEN event_id % 700 BETWEEN 100 AND 599 THEN event_id % 700 END AS http_status,
           sha256(from_hex('{_OUTER}') || from_hex(sha256(from_hex('{_INNER}') || CAST(user_id AS VARCHAR)::BLOB))) AS tenant_hash
    FROM events""",
)
def sanitize_events(spark, folder):
    """Closed vocabulary, bounded numbers and keyed hashes of user ids."""
    e = read(spark, folder, "events").select(
        "event_id",
        F.col("event_type").alias("event"),
        F.col("value").alias("latency_ms"),
        (F.col("event_id") % 700).alias("http_status"),
        F.col("user_id").cast("string").alias("tenant"),
    )
    return telemetry.sanitize_events(
        e,
        _KEY,
        {"event": ["view", "click", "purchase"]},
        identifiers=["tenant"],
        latency="latency_ms",
        http_status="http_status",
    )


@query(
    "event_metrics",
    """WITH m AS (SELECT ts, event_type, 'api_requests_total' AS name, CAST(100 AS BIGINT) AS v FROM events WHERE event_type = 'view'
       UNION ALL SELECT ts, event_type, 'api_latency_ms', CAST(round(value * 100) AS BIGINT) FROM events WHERE event_type = 'view'
       UNION ALL SELECT ts, event_type, 'model_tokens', 100 * (event_id % 7 + 1) FROM events
       UNION ALL SELECT ts, event_type, 'lease_lost_total', 100 FROM events WHERE event_type = 'error')
    SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M:%S') AS window_start, name, event_type AS stage,
           count(*) AS n, round(sum(v) / 100, 2) AS total, round(max(v) / 100, 2) AS peak FROM m GROUP BY ALL""",
)
def event_metrics(spark, folder):
    """Emitted metrics in tumbling hours."""
    kind = F.col("event_type")
    e = read(spark, folder, "events").select(
        "ts",
        kind.alias("stage"),
        F.when(kind == "view", F.lit("api_request")).otherwise(F.lit("other")).alias("event"),
        F.when(kind == "error", F.lit("LEASE_LOST")).otherwise(F.lit("OK")).alias("code"),
        F.col("value").alias("latency_ms"),
        (F.col("event_id") % 7).alias("input_tokens"),
        F.lit(1).cast("bigint").alias("output_tokens"),
    )
    out = telemetry.rollup_metrics(telemetry.metrics(e), ["stage"], "1 hour")
    return out.select(
        F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"),
        "name",
        "stage",
        "n",
        F.round("total", 2).alias("total"),
        F.round("peak", 2).alias("peak"),
    )
