"""Votes, grading, evaluation metrics and run summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimgrove.operators import grading, metrics, rulebook, summary, votes
from workload.common import query, read

_VOTES = """
v AS (SELECT user_id, CAST(ts AS DATE) AS day, event_id % 3 AS replica,
             arg_max(event_type, event_id) AS event_type FROM events GROUP BY ALL)
"""


def _replica_votes(spark, folder):
    """Last event type each of three replicas saw per user and day."""
    return (
        read(spark, folder, "events")
        .groupBy("user_id", F.to_date("ts").alias("day"), (F.col("event_id") % 3).alias("replica"))
        .agg(F.max_by("event_type", "event_id").alias("event_type"))
    )


@query(
    "majority_vote",
    f"""WITH {_VOTES},
    c AS (SELECT user_id, day, event_type, count(*) AS n FROM v GROUP BY ALL),
    r AS (SELECT *, max(n) OVER w AS n_agree, sum(n) OVER w AS n_votes,
                 row_number() OVER (PARTITION BY user_id, day ORDER BY n DESC, event_type DESC) AS rn
          FROM c WINDOW w AS (PARTITION BY user_id, day))
    SELECT user_id, CAST(day AS VARCHAR) AS day, n_agree, CAST(n_votes AS BIGINT) AS n_votes,
           CASE WHEN n_agree >= 2 THEN event_type END AS state,
           n_agree >= 3 AND event_type NOT IN ('unknown', 'conflict') AS confirmable,
           CASE WHEN n_agree < 2 THEN 'NO_MAJORITY' WHEN n_agree <> 3 THEN 'REVIEW' END AS reason
    FROM r WHERE rn = 1""",
)
def majority_vote(spark, folder):
    rows = _replica_votes(spark, folder).withColumnRenamed("event_type", "state")
    out = votes.majority_vote(rows, ["user_id", "day"], ["state"])
    return out.withColumn("day", F.col("day").cast("string"))


@query(
    "unanimity",
    f"""WITH {_VOTES},
    s AS (SELECT user_id, day, event_type,
                 CASE WHEN event_type IN ('view', 'click') THEN 'present'
                      WHEN event_type = 'error' THEN 'unknown' ELSE 'absent' END AS state FROM v),
    g AS (SELECT user_id, day, count(*) AS n_votes, count(DISTINCT event_type) AS d,
                 min(state) AS state, min(event_type) AS one FROM s GROUP BY ALL),
    m AS (SELECT user_id, day, max(n) AS n_agree FROM
            (SELECT user_id, day, event_type, count(*) AS n FROM s GROUP BY ALL) GROUP BY ALL),
    f AS (SELECT g.user_id, g.day, n_agree, n_votes, one,
                 CASE WHEN d > 1 THEN 'conflict' WHEN n_votes < 3 THEN 'unknown'
                      WHEN state = 'present' THEN 'present' ELSE 'unknown' END AS state
          FROM g JOIN m ON g.user_id = m.user_id AND g.day = m.day)
    SELECT user_id, CAST(day AS VARCHAR) AS day, n_agree, n_votes, state,
           CASE WHEN state = 'present' THEN one END AS normalized_value,
           CASE WHEN state <> 'present' THEN 'REVIEW' END AS reason FROM f""",
)
def unanimity(spark, folder):
    state = (
        F.when(F.col("event_type").isin("view", "click"), F.lit("present"))
        .when(F.col("event_type") == "error", F.lit("unknown"))
        .otherwise(F.lit("absent"))
    )
    rows = _replica_votes(spark, folder).select(
        "user_id",
        "day",
        state.alias("state"),
        F.col("event_type").alias("normalized_value"),
        F.lit("bound").alias("binding_hash"),
        F.lit("local_claim").alias("source_scope"),
    )
    out = votes.partial_facts(rows, ["user_id", "day"])
    return out.withColumn("day", F.col("day").cast("string"))


@query(
    "field_agreement",
    f"""WITH {_VOTES}
    SELECT user_id, CAST(day AS VARCHAR) AS day, count(*) AS n_votes,
           count(DISTINCT event_type) AS n_distinct,
           CASE WHEN count(*) <> 3 THEN 'unresolved' WHEN count(DISTINCT event_type) = 1
                THEN 'agreed' ELSE 'conflict' END AS state
    FROM v GROUP BY user_id, day""",
)
def field_agreement(spark, folder):
    rows = _replica_votes(spark, folder)
    out = votes.field_agreement(rows, ["user_id", "day"], "event_type")
    return out.withColumn("day", F.col("day").cast("string"))


# ---------------------------------------------------------------- grading

_GOAL = rulebook.ladder_facts("goal")
_PRIMES = dict(zip(_GOAL, (2, 3, 5, 7, 11, 13, 17, 19)))


def _state_sql(name: str) -> str:
    p = _PRIMES[name]
    return (
        f"CASE (o_orderkey // {p}) % 5 WHEN 0 THEN 'absent' WHEN 1 THEN 'unknown' "
        f"ELSE 'present' END"
    )


def _order_facts(spark, folder):
    """Eight ladder facts per order, their state taken from the order key."""
    entries = []
    for name, p in _PRIMES.items():
        digit = F.floor(F.col("o_orderkey") / p) % 5
        state = (
            F.when(digit == 0, F.lit("absent"))
            .when(digit == 1, F.lit("unknown"))
            .otherwise(F.lit("present"))
        )
        entries.append(F.struct(F.lit(name).alias("name"), state.alias("state")))
    return (
        read(spark, folder, "orders")
        .select("o_orderkey", F.explode(F.array(*entries)).alias("f"))
        .select("o_orderkey", "f.name", "f.state")
    )


def _graded(spark, folder):
    rows = (
        grading.fact_map(_order_facts(spark, folder), ["o_orderkey"])
        .withColumn("track", F.lit("goal"))
    )
    return grading.grade(grading.without_exceptions(rows))


_BITS = ",\n".join(
    f"CASE WHEN {n}_s = 'present' THEN true WHEN {n}_s = 'absent' THEN false "
    f"ELSE (m >> {i}) & 1 = 1 END AS {n}"
    for i, n in enumerate(_GOAL)
)
_STATES = ", ".join(f"{_state_sql(n)} AS {n}_s" for n in _GOAL)
_DISTINCT = ", ".join(f"{n}_s" for n in _GOAL)
_LADDER_SQL = f"""
WITH f AS (SELECT o_orderkey, {_STATES} FROM orders),
d AS (SELECT DISTINCT {_DISTINCT} FROM f),
c AS (SELECT d.*, {_BITS} FROM d CROSS JOIN generate_series(0, 255) AS g(m)),
g AS (SELECT {_DISTINCT}, CASE
        WHEN NOT target_year AND target_metric AND transition_plan THEN 'E1'
        WHEN target_year AND target_metric AND baseline_year AND baseline_value AND scope
             AND org_boundary AND current_progress AND transition_plan THEN 'E3'
        WHEN target_year AND target_metric AND baseline_year AND baseline_value AND scope
             AND org_boundary THEN 'E2'
        WHEN target_year AND target_metric THEN 'E1'
        WHEN NOT target_year AND NOT (target_metric AND transition_plan) THEN 'E0'
      END AS grade FROM c),
k AS (SELECT {_DISTINCT}, count(DISTINCT coalesce(grade, '-')) AS n, min(grade) AS lo,
             max(grade) AS hi, bool_or(grade IS NULL) AS none FROM g GROUP BY ALL),
r AS (SELECT f.o_orderkey, n, lo, hi, none FROM f JOIN k USING ({_DISTINCT}))
"""


@query(
    "grade_ladder",
    _LADDER_SQL
    + """SELECT o_orderkey,
      CASE WHEN n > 1 THEN 'blocked_evidence' WHEN none THEN 'blocked_rule_gap'
           ELSE 'decided' END AS decision_status,
      CASE WHEN n = 1 AND NOT none THEN lo END AS evidence_grade,
      CASE WHEN n > 1 AND NOT none THEN lo END AS grade_floor,
      CASE WHEN n > 1 AND NOT none THEN hi END AS grade_ceiling FROM r""",
)
def grade_ladder(spark, folder):
    """Three-valued goal ladder over every order."""
    return _graded(spark, folder).select(
        "o_orderkey", "decision_status", "evidence_grade", "grade_floor", "grade_ceiling"
    )


def _missing_sql() -> str:
    parts = []
    for element, names in rulebook.ELEMENTS["goal"].items():
        if element in rulebook.TRIGGERS:
            continue
        known = " AND ".join(f"{n}_s <> 'unknown'" for n in names)
        lacking = " OR ".join(f"{n}_s = 'absent'" for n in names)
        parts.append(f"SELECT '{element}' AS element_id, count(*) AS n_claims FROM f WHERE {known} AND ({lacking})")
    return f"WITH f AS (SELECT o_orderkey, {_STATES} FROM orders) " + " UNION ALL ".join(parts)


@query("missing_elements", _missing_sql())
def missing_elements(spark, folder):
    """Claims lacking each goal element."""
    rows = _graded(spark, folder).withColumn("run_id", F.lit(1))
    return summary.missing_by_element(rows, ["run_id"]).drop("run_id")


@query(
    "safe_harbor_checklist",
    """WITH s AS (SELECT o_orderkey, o_orderkey % 4 AS a, (o_orderkey // 4) % 4 AS b FROM orders)
    SELECT o_orderkey, CASE WHEN a = 0 OR b = 0 THEN false
           WHEN a > 1 AND b > 1 THEN true END AS reasonable_basis_documented FROM s""",
)
def safe_harbor_checklist(spark, folder):
    """Two-item checklist with absent, unknown and present items."""
    digit = {
        "assumptions": F.col("o_orderkey") % 4,
        "scenario_or_premises": F.floor(F.col("o_orderkey") / 4) % 4,
    }
    facts = F.map_from_arrays(
        F.array(*[F.lit(n) for n in digit]),
        F.array(
            *[
                F.when(d == 0, F.lit("absent")).when(d == 1, F.lit("unknown")).otherwise(F.lit("present"))
                for d in digit.values()
            ]
        ),
    )
    rows = read(spark, folder, "orders").select(
        "o_orderkey", facts.alias("facts"), F.lit("forward_looking").alias("safe_harbor_category")
    )
    return grading.checklist(rows).select("o_orderkey", "reasonable_basis_documented")


# ---------------------------------------------------------------- evaluation

_PRED = """
p AS (SELECT doc_id, CASE WHEN lang = 'en' OR n_chars > 500
             THEN CASE WHEN n_chars > 2000 THEN '1' ELSE '0' END END AS predicted FROM documents),
g AS (SELECT doc_id, CAST(quality AS VARCHAR) AS expected FROM labels),
j AS (SELECT g.doc_id, expected, predicted FROM g LEFT JOIN p USING (doc_id))
"""


def _labels(spark, folder):
    """(predictions, gold): a length rule against the quality labels."""
    docs = read(spark, folder, "documents")
    answered = (F.col("lang") == "en") | (F.col("n_chars") > 500)
    value = F.when(answered, F.when(F.col("n_chars") > 2000, F.lit("1")).otherwise(F.lit("0")))
    gold = read(spark, folder, "labels").select("doc_id", F.col("quality").cast("string").alias("value"))
    return docs.select("doc_id", value.alias("value")), gold


def _rounded(df):
    return df.withColumn("value", F.round("value", 9))


@query(
    "classification_metrics",
    f"""WITH {_PRED},
    s AS (SELECT 'grade' AS name, expected, predicted FROM j
          UNION ALL SELECT 'grade_selective', expected, predicted FROM j WHERE predicted IS NOT NULL),
    f AS (SELECT name, c, 2.0 * count(*) FILTER (predicted = c AND expected = c) AS tp2,
                 count(*) FILTER (coalesce(predicted = c, false) <> (expected = c)) AS err
          FROM s CROSS JOIN (VALUES ('0'), ('1'), ('2')) AS k(c) GROUP BY ALL),
    m AS (SELECT name, sum(CASE WHEN tp2 + err > 0 THEN tp2 / (tp2 + err) ELSE 0 END) / 3 AS f1
          FROM f GROUP BY name)
    SELECT name || '_accuracy' AS metric,
           round(count(*) FILTER (expected = predicted) / count(*), 9) AS value,
           count(*) AS denominator FROM s GROUP BY name
    UNION ALL
    SELECT name || '_macro_f1', round(f1, 9), (SELECT count(*) FROM s WHERE s.name = m.name) FROM m""",
)
def classification_metrics(spark, folder):
    """Plain and selective accuracy and macro-F1, one declared class being empty."""
    pred, gold = _labels(spark, folder)
    return _rounded(metrics.classification_metrics(pred, gold, ["0", "1", "2"], key=["doc_id"]))


@query(
    "confusion_matrix",
    f"""WITH {_PRED}
    SELECT c AS expected, count(*) FILTER (predicted = '0') AS "0",
           count(*) FILTER (predicted = '1') AS "1", count(*) FILTER (predicted = '2') AS "2"
    FROM (VALUES ('0'), ('1'), ('2')) AS k(c) LEFT JOIN j ON j.expected = c GROUP BY c""",
)
def confusion_matrix(spark, folder):
    pred, gold = _labels(spark, folder)
    return metrics.confusion(pred, gold, ["0", "1", "2"], ["doc_id"])


@query(
    "majority_baseline",
    f"""WITH {_PRED}
    SELECT 'label_majority_baseline' AS metric,
           round((SELECT max(n) FROM (SELECT count(*) AS n FROM j GROUP BY expected)) / count(*), 9) AS value,
           count(*) AS denominator FROM j
    UNION ALL
    SELECT 'automatic_coverage', round(count(predicted) / count(*), 9), count(*) FROM j""",
)
def majority_baseline(spark, folder):
    pred, gold = _labels(spark, folder)
    return _rounded(metrics.baseline(pred, gold, ["doc_id"]))


@query(
    "element_precision_recall",
    """WITH p AS (SELECT doc_id AS claim_id, lang AS element_id,
                         CASE WHEN n_chars > 2000 THEN '1' ELSE '0' END AS v FROM documents),
    g AS (SELECT l.doc_id AS claim_id, d.lang AS element_id, CAST(l.quality AS VARCHAR) AS v
          FROM labels l JOIN documents d ON d.doc_id = l.doc_id),
    m AS (SELECT count(*) AS n FROM p JOIN g USING (claim_id, element_id, v))
    SELECT 'element_precision' AS metric, round((SELECT n FROM m) / count(*), 9) AS value,
           count(*) AS denominator FROM p
    UNION ALL SELECT 'element_recall', round((SELECT n FROM m) / count(*), 9), count(*) FROM g""",
)
def element_precision_recall(spark, folder):
    docs = read(spark, folder, "documents")
    fact = lambda df, v: df.select(
        F.col("doc_id").alias("claim_id"),
        F.col("lang").alias("element_id"),
        v.alias("normalized_value"),
        F.lit(True).alias("valid_source_binding"),
    )
    pred = fact(docs, F.when(F.col("n_chars") > 2000, F.lit("1")).otherwise(F.lit("0")))
    gold = fact(
        read(spark, folder, "labels").join(docs.select("doc_id", "lang"), "doc_id"),
        F.col("quality").cast("string"),
    )
    return _rounded(metrics.element_metrics(pred, gold))


@query(
    "review_grouping_sets",
    """WITH c AS (SELECT d.source AS company_id, d.lang AS task, CAST(l.quality AS VARCHAR) AS label,
                         CASE WHEN d.n_chars > 300 THEN CASE WHEN d.n_chars > 2000 THEN '1' ELSE '0' END END AS prediction
                  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)
    SELECT company_id, task, CAST(grouping(company_id, task) AS BIGINT) AS grouping_id,
           count(*) AS total_cases, count(label) AS reviewed_cases,
           count(*) - count(label) AS unreviewed_cases,
           count(*) FILTER (label = prediction) AS exact_matches,
           count(*) FILTER (label IS NOT NULL AND prediction IS NULL) AS missing_predictions,
           round(CASE WHEN count(label) > 0 THEN count(*) FILTER (label = prediction) / count(label) END, 9) AS agreement,
           round(count(label) / count(*), 9) AS review_coverage
    FROM c GROUP BY GROUPING SETS ((), (company_id), (task))""",
)
def review_grouping_sets(spark, folder):
    """Review agreement overall, by source and by language."""
    n = F.col("n_chars")
    prediction = F.when(n > 300, F.when(n > 2000, F.lit("1")).otherwise(F.lit("0")))
    cases = (
        read(spark, folder, "documents")
        .join(read(spark, folder, "labels"), "doc_id", "left")
        .select(
            F.col("source").alias("company_id"),
            F.col("lang").alias("task"),
            F.col("quality").cast("string").alias("label"),
            prediction.alias("prediction"),
        )
    )
    out = metrics.review_scores(cases)
    return out.withColumns(
        {
            "agreement": F.round("agreement", 9),
            "review_coverage": F.round("review_coverage", 9),
            "grouping_id": F.col("grouping_id").cast("bigint"),
        }
    )


_SPLITS = """
i AS (SELECT CAST(doc_id AS VARCHAR) AS item_id, source AS company_id,
             CASE WHEN n_chars % 10 < 7 THEN 'train' WHEN n_chars % 10 < 9 THEN 'fewshot' ELSE 'test' END AS split,
             CASE WHEN n_chars % 4 = 0 THEN 'review_confirmed' ELSE 'labelled' END AS origin
      FROM documents)
"""


def _items(spark, folder):
    n = F.col("n_chars") % 10
    split = F.when(n < 7, F.lit("train")).when(n < 9, F.lit("fewshot")).otherwise(F.lit("test"))
    origin = F.when(F.col("n_chars") % 4 == 0, F.lit("review_confirmed")).otherwise(F.lit("labelled"))
    return read(spark, folder, "documents").select(
        F.col("doc_id").cast("string").alias("item_id"),
        F.col("source").alias("company_id"),
        split.alias("split"),
        origin.alias("origin"),
    )


@query(
    "split_leakage",
    f"""WITH {_SPLITS}
    SELECT 'company_in_several_splits' AS problem, company_id AS subject, count(DISTINCT split) AS n
    FROM i GROUP BY company_id HAVING count(DISTINCT split) > 1
    UNION ALL SELECT 'duplicate_item', item_id, count(*) FROM i GROUP BY item_id HAVING count(*) > 1
    UNION ALL SELECT 'review_confirmed_outside_fewshot', item_id, 1 FROM i
    WHERE origin = 'review_confirmed' AND split <> 'fewshot'""",
)
def split_leakage(spark, folder):
    return metrics.verify_split(_items(spark, folder))


@query(
    "split_counts",
    f"""WITH {_SPLITS} SELECT split, count(*) AS n_items, count(DISTINCT company_id) AS n_companies
    FROM i GROUP BY split""",
)
def split_counts(spark, folder):
    return metrics.split_counts(_items(spark, folder))


_RUNS = """
a AS (SELECT source AS source_id, doc_id AS char_start, n_chars AS char_end FROM documents WHERE n_chars > 800),
b AS (SELECT source AS source_id, doc_id AS char_start, n_chars AS char_end FROM documents WHERE lang <> 'fr')
"""


def _runs(spark, folder):
    docs = read(spark, folder, "documents")
    span = [F.col("source").alias("source_id"), F.col("doc_id").alias("char_start"), F.col("n_chars").alias("char_end")]
    return docs.filter("n_chars > 800").select(*span), docs.filter("lang <> 'fr'").select(*span)


@query(
    "compare_runs",
    f"""WITH {_RUNS}, s AS (SELECT DISTINCT source AS source_id FROM documents WHERE n_chars > 12000)
    SELECT (SELECT count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM b)) AS exact_span_matches,
           (SELECT count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b)) AS baseline_only,
           (SELECT count(*) FROM (SELECT * FROM b EXCEPT SELECT * FROM a)) AS filtered_only,
           (SELECT count(*) FROM a WHERE source_id NOT IN (SELECT source_id FROM s)) AS baseline_in_deferred_sources""",
)
def compare_runs(spark, folder):
    left, right = _runs(spark, folder)
    sent = read(spark, folder, "documents").filter("n_chars > 12000").select(F.col("source").alias("source_id"))
    return metrics.compare_runs(left, right, sent)


@query(
    "set_ops",
    f"""WITH {_RUNS}
    SELECT 'both' AS part, * FROM (SELECT * FROM a INTERSECT SELECT * FROM b)
    UNION ALL SELECT 'left_only', * FROM (SELECT * FROM a EXCEPT SELECT * FROM b)
    UNION ALL SELECT 'right_only', * FROM (SELECT * FROM b EXCEPT SELECT * FROM a)""",
)
def set_ops(spark, folder):
    left, right = _runs(spark, folder)
    part = lambda df, name: df.withColumn("part", F.lit(name))
    return (
        part(metrics.span_intersect(left, right), "both")
        .unionByName(part(metrics.span_except(left, right), "left_only"))
        .unionByName(part(metrics.span_except(right, left), "right_only"))
    )


# ---------------------------------------------------------------- summaries


@query(
    "run_summary",
    """WITH d AS (SELECT o_custkey AS run_id, CASE o_orderstatus WHEN 'F' THEN 'decided' WHEN 'O' THEN 'blocked_evidence' ELSE 'not_run' END AS st,
                         'E' || (o_orderkey % 4) AS grade, o_orderkey % 3 AS b FROM orders),
    g AS (SELECT run_id, count(*) AS claims,
            count(*) FILTER (st = 'decided' AND grade = 'E0') AS n_e0, count(*) FILTER (st = 'decided' AND grade = 'E1') AS n_e1,
            count(*) FILTER (st = 'decided' AND grade = 'E2') AS n_e2, count(*) FILTER (st = 'decided' AND grade = 'E3') AS n_e3,
            count(*) FILTER (st <> 'decided') AS undecided, count(*) FILTER (b <> 0) AS unverified_basis FROM d GROUP BY run_id),
    q AS (SELECT l_suppkey AS run_id, CASE l_returnflag WHEN 'A' THEN 'N_A' WHEN 'R' THEN 'undetermined' ELSE 'applicable' END AS ap,
                 l_returnflag = 'N' AND l_tax > 0.06 AS deferred,
                 CASE WHEN l_returnflag = 'N' AND l_tax <= 0.06 THEN l_quantity > 25 END AS satisfied FROM lineitem),
    n AS (SELECT run_id, count(*) FILTER (ap = 'applicable' AND NOT deferred) AS applicable,
            count(*) FILTER (satisfied) AS satisfied, count(*) FILTER (ap = 'N_A') AS not_applicable,
            count(*) FILTER (deferred) AS deferred, count(*) FILTER (ap = 'undetermined') AS undetermined FROM q GROUP BY run_id)
    SELECT g.*, coalesce(applicable, 0) AS applicable, coalesce(satisfied, 0) AS satisfied,
           coalesce(not_applicable, 0) AS not_applicable, coalesce(deferred, 0) AS deferred, undetermined,
           round(CASE WHEN applicable > 0 THEN satisfied / applicable END, 9) AS fulfillment_rate
    FROM g LEFT JOIN n USING (run_id)""",
)
def run_summary(spark, folder):
    """Grade counts from orders, requirements from order lines."""
    o = read(spark, folder, "orders")
    status = (
        F.when(F.col("o_orderstatus") == "F", F.lit("decided"))
        .when(F.col("o_orderstatus") == "O", F.lit("blocked_evidence"))
        .otherwise(F.lit("not_run"))
    )
    decisions = o.select(
        F.col("o_custkey").alias("run_id"),
        status.alias("decision_status"),
        F.concat(F.lit("E"), (F.col("o_orderkey") % 4).cast("string")).alias("evidence_grade"),
        F.array(
            F.when(F.col("o_orderkey") % 3 == 0, F.lit("verified")).otherwise(F.lit("unverified"))
        ).alias("basis_statuses"),
    )
    flag = F.col("l_returnflag")
    deferred = (flag == "N") & (F.col("l_tax") > 0.06)
    needs = read(spark, folder, "lineitem").select(
        F.col("l_suppkey").alias("run_id"),
        F.when(flag == "A", F.lit("N_A"))
        .when(flag == "R", F.lit("undetermined"))
        .otherwise(F.lit("applicable"))
        .alias("applicability"),
        deferred.alias("deferred"),
        F.when((flag == "N") & ~deferred, F.col("l_quantity") > 25).alias("satisfied"),
    )
    return summary.summarize(decisions, needs).withColumn(
        "fulfillment_rate", F.round("fulfillment_rate", 9)
    )


@query(
    "coverage_status",
    """WITH t AS (SELECT user_id AS run_id, count(*) AS pages_total,
             count(*) FILTER (event_type IN ('view', 'click')) AS pages_processed,
             count(*) FILTER (event_type = 'error' AND value > 60) AS pages_unreadable,
             count(*) - count(*) FILTER (event_type IN ('view', 'click')) - count(*) FILTER (event_type = 'error' AND value > 60) AS pages_unprocessed
             FROM events GROUP BY user_id),
    s AS (SELECT user_id AS run_id, arg_max(CASE event_type WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' ELSE 'running' END, ts) AS run_status
          FROM events GROUP BY user_id)
    SELECT t.*, run_status, CASE WHEN run_status = 'completed' AND NOT (pages_unreadable = 0 AND pages_unprocessed = 0) THEN 'partial' ELSE run_status END AS status,
           run_status = 'completed' AND pages_unreadable = 0 AND pages_unprocessed = 0 AS complete
    FROM t JOIN s USING (run_id)""",
)
def coverage_status(spark, folder):
    """Page counters of every user's events and the honest run status."""
    e = read(spark, folder, "events")
    seen = F.col("event_type").isin("view", "click")
    broken = (F.col("event_type") == "error") & (F.col("value") > 60)
    one = lambda c: F.when(c, 1).otherwise(0)
    zero = {c: F.lit(0) for c in summary.COUNTERS}
    counters = zero | {
        "pages_total": F.lit(1),
        "pages_processed": one(seen),
        "pages_unreadable": one(broken),
        "pages_unprocessed": one(~seen & ~broken),
    }
    status = (
        F.when(F.col("event_type") == "purchase", F.lit("completed"))
        .when(F.col("event_type") == "error", F.lit("failed"))
        .otherwise(F.lit("running"))
    )
    events = e.select(
        F.col("user_id").alias("run_id"),
        *[v.alias(k) for k, v in counters.items()],
        F.lit(True).alias("full_scope"),
        status.alias("status"),
        F.lit(None).cast("string").alias("stop_reason"),
        F.col("ts").alias("event_time"),
    )
    return summary.coverage(events).select(
        "run_id",
        "pages_total",
        "pages_processed",
        "pages_unreadable",
        "pages_unprocessed",
        "run_status",
        "status",
        "complete",
    )


@query(
    "report_rows",
    """WITH d AS (SELECT o_custkey AS run_id, o_orderkey AS claim_id, o_orderkey % 5 AS rev,
             CASE o_orderstatus WHEN 'F' THEN 'decided' ELSE 'blocked_evidence' END AS st, o_orderkey % 4 AS g FROM orders)
    SELECT run_id, claim_id, rev > 0 AS finished, CASE WHEN rev > 0 THEN st ELSE 'not_run' END AS decision_status,
           CASE WHEN rev > 0 AND st = 'decided' THEN 'E' || g END AS evidence_grade,
           CASE WHEN rev > 0 AND st <> 'decided' THEN 'E0-E' || g END AS grade_range,
           CASE WHEN g = 0 THEN 0 ELSE 2 END AS n_missing,
           CASE WHEN g > 0 THEN 'name the baseline' || chr(10) || 'state the scope' END AS suggestion_text FROM d""",
)
def report_rows(spark, folder):
    """Report row model of every order as a claim."""
    o = read(spark, folder, "orders").select(
        F.col("o_custkey").alias("run_id"), F.col("o_orderkey").alias("claim_id"), "o_orderstatus"
    )
    decided = F.col("o_orderstatus") == "F"
    g = F.col("claim_id") % 4
    decisions = o.select(
        "run_id",
        "claim_id",
        (F.col("claim_id") % 5).alias("decision_revision"),
        F.when(decided, F.lit("decided")).otherwise(F.lit("blocked_evidence")).alias("decision_status"),
        F.when(decided, F.concat(F.lit("E"), g)).alias("evidence_grade"),
        F.lit(None).cast("string").alias("label"),
        F.when(~decided, F.lit("E0")).alias("grade_floor"),
        F.when(~decided, F.concat(F.lit("E"), g)).alias("grade_ceiling"),
        F.when(g > 0, F.array(F.lit("G3"), F.lit("G4"))).otherwise(F.array().cast("array<string>")).alias("missing_elements"),
    )
    texts = spark.createDataFrame(
        [("G3", "name the baseline"), ("G4", "state the scope")], "element_id string, suggestion string"
    )
    out = summary.report_rows(o.select("run_id", "claim_id"), decisions, texts)
    return out.select(
        "run_id",
        "claim_id",
        "finished",
        "decision_status",
        "evidence_grade",
        "grade_range",
        "n_missing",
        F.nullif("suggestion_text", F.lit("")).alias("suggestion_text"),
    )
