"""Run summaries, coverage roll-ups, quality counts and report rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimgrove.operators.rulebook import GRADES, LABELS

RUN = ("run_id",)
COUNTERS = (
    "pages_total",
    "pages_processed",
    "pages_unreadable",
    "pages_unprocessed",
    "chunks_discovered",
    "chunks_processed",
    "claims_discovered",
    "claims_decided",
    "claims_needs_review",
)
RUN_STATUSES = ("queued", "running", "partial", "completed", "failed", "cancelled")


def summarize(
    decisions: DataFrame, requirements: DataFrame, run: Sequence[str] = RUN
) -> DataFrame:
    """One row per run: zero-filled grade counts, undecided, N/A, deferred, fulfilment.

    Unfinished work is never a grade; the rate is null when nothing applies.
    Both inputs collapse to one row per run before they meet.
    """
    run = list(run)
    decided = F.col("decision_status") == "decided"
    unverified = F.size(
        F.filter(
            F.coalesce("basis_statuses", F.array().cast("array<string>")),
            lambda s: s != "verified",
        )
    )
    graded = decisions.groupBy(*run).agg(
        F.count("*").alias("claims"),
        *[
            F.count_if(F.coalesce(decided & (F.col("evidence_grade") == g), F.lit(False))).alias(
                f"n_{g.lower()}"
            )
            for g in GRADES
        ],
        F.count_if(~F.coalesce(decided, F.lit(False))).alias("undecided"),
        F.sum(unverified).alias("unverified_basis"),
    )
    applies = (F.col("applicability") == "applicable") & ~F.col("deferred")
    needs = requirements.groupBy(*run).agg(
        F.count_if(applies).alias("applicable"),
        F.count_if(F.coalesce("satisfied", F.lit(False))).alias("satisfied"),
        F.count_if(F.col("applicability") == "N_A").alias("not_applicable"),
        F.count_if("deferred").alias("deferred"),
        F.count_if(F.col("applicability") == "undetermined").alias("undetermined"),
    )
    return graded.join(needs, run, "left").select(
        *run,
        "claims",
        *[f"n_{g.lower()}" for g in GRADES],
        "undecided",
        "unverified_basis",
        *[F.coalesce(c, F.lit(0)).alias(c) for c in ("applicable", "satisfied", "not_applicable", "deferred")],
        "undetermined",
        F.try_divide(F.col("satisfied"), F.when(F.col("applicable") > 0, F.col("applicable"))).alias(
            "fulfillment_rate"
        ),
    )


def missing_by_element(decisions: DataFrame, run: Sequence[str] = RUN) -> DataFrame:
    """Claims per run and missing element (an element counts once per claim)."""
    return (
        decisions.select(*run, F.explode(F.array_distinct("missing_elements")).alias("element_id"))
        .groupBy(*run, "element_id")
        .agg(F.count("*").alias("n_claims"))
    )


def decision_violations(decisions: DataFrame) -> DataFrame:
    """Decisions whose grade and label do not belong to their status."""
    labels = F.create_map(*[F.lit(x) for pair in LABELS.items() for x in pair])
    decided = F.col("decision_status") == "decided"
    ok = F.when(
        decided,
        F.coalesce(labels[F.col("evidence_grade")] == F.col("label"), F.lit(False)),
    ).otherwise(F.col("evidence_grade").isNull() & F.col("label").isNull())
    return decisions.filter(~ok)


def coverage(events: DataFrame, run: Sequence[str] = RUN) -> DataFrame:
    """Sum counter increments per run and derive the honest status.

    `events`: run, the nine counters (increments), full_scope, status, stop_reason,
    event_time. `complete` needs the full scope and closed counters; a completed
    run with open counters is only partial.
    """
    run = list(run)
    totals = events.groupBy(*run).agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in COUNTERS],
        F.bool_and("full_scope").alias("full_scope"),
        F.max_by("status", "event_time").alias("run_status"),
        F.max_by("stop_reason", F.when(F.col("stop_reason").isNotNull(), F.col("event_time"))).alias(
            "stop_reason"
        ),
    )
    return coverage_status(totals)


def coverage_status(totals: DataFrame) -> DataFrame:
    """Status, completeness and violations of rows that carry the nine counters."""
    c = F.col
    handled = c("claims_decided") + c("claims_needs_review")
    closed = (
        (c("pages_unreadable") == 0)
        & (c("pages_unprocessed") == 0)
        & (c("chunks_processed") == c("chunks_discovered"))
        & (handled == c("claims_discovered"))
    )
    status = F.when(
        F.coalesce(c("stop_reason") == "BUDGET_EXHAUSTED", F.lit(False))
        | ((c("run_status") == "completed") & c("full_scope") & ~closed),
        F.lit("partial"),
    ).otherwise(c("run_status"))
    violations = F.array_compact(
        F.array(
            F.when(~c("run_status").isin(*RUN_STATUSES), F.lit("status_unknown")),
            F.when(
                c("pages_processed") + c("pages_unreadable") + c("pages_unprocessed")
                != c("pages_total"),
                F.lit("pages_do_not_partition"),
            ),
            F.when(
                c("chunks_processed") > c("chunks_discovered"), F.lit("chunks_exceed_discovered")
            ),
            F.when(handled > c("claims_discovered"), F.lit("claims_exceed_discovered")),
        )
    )
    return totals.withColumns(
        {
            "violations": violations,
            "status": status,
            "complete": (status == "completed") & c("full_scope") & closed,
        }
    )


def quality_rollup(
    blocks: DataFrame, issues: DataFrame, page: Sequence[str] = ("tenant_id", "document_version_id", "page_num")
) -> DataFrame:
    """Blocks by quality and open issues per page."""
    page = list(page)
    counts = blocks.groupBy(*page).agg(
        F.count("*").alias("n_blocks"),
        *[
            F.count_if(F.col("quality") == q).alias(f"n_{q}")
            for q in ("verified", "unverified", "conflicted", "unreadable", "unlocated")
        ],
    )
    open_ = issues.groupBy(*page).agg(
        F.count_if(F.col("state") == "open").alias("open_issues"),
        F.count_if(F.col("state") == "unreadable").alias("unreadable_issues"),
    )
    return counts.join(open_, page, "full").na.fill(0)


def issue_counts(issues: DataFrame, by: Sequence[str]) -> DataFrame:
    """Issues per page, kind and state with document subtotals (rollup)."""
    return issues.rollup(*by).agg(
        F.grouping_id(*by).alias("grouping_id"), F.count("*").alias("n_issues")
    )


def report_rows(
    claims: DataFrame, decisions: DataFrame, suggestions: DataFrame, key: Sequence[str] = ("run_id", "claim_id")
) -> DataFrame:
    """Report row per claim: decision or unfinished, grade range, missing suggestions.

    `suggestions` is the fixed text per missing element (element_id, suggestion).
    """
    key = list(key)
    joined = claims.join(decisions, key, "left")
    finished = F.col("decision_revision") > 0
    missing = F.coalesce("missing_elements", F.array().cast("array<string>"))
    texts = (
        decisions.select(*key, F.explode("missing_elements").alias("element_id"))
        .join(suggestions, "element_id")
        .groupBy(*key)
        # At most one suggestion per rule element.
        .agg(F.array_sort(F.collect_set(F.struct("element_id", "suggestion"))).alias("__s"))
    )
    has_range = (F.col("decision_status") == "blocked_evidence") & F.col("grade_floor").isNotNull()
    return joined.join(texts, key, "left").select(
        *claims.columns,
        F.coalesce(finished, F.lit(False)).alias("finished"),
        F.coalesce(F.when(finished, F.col("decision_status")), F.lit("not_run")).alias(
            "decision_status"
        ),
        F.when(finished, F.col("evidence_grade")).alias("evidence_grade"),
        F.when(finished, F.col("label")).alias("label"),
        F.when(finished & has_range, F.concat_ws("-", "grade_floor", "grade_ceiling")).alias(
            "grade_range"
        ),
        F.size(missing).alias("n_missing"),
        F.array_join(F.transform("__s", lambda s: s["suggestion"]), "\n").alias("suggestion_text"),
    )


def report_totals(rows: DataFrame, run: Sequence[str] = RUN) -> DataFrame:
    """Finished, unfinished and partial flag per run."""
    return rows.groupBy(*run).agg(
        F.count("*").alias("claims"),
        F.count_if(~F.col("finished")).alias("unfinished"),
        F.count_if(F.col("decision_status") == "decided").alias("decided"),
        F.bool_or(~F.col("finished") | (F.col("decision_status") != "decided")).alias("partial"),
    )
