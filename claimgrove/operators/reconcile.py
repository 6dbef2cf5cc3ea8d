"""Reconciliation of sustainability and financial disclosures (items C1 to C4).

One row per (claim, item). Sides, context and search state are nested structs;
policy and registries are small joined tables. Every ladder is one ordered
expression, evaluated without a shuffle.

Row columns (all nullable unless a gate needs them):
  item, synthetic, comparability, claim_track, trigger_elements,
  s/f STRUCT<raw, normalized, kind, unit, source_id>,
  s_set/f_set ARRAY<STRING>, s_period/f_period STRUCT<start,end DATE>,
  s_amount/f_amount DECIMAL, period / fin_period STRUCT<start,end DATE>,
  consolidation, explanation_source_id, search_state,
  c3 STRUCT<currency, capex_account_ids, commitment_source_id, funding_plan_source_id,
            target_start, target_end, capex_start, capex_end>,
  c4 STRUCT<definition_source_ids, calculation_source_ids>,
  policy STRUCT<approved, current_stage, synthetic_only, enabled_items,
                c3_account_mapping_approved, allowed_capex_account_ids, c3_threshold,
                c4_required_explanations>.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimgrove.functions.arrays import first_reason, is_subset, ordered_distinct, violations
from claimgrove.functions.text import is_blank
from claimgrove.operators.claims import DOC

# --- fixed values: kinds, states and enums ----------------------------------------------
ITEMS = ("C1", "C2", "C3", "C4")
SET_KINDS = ("entity_set", "facility_set")
COMPARABILITY = ("comparable", "not_comparable", "unknown")
SEARCH_STATES = ("complete", "incomplete", "not_run")
EXPLANATION_REASONS = {
    "definition": ("definition_not_found", "definition_source_ids"),
    "calculation_basis": ("calculation_basis_not_found", "calculation_source_ids"),
}
# --- end of fixed values ------------------------------------------------------------------

_IDS = "array<string>"


def outcome(state: str, status: str | None, *reasons: str, sources: Column | None = None) -> Column:
    empty = F.array().cast(_IDS)
    return F.struct(
        F.lit(state).alias("execution_state"),
        F.lit(status).cast("string").alias("status"),
        F.array(*[F.lit(r) for r in reasons]).cast(_IDS).alias("reason_codes"),
        (empty if sources is None else sources).alias("extra_source_ids"),
        F.lit(None).cast("string").alias("explanation_source_id"),
    )


def blocked(reason: str, sources: Column | None = None) -> Column:
    return outcome("blocked", None, reason, sources=sources)


def completed(status: str, *reasons: str, sources: Column | None = None) -> Column:
    return outcome("completed", status, *reasons, sources=sources)


def difference(explained: str) -> Column:
    """Two sides differ: explained, needs an explanation, or the search is open."""
    explanation = F.col("explanation_source_id")
    matched = F.struct(
        F.lit("completed").alias("execution_state"),
        F.lit("matched").alias("status"),
        F.array(F.lit(explained)).alias("reason_codes"),
        F.array(explanation).alias("extra_source_ids"),
        explanation.alias("explanation_source_id"),
    )
    return (
        F.when(explanation.isNotNull(), matched)
        .when(
            F.col("search_state") == "complete",
            completed("needs_explanation", "explanation_not_found"),
        )
        .otherwise(blocked("search_incomplete"))
    )


def _ladder(*steps: tuple[Column, Column]) -> Column:
    return F.coalesce(*[F.when(F.coalesce(c, F.lit(False)), value) for c, value in steps])


_UNRESOLVED = "value_unresolved"


def _unresolved() -> Column:
    return F.col("s.normalized").isNull() | F.col("f.normalized").isNull()


def boundary_set() -> Column:
    """Equal verified entity sets of one period and consolidation basis."""
    period, fin = F.col("period"), F.col("fin_period")
    open_period = period["start"].isNull() | period["end"].isNull() | fin["start"].isNull() | fin["end"].isNull()
    differ = (period["start"] != fin["start"]) | (period["end"] != fin["end"])
    s_set, f_set = F.col("s_set"), F.col("f_set")
    equal = is_subset(s_set, f_set) & is_subset(f_set, s_set)
    return _ladder(
        (~F.col("s.kind").isin(*SET_KINDS), blocked("kind_mismatch")),
        (_unresolved(), blocked(_UNRESOLVED)),
        (open_period, blocked("c1_period_unresolved")),
        (differ, blocked("c1_period_mismatch")),
        (F.col("consolidation") == "unknown", blocked("c1_consolidation_unknown")),
        (
            (F.coalesce(F.size(s_set), F.lit(0)) <= 0) | (F.coalesce(F.size(f_set), F.lit(0)) <= 0),
            blocked("entity_set_empty"),
        ),
        (equal, completed("matched", "same_verified_entity_set")),
        (F.lit(True), difference("difference_explained")),
    )


def reporting_period() -> Column:
    """Calendar periods; activity outside the reporting window does not apply."""
    s, f, window = F.col("s_period"), F.col("f_period"), F.col("period")
    outside = (s["end"] < window["start"]) | (s["start"] > window["end"])
    return _ladder(
        (F.col("s.kind") != "period", blocked("kind_mismatch")),
        (_unresolved(), blocked(_UNRESOLVED)),
        (
            window["start"].isNotNull() & window["end"].isNotNull() & outside,
            completed("not_applicable", "period_out_of_scope"),
        ),
        ((s["start"] == f["start"]) & (s["end"] == f["end"]), completed("matched", "same_period")),
        (F.lit(True), difference("period_difference_explained")),
    )


def commitment_within_capex() -> Column:
    """Commitment <= threshold * capex, tested as an exact multiplication."""
    c3, policy, fin = F.col("c3"), F.col("policy"), F.col("fin_period")
    extra = ordered_distinct(F.array(c3["commitment_source_id"], c3["funding_plan_source_id"]))
    allowed, asked = policy["allowed_capex_account_ids"], c3["capex_account_ids"]
    mapped = (
        policy["c3_account_mapping_approved"]
        & (F.size(allowed) > 0)
        & (F.size(asked) > 0)
        & is_subset(asked, allowed)
    )
    commitment, capex = F.col("s_amount"), F.col("f_amount")
    ceiling = F.try_multiply(policy["c3_threshold"], capex)
    within = commitment <= ceiling
    applies = (F.col("claim_track") == "goal") & F.array_contains(
        "trigger_elements", "currency_amount"
    )
    open_period = (
        c3["target_start"].isNull()
        | c3["target_end"].isNull()
        | c3["capex_start"].isNull()
        | c3["capex_end"].isNull()
        | fin["start"].isNull()
        | fin["end"].isNull()
    )
    other_period = (c3["capex_start"] != fin["start"]) | (c3["capex_end"] != fin["end"])
    inner = _ladder(
        (
            ~F.coalesce(applies, F.lit(False)),
            completed("not_applicable", "c3_trigger_absent"),
        ),
        (F.col("s.kind") != "currency_amount", blocked("kind_mismatch", extra)),
        (_unresolved(), blocked(_UNRESOLVED, extra)),
        (
            ~(
                F.col("s.unit").eqNullSafe(c3["currency"])
                & F.col("f.unit").eqNullSafe(c3["currency"])
            ),
            blocked("c3_currency_mismatch", extra),
        ),
        (~F.coalesce(mapped, F.lit(False)), blocked("c3_policy_unapproved", extra)),
        (open_period, blocked("c3_period_unresolved", extra)),
        (other_period, blocked("c3_capex_period_mismatch", extra)),
        (commitment.isNull() | capex.isNull(), blocked("precision_exceeded", extra)),
        (commitment <= 0, blocked("c3_commitment_not_positive", extra)),
        (capex <= 0, blocked("c3_capex_not_positive", extra)),
        (
            c3["commitment_source_id"].isNotNull(),
            completed("matched", "commitment_disclosed", sources=extra),
        ),
        (policy["c3_threshold"].isNull(), blocked("c3_policy_unapproved", extra)),
        (ceiling.isNull(), blocked("precision_exceeded", extra)),
        (within, completed("matched", "capex_within_threshold", sources=extra)),
    )
    explained = difference("difference_explained")
    with_extra = explained.withField(
        "extra_source_ids", F.concat(extra, explained["extra_source_ids"])
    )
    return F.coalesce(inner, with_extra)


def classification_basis() -> Column:
    """C4: a definition and a calculation basis are disclosed."""
    c4, required = F.col("c4"), F.col("policy.c4_required_explanations")
    cited, missing = F.array().cast(_IDS), F.array().cast(_IDS)
    for name, (reason, column) in EXPLANATION_REASONS.items():
        wanted = F.array_contains(required, name)
        ids = F.coalesce(c4[column], F.array().cast(_IDS))
        cited = F.concat(cited, F.when(wanted, ids).otherwise(F.array().cast(_IDS)))
        missing = F.concat(
            missing,
            F.when(wanted & (F.size(ids) == 0), F.array(F.lit(reason))).otherwise(
                F.array().cast(_IDS)
            ),
        )
    cited = F.array_distinct(cited)
    needs = completed("needs_explanation", sources=cited).withField("reason_codes", missing)
    return _ladder(
        (F.col("s.kind") != "classification", blocked("kind_mismatch")),
        (_unresolved(), blocked(_UNRESOLVED)),
        (
            F.size(missing) == 0,
            completed("matched", "classification_basis_present", sources=cited),
        ),
        (F.col("search_state") != "complete", blocked("search_incomplete", cited)),
        (F.lit(True), needs),
    )


def reconcile(rows: DataFrame) -> DataFrame:
    """Gate the policy, comparability and kinds, then decide the row's item."""
    policy = F.col("policy")
    by_item = (
        F.when(F.col("item") == "C1", boundary_set())
        .when(F.col("item") == "C2", reporting_period())
        .when(F.col("item") == "C3", commitment_within_capex())
        .when(F.col("item") == "C4", classification_basis())
        .otherwise(blocked("item_not_enabled"))
    )
    decided = _ladder(
        (~F.coalesce(policy["approved"], F.lit(False)), blocked("policy_unapproved")),
        (policy["current_stage"] != 1, blocked("stage_not_supported")),
        (
            policy["synthetic_only"] & ~F.col("synthetic"),
            blocked("synthetic_policy_real_packet"),
        ),
        (
            ~F.array_contains(policy["enabled_items"], F.col("item")),
            blocked("item_not_enabled"),
        ),
        (
            F.col("comparability") == "not_comparable",
            completed("not_applicable", "not_comparable"),
        ),
        (F.col("comparability") == "unknown", blocked("comparability_unknown")),
        (~F.col("s.kind").eqNullSafe(F.col("f.kind")), blocked("kind_mismatch")),
        (F.col("s.kind") == "unknown", blocked(_UNRESOLVED)),
        (F.lit(True), by_item),
    )
    out = rows.withColumn("__o", decided)
    return out.select(
        *rows.columns,
        F.col("__o.execution_state").alias("execution_state"),
        F.col("__o.status").alias("status"),
        (F.col("__o.execution_state") != "completed").alias("review_required"),
        F.col("__o.reason_codes").alias("reason_codes"),
        ordered_distinct(
            F.array(F.col("s.source_id"), F.col("f.source_id")), F.col("__o.extra_source_ids")
        ).alias("source_ids"),
        F.col("__o.explanation_source_id").alias("outcome_explanation_id"),
    )


# ---------------------------------------------------------------- contracts


def packet_violations(rows: DataFrame) -> DataFrame:
    """Contract checks of a row as a list of failed rules (empty = valid).

    References (`explanation_source_id`, the claim's source, both facts) must be
    among the packet's `known_source_ids`.
    """
    known = F.col("known_source_ids")
    in_known = lambda c: c.isNull() | F.array_contains(known, c)
    ordered = lambda c: c["start"].isNull() | c["end"].isNull() | (c["start"] <= c["end"])
    paired = lambda c: c["start"].isNull() == c["end"].isNull()
    unique = lambda c: c.isNull() | (F.size(c) == F.size(F.array_distinct(c)))
    no_blank = lambda c: c.isNull() | ~F.exists(c, lambda e: e.isNull() | is_blank(e))
    search = F.col("search")
    complete = search["state"] == "complete"
    checks = (
        (F.col("item").isin(*ITEMS), "item_unknown"),
        (F.col("synthetic").isNotNull(), "synthetic_required"),
        (F.col("comparability").isin(*COMPARABILITY), "comparability_unknown_value"),
        (F.col("claim_id").isNotNull() & ~is_blank(F.col("claim_id")), "claim_id_required"),
        (ordered(F.col("period")) & paired(F.col("period")), "period_order"),
        (ordered(F.col("fin_period")) & paired(F.col("fin_period")), "financial_period_order"),
        (unique(known) & no_blank(known) & (F.size(known) > 0), "sources_not_unique"),
        (in_known(F.col("s.source_id")) & in_known(F.col("f.source_id")), "fact_source_unknown"),
        (in_known(F.col("explanation_source_id")), "explanation_source_unknown"),
        (in_known(F.col("claim_source_id")), "claim_source_unknown"),
        (unique(F.col("trigger_elements")), "triggers_not_unique"),
        (search["state"].isin(*SEARCH_STATES), "search_state_unknown"),
        (~complete | (F.size(search["failed_document_ids"]) == 0), "complete_search_has_failures"),
        (~complete | search["coverage_policy_id"].isNotNull(), "complete_search_without_policy"),
        (~complete | search["receipt_id"].isNotNull(), "complete_search_without_receipt"),
        (~complete | (F.size(search["required_document_ids"]) > 0), "complete_search_without_documents"),
        ((F.col("item") != "C3") | F.col("c3").isNotNull(), "c3_context_required"),
        ((F.col("item") != "C4") | F.col("c4").isNotNull(), "c4_context_required"),
    )
    return rows.withColumn("violations", violations(*checks))


def check_documents(sources: DataFrame, registry: DataFrame) -> DataFrame:
    """Sources with the first registry check they fail, null when all hold.

    `sources` carry source_id, document_id, artifact_sha256, locator, quote, item
    and `packet` (identity, synthetic, decision text); `registry` has one row per
    document with `source_bindings` MAP<source_id, STRUCT<locator, quote>>.
    """
    reg = registry.select(
        "document_id", F.struct(*[c for c in registry.columns if c != "document_id"]).alias("r")
    )
    joined = sources.join(reg, "document_id", "left")
    r, p = F.col("r"), F.col("packet")
    same = lambda a, b: a.eqNullSafe(b)
    sustainability = r["document_role"] == "sustainability"
    financial = r["document_role"] == "financial"
    pick = lambda s, f: F.when(sustainability, p[s]).when(financial, p[f])
    binding = F.try_element_at(r["source_bindings"], F.col("source_id"))
    available = F.coalesce(r["available_on"], r["published_at"])
    reason = first_reason(
        (r.isNull(), "document_registry_missing"),
        (~same(r["synthetic"], p["synthetic"]), "document_synthetic_mismatch"),
        (
            ~(
                same(r["tenant_id"], p["tenant_id"])
                & same(r["company_id"], p["company_id"])
                & same(r["package_id"], p["package_id"])
                & same(r["corp_code"], p["corp_code"])
                & same(r["fiscal_year"], p["fiscal_year"])
                & same(r["consolidation"], p["consolidation"])
                & F.coalesce(sustainability | financial, F.lit(False))
            )
            | pick("sustainability_version", "financial_version").isNull()
            | ~same(r["document_version_id"], pick("sustainability_version", "financial_version"))
            | (financial & ~same(r["rcept_no"], p["rcept_no"])),
            "document_identity_mismatch",
        ),
        (
            ~same(r["published_at"], pick("sustainability_published_at", "financial_published_at")),
            "document_publication_mismatch",
        ),
        (~same(r["as_of_date"], p["as_of_date"]), "document_as_of_mismatch"),
        (
            ~same(r["period_start"], pick("period_start", "financial_period_start"))
            | ~same(r["period_end"], pick("period_end", "financial_period_end")),
            "document_period_mismatch",
        ),
        (~same(r["artifact_sha256"], F.col("artifact_sha256")), "document_artifact_mismatch"),
        (~F.array_contains(r["relevant_items"], F.col("item")), "document_not_relevant"),
        (available.isNull() | r["as_of_date"].isNull(), "document_date_invalid"),
        (available > r["as_of_date"], "document_not_available_as_of"),
        (r["decision_binding"].isNull(), "decision_binding_missing"),
        (~same(r["decision_binding"], p["decision_binding"]), "decision_binding_mismatch"),
        (binding.isNull(), "source_binding_missing"),
        (
            ~(same(binding["locator"], F.col("locator")) & same(binding["quote"], F.col("quote"))),
            "source_binding_mismatch",
        ),
    )
    return joined.withColumn("reason", reason).drop("r", "packet")


def trusted_policy(rows: DataFrame, registry: DataFrame) -> DataFrame:
    """Policies with the approval of the registry entry of their own hash.

    `rows` bring policy_sha256, version, source_policy_sha256, synthetic_only.
    """
    entry = registry.select(
        "policy_sha256", F.struct(*[c for c in registry.columns if c != "policy_sha256"]).alias("r")
    )
    joined = rows.join(entry, "policy_sha256", "left")
    r = F.col("r")
    reason = first_reason(
        (r.isNull() | ~F.coalesce(r["approved"], F.lit(False)), "policy_unapproved"),
        (
            ~r["version"].eqNullSafe(F.col("version"))
            | ~r["source_policy_sha256"].eqNullSafe(F.col("source_policy_sha256"))
            | ~r["synthetic_only"].eqNullSafe(F.col("synthetic_only"))
            | F.coalesce(r["approved_by"] == "", F.lit(True))
            | r["approved_on"].isNull(),
            "policy_registry_mismatch",
        ),
    )
    return joined.withColumns({"policy_reason": reason, "policy_trusted": reason.isNull()}).drop("r")


def apply_coverage(
    packets: DataFrame, receipts: DataFrame, documents: DataFrame
) -> DataFrame:
    """Search state of each packet as its coverage receipt proves it.

    A claimed complete search without a receipt is `coverage_unverified`; one
    that is not claimed becomes `not_run`. A receipt counts as complete only if
    it read both documents of the package and has no failure. `packets` carry
    packet_id, receipt_id, claimed_state, coverage_policy_id and the identity;
    `documents` lists the registered document ids of the package.
    """
    r = receipts.select(
        "receipt_id", F.struct(*[c for c in receipts.columns if c != "receipt_id"]).alias("r")
    )
    required = packets.select("packet_id", "receipt_id").join(
        receipts.select("receipt_id", F.explode("required_document_ids").alias("document_id")),
        "receipt_id",
    )
    unknown = (
        required.join(documents.select("document_id").distinct(), "document_id", "left_anti")
        .select("packet_id")
        .distinct()
        .withColumn("__unknown", F.lit(True))
    )
    joined = packets.join(r, "receipt_id", "left").join(unknown, "packet_id", "left")
    e = F.col("r")
    both = F.array("sustainability_version", "financial_version")
    complete = e["state"] == "complete"
    bad = (
        ~e["tenant_id"].eqNullSafe(F.col("tenant_id"))
        | ~e["company_id"].eqNullSafe(F.col("company_id"))
        | ~e["package_id"].eqNullSafe(F.col("package_id"))
        | ~e["coverage_policy_id"].eqNullSafe(F.col("coverage_policy_id"))
        | ~F.coalesce(e["state"].isin(*SEARCH_STATES), F.lit(False))
        | F.coalesce("__unknown", F.lit(False))
        | (
            complete
            & (
                (F.size(e["required_document_ids"]) == 0)
                | (F.size(e["failed_document_ids"]) > 0)
                | ~is_subset(both, e["required_document_ids"])
            )
        )
    )
    reason = F.when(
        F.when(e.isNull(), F.col("claimed_state") == "complete").otherwise(
            F.coalesce(bad, F.lit(True))
        ),
        F.lit("coverage_unverified"),
    )
    state = F.when(reason.isNotNull(), F.lit(None)).when(e.isNull(), F.lit("not_run")).otherwise(e["state"])
    return joined.withColumns({"coverage_reason": reason, "search_state": state}).drop("r", "__unknown")


# ---------------------------------------------------------------- packet assembly


def build_packets(
    claims: DataFrame, facts: DataFrame, contexts: DataFrame, key: Sequence[str] = DOC
) -> DataFrame:
    """Claim x trigger x financial context with the first reason a packet is blocked.

    `claims`: key, claim_id, track, quote, trigger_item. `facts`: key, claim_id,
    item, side, source_id, quote, locator, verified. `contexts`: key, package_id,
    approved, financial_period. A side with two different literals is a conflict,
    never a pick.
    """
    key = list(key)
    sides = facts.groupBy(*key, "claim_id", "item", "side").agg(
        F.bool_and("verified").alias("verified"),
        F.count_distinct("quote", "locator").alias("n_literals"),
        F.min(F.struct("source_id", "quote", "locator")).alias("fact"),
    )
    wide = sides.groupBy(*key, "claim_id", "item").agg(
        *[
            F.max(F.when(F.col("side") == s, F.struct("verified", "n_literals", "fact"))).alias(s)
            for s in ("sustainability", "financial")
        ]
    )
    per_context = contexts.groupBy(*key).agg(
        F.count("*").alias("n_contexts"),
        F.min(F.struct("package_id", "approved", "financial_period")).alias("context"),
    )
    joined = (
        claims.withColumnRenamed("trigger_item", "item")
        .join(wide, [*key, "claim_id", "item"], "left")
        .join(per_context, key, "left")
    )
    s, f = F.col("sustainability"), F.col("financial")
    reason = first_reason(
        (F.col("item").isNull(), "trigger_absent"),
        (~F.col("item").isin(*ITEMS), "item_not_supported"),
        (F.col("n_contexts").isNull(), "financial_context_absent"),
        (F.col("n_contexts") > 1, "financial_context_ambiguous"),
        (~F.coalesce(F.col("context.approved"), F.lit(False)), "financial_context_unapproved"),
        (s.isNull(), "sustainability_fact_absent"),
        (f.isNull(), "financial_fact_absent"),
        ((s["n_literals"] > 1) | (f["n_literals"] > 1), "fact_conflict"),
        (~s["verified"] | ~f["verified"], "fact_unverified"),
    )
    return joined.select(
        *key,
        "claim_id",
        "item",
        F.col("context.package_id").alias("package_id"),
        F.when(reason.isNull(), s["fact"]).alias("sustainability"),
        F.when(reason.isNull(), f["fact"]).alias("financial"),
        reason.alias("blocked_reason"),
    )
