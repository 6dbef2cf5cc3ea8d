"""Attribution of evidence: binding acceptance, report-level chains, note conditions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimgrove.functions.arrays import first_reason
from claimgrove.functions.periods import is_supported_period
from claimgrove.functions.text import code_in_ranges, collapse_space, nfc, scope_note, strip, unit_note
from claimgrove.operators.claims import DOC

# --- fixed values: dimensions and report-level patterns ------------------------------------
REQUIRED_DIMENSIONS = ("entity", "metric", "reporting_period")
INDEX_ROW = (
    r"^(\d{1,3}-\d{1,2})\s+\D*?\s*(\d+(?:\s*[-–]\s*\d+)?(?:\s*,\s*\d+(?:\s*[-–]\s*\d+)?)*)$"
)
STANDARD = r"(?i)AA1000\s*AS|ISAE\s*3000|ISSA\s*5000"
INDEX_HEADING = r"(?i)GRI(?:\s+Content)?\s+Index|GRI\s*인덱스"
ASSURANCE_HEADING = r"(?i)제3자\s*검증|검증\s*의견서|Independent\s+Assurance|Assurance\s+Statement"
SCOPE_HEADING = r"(?i)보고\s*범위|Reporting\s+(?:Scope|Boundary)"
ENTITY = r"주식회사|㈜|\(주\)|개별\s*기업|연결\s*(?:기준|대상)|법인|사업장"
OWN_SCOPE = (
    r"사업장|공장|데이터\s*센터|센터|사옥|본사|지사|법인|자회사|계열사|국내|해외|글로벌|지역|"
    r"춘천|세종|전\s*사업장|전사"
)
# --- end of fixed values ---------------------------------------------------------------------


def attributed(anchor: Column, target: Column, linked: Column, atomic: Column, name: Column) -> Column:
    """accepted | rejected | undetermined: does a role's span own the target's cell or span?

    Both structs carry source_id, char_start, char_end, table_id (null = no
    table), row_number, column_number, row_span, column_span.
    """
    inside = (
        (target["char_start"] <= anchor["char_start"])
        & (anchor["char_start"] < anchor["char_end"])
        & (anchor["char_end"] <= target["char_end"])
    )
    one = lambda c: F.coalesce(c, F.lit(1))
    ar, ac = one(anchor["row_span"]), one(anchor["column_span"])
    br, bc = one(target["row_span"]), one(target["column_span"])
    coords = [s[c] for s in (anchor, target) for c in ("row_number", "column_number")]
    unknown = F.lit(False)
    for c in coords:
        unknown = unknown | c.isNull() | (c < 0)
    for c in (ar, ac, br, bc):
        unknown = unknown | (c < 1)
    row = (anchor["row_number"] <= target["row_number"]) & (
        target["row_number"] + br <= anchor["row_number"] + ar
    )
    column = (anchor["column_number"] <= target["column_number"]) & (
        target["column_number"] + bc <= anchor["column_number"] + ac
    )
    above = column & (anchor["row_number"] + ar <= target["row_number"]) & linked
    return (
        F.when(
            anchor["source_id"] == target["source_id"],
            F.when(~atomic | inside, F.lit("accepted")).otherwise(F.lit("rejected")),
        )
        .when(~anchor["table_id"].eqNullSafe(target["table_id"]) | anchor["table_id"].isNull(), F.lit("rejected"))
        .when(unknown, F.lit("undetermined"))
        .when((name == "reporting_period") & ~column, F.lit("rejected"))
        .when(row | above, F.lit("accepted"))
        .otherwise(F.lit("rejected"))
    )


def accept_bindings(bindings: DataFrame, dimensions: DataFrame) -> DataFrame:
    """State of each evidence binding: accepted, undetermined or rejected.

    `bindings`: binding_id, source_state (worst citation state of claim and
    evidence), has_roles, direct (inside the claim span and local scope allowed),
    cues_open, source_scopes ARRAY, same_table, same_column, coordinates_known,
    element_id. `dimensions` is long: binding_id, name, expected/actual quotes
    (null = role without span), expected_given, actual_given, and the citation
    and attribution states of each side. A missing required role counts open.
    """
    no = F.lit(False)
    required = bindings.select(
        "binding_id", F.explode(F.array(*[F.lit(n) for n in REQUIRED_DIMENSIONS])).alias("name")
    )
    d = required.join(dimensions, ["binding_id", "name"], "full").join(
        bindings.select("binding_id", "direct"), "binding_id"
    )
    missing = F.col("expected").isNull() | F.col("actual").isNull()
    optional_null = ~F.col("name").isin(*REQUIRED_DIMENSIONS) & (
        (F.coalesce("expected_given", no) & F.col("expected").isNull())
        | (F.coalesce("actual_given", no) & F.col("actual").isNull())
    )
    skip = missing & (~F.col("direct") | optional_null)
    any_side = lambda state: (
        (F.col("expected").isNotNull() & (F.col(f"expected_{state[0]}") == state[1]))
        | (F.col("actual").isNotNull() & (F.col(f"actual_{state[0]}") == state[1]))
    )
    differ = F.col("expected").isNotNull() & F.col("actual").isNotNull() & (
        strip(nfc(F.col("expected"))) != strip(nfc(F.col("actual")))
    )
    period = (F.col("name") == "reporting_period") & (
        (F.col("expected").isNotNull() & ~is_supported_period(F.col("expected")))
        | (F.col("actual").isNotNull() & ~is_supported_period(F.col("actual")))
    )
    state = (
        F.when(skip, F.lit("undetermined"))
        .when(any_side(("citation", "rejected")), F.lit("rejected"))
        .when(any_side(("citation", "undetermined")), F.lit("undetermined"))
        .when(any_side(("attribution", "rejected")) | differ, F.lit("rejected"))
        .when(any_side(("attribution", "undetermined")) | period, F.lit("undetermined"))
        .otherwise(F.lit("accepted"))
    )
    per_binding = d.withColumn("state", state).groupBy("binding_id").agg(
        F.bool_or(F.col("state") == "rejected").alias("rejected"),
        F.bool_or(F.col("state") == "undetermined").alias("open"),
    )
    has = lambda scope: F.array_contains("source_scopes", scope)
    table = F.col("same_table") & has("same_table")
    joined = bindings.join(per_binding, "binding_id", "left")
    final = (
        F.when(F.col("source_state") == "rejected", F.lit("rejected"))
        .when(
            (F.col("source_state") == "undetermined") | ~F.coalesce("has_roles", no),
            F.lit("undetermined"),
        )
        .when(F.coalesce("rejected", no), F.lit("rejected"))
        .when(
            F.coalesce("open", no) | (~F.col("direct") & F.coalesce("cues_open", no)),
            F.lit("undetermined"),
        )
        .when(F.col("direct"), F.lit("accepted"))
        .when(table & ~F.col("coordinates_known"), F.lit("undetermined"))
        .when(table & F.col("same_column"), F.lit("accepted"))
        .when(table, F.lit("rejected"))
        .when(has("global_bound"), F.lit("accepted"))
        .when(has("explicit_link") & (F.col("element_id") != "G3"), F.lit("undetermined"))
        .otherwise(F.lit("rejected"))
    )
    return joined.select("binding_id", final.alias("state"))


def page_flags(pages: DataFrame, doc: Sequence[str] = DOC) -> DataFrame:
    """Heading flags per page from its block texts (partial aggregation)."""
    t = collapse_space(nfc(F.col("text")))
    low = F.lower(t)
    return pages.groupBy(*doc, "page_num").agg(
        (
            F.bool_or(t.rlike(INDEX_HEADING))
            | (F.bool_or(low == "index") & F.bool_or(low.isin("gri", "gri standards")))
        ).alias("index_heading"),
        F.bool_or(t.rlike(ASSURANCE_HEADING)).alias("assurance_heading"),
        F.bool_or(t.rlike(SCOPE_HEADING)).alias("scope_heading"),
    )


def credit_report_level(chains: DataFrame, pages: DataFrame, doc: Sequence[str] = DOC) -> DataFrame:
    """`credited`: index row names the claim's page, the opinion covers its code, and the
    standard stands on the opinion's page; any doubt is false.

    `chains`: doc, chain_id, claim_label, index_quote, index_page, coverage_quote,
    coverage_page, coverage_source_id, standard_quote, standard_page,
    credited_from, all_verified.
    """
    doc = list(doc)
    flags = page_flags(pages, doc)
    index = flags.select(*doc, F.col("page_num").alias("index_page"), "index_heading")
    cover = flags.select(*doc, F.col("page_num").alias("coverage_page"), "assurance_heading")
    joined = chains.join(index, [*doc, "index_page"], "left").join(cover, [*doc, "coverage_page"], "left")
    clean = lambda c: collapse_space(nfc(F.col(c)))
    rows = joined.withColumns(
        {
            "__code": F.regexp_extract(clean("index_quote"), INDEX_ROW, 1),
            "__pages": F.regexp_extract(clean("index_quote"), INDEX_ROW, 2),
            "__cover": clean("coverage_quote"),
            "__label": F.when(F.col("claim_label").rlike("^[0-9]+$"), F.col("claim_label").cast("int")),
        }
    )
    named = F.exists(
        F.split("__pages", ","),
        lambda p: F.col("__label").between(
            F.regexp_extract(p, r"(\d+)", 1).try_cast("int"),
            F.coalesce(
                F.regexp_extract(p, r"\d+\s*[-–]\s*(\d+)", 1).try_cast("int"),
                F.regexp_extract(p, r"(\d+)", 1).try_cast("int"),
            ),
        ),
    )
    ok = (
        F.col("all_verified")
        & (F.col("__code") != "")
        & named
        & F.col("index_heading")
        & code_in_ranges(F.col("__code"), F.col("__cover"))
        & F.col("standard_quote").rlike(STANDARD)
        & (F.col("standard_page") == F.col("coverage_page"))
        & F.col("assurance_heading")
        & (F.col("credited_from") == F.col("coverage_source_id"))
    )
    return rows.select(*chains.columns, F.coalesce(ok, F.lit(False)).alias("credited"))


def assess_ownership(entries: DataFrame, targets: DataFrame, links: DataFrame) -> DataFrame:
    """Note-ownership proposals: accepted, unknown or conflict with their reasons.

    `entries`: ownership_id, fragment_id, note_id, state, note_kind,
    citation_state, classification_state, evidence_verified. `targets`:
    ownership_id, source_id. `links`: note_id, target_id (footnote edges).
    Competing proposals of one fragment are found by comparing target digests per
    fragment, so their order does not matter and no pairs are formed.
    """
    digest = targets.groupBy("ownership_id").agg(
        F.count_distinct("source_id").alias("n_targets"),
        F.sum(F.xxhash64("source_id").cast("decimal(38,0)")).alias("digest"),
    )
    named = entries.join(digest, "ownership_id", "left").withColumns(
        {"n_targets": F.coalesce("n_targets", F.lit(0)), "digest": F.coalesce("digest", F.lit(0))}
    )
    rivals = named.groupBy("fragment_id").agg(
        ((F.min("digest") != F.max("digest")) | (F.min("n_targets") != F.max("n_targets"))).alias("differ"),
        F.bool_or(F.col("state") == "conflict").alias("any_conflict"),
    )
    covered = (
        targets.join(entries.select("ownership_id", "note_id"), "ownership_id")
        .join(links.select("note_id", F.col("target_id").alias("source_id"), F.lit(1).alias("hit")), ["note_id", "source_id"], "left")
        .groupBy("ownership_id")
        .agg(F.count_if(F.col("hit").isNull()).alias("unlinked"), F.count("hit").alias("linked"))
    )
    total = links.groupBy("note_id").agg(F.count_distinct("target_id").alias("n_links"))
    rows = (
        named.join(rivals, "fragment_id")
        .join(covered, "ownership_id", "left")
        .join(total, "note_id", "left")
    )
    competing = F.col("differ") | F.col("any_conflict") | (F.coalesce("n_links", F.lit(0)) > F.coalesce("linked", F.lit(0)))
    reasons = F.array_compact(
        F.array(
            F.when(F.col("state") != "linked", F.concat(F.lit("ownership_"), F.col("state"))),
            F.when(F.col("note_kind") != "footnote", F.lit("canonical_note_kind_unresolved")),
            F.when(~F.col("citation_state").eqNullSafe("confirmed"), F.lit("citations_unconfirmed")),
            F.when(~F.col("classification_state").eqNullSafe("note"), F.lit("classifications_unconfirmed")),
            F.when((F.col("n_targets") == 0) | (F.coalesce("unlinked", F.lit(0)) > 0), F.lit("explicit_footnote_link_missing")),
            F.when(competing, F.lit("competing_ownership")),
            F.when(~F.coalesce("evidence_verified", F.lit(False)), F.lit("original_target_evidence_unverified")),
        )
    )
    conflict = competing | (F.col("citation_state") == "conflict") | (F.col("classification_state") == "conflict")
    return rows.select(
        "ownership_id",
        "fragment_id",
        F.when(F.size(reasons) == 0, F.lit("accepted"))
        .when(F.coalesce(conflict, F.lit(False)), F.lit("conflict"))
        .otherwise(F.lit("unknown"))
        .alias("state"),
        reasons.alias("reasons"),
    )


def assess_conditions(conditions: DataFrame, ownership: DataFrame, targets: DataFrame) -> DataFrame:
    """Note conditions: accepted literal, unsupported, unknown or conflict.

    `conditions`: condition_id, fragment_id, ownership_id, kind, state, text (the
    whole note), literal_verified. Two conditions compete when they read one
    fragment, or one kind for a shared target, and their literals differ; only
    distinct literals per fragment and per (target, kind) are compared.
    """
    owner = ownership.select("ownership_id", F.col("state").alias("owner_state"))
    literal = F.when(F.col("kind") == "unit_literal", unit_note(F.col("text"))).when(
        F.col("kind") == "scope_literal", scope_note(F.col("text"))
    )
    rows = conditions.join(owner, "ownership_id", "left").withColumn("literal", literal)
    mark = F.concat_ws("|", F.col("kind"), F.coalesce("literal", F.lit("")), F.col("state"))
    per_fragment = rows.groupBy("fragment_id").agg((F.min(mark) != F.max(mark)).alias("f_differ"))
    reach = rows.select("condition_id", "ownership_id", "kind", mark.alias("m")).join(
        targets.select("ownership_id", "source_id"), "ownership_id"
    )
    per_target = reach.groupBy("source_id", "kind").agg((F.min("m") != F.max("m")).alias("differ"))
    touched = (
        reach.join(per_target, ["source_id", "kind"])
        .groupBy("condition_id")
        .agg(F.bool_or("differ").alias("t_differ"))
    )
    joined = rows.join(per_fragment, "fragment_id").join(touched, "condition_id", "left")
    rival = F.coalesce("f_differ", F.lit(False)) | F.coalesce("t_differ", F.lit(False))
    reason = first_reason(
        (F.col("state") != "tagged", F.concat(F.lit("condition_"), F.col("state"))),
        (~F.col("owner_state").eqNullSafe("accepted"), "ownership_unaccepted"),
        (F.col("literal").isNull(), "unsupported_condition_syntax"),
        (~F.coalesce("literal_verified", F.lit(False)), "original_literal_evidence_unverified"),
        (rival, "competing_condition"),
    )
    state = (
        F.when(reason.isNull(), F.lit("accepted"))
        .when(F.col("state") != "tagged", F.col("state"))
        .when((reason == "competing_condition") | (F.col("owner_state") == "conflict"), F.lit("conflict"))
        .when(reason == "unsupported_condition_syntax", F.lit("unsupported"))
        .otherwise(F.lit("unknown"))
    )
    return joined.select(
        "condition_id",
        state.alias("state"),
        F.when(reason.isNull(), F.col("literal")).alias("value"),
        reason.alias("reason"),
    )
