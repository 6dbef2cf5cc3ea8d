"""Deterministic grading with three-valued logic.

A claim row carries `track` and `facts` MAP<name, state>; `fact_map` builds it
from long facts. Everything below is row-local column arithmetic: one shuffle
builds the map, none grades.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimgrove.functions.text import is_blank
from claimgrove.operators import rulebook as R

_STRINGS = "array<string>"
STATES = ("present", "absent", "unknown", "conflict")


def fact_map(
    facts: DataFrame, key: Sequence[str] = ("claim_id",), names: Sequence[str] | None = None
) -> DataFrame:
    """One row per claim with MAP<name, state>.

    Facts outside the rule vocabulary are left out first and repeated facts fold
    by partial aggregation (disagreement is conflict), so what is gathered is
    bounded by the vocabulary however many rows a claim has. Where all states are known ones,
    a claim is a few long values with a bit per fact; other states are gathered as texts.
    """
    key = list(key)
    vocabulary = list(dict.fromkeys(names)) if names is not None else sorted(
        {n for _, n in R.required_facts()}
        | {n for names in R.SAFE_HARBOR.values() for n in names}
        | {
            R.PRODUCT_DIRECT_FACT,
            "has_superlative",
            "comparison_basis",
            "external_verification",
            "categorical_ordinal",
            "certification_provider",
            "willingness_only",
        }
    )
    wanted = facts.filter(F.col("name").isin(*vocabulary))
    if len(vocabulary) < 64 and wanted.filter(~F.col("state").isin(*STATES)).isEmpty():
        return _fact_masks(wanted, key, vocabulary)
    one = (
        wanted
        .groupBy(*key, "name")
        .agg(F.min("state").alias("lo"), F.max("state").alias("hi"))
        .select(
            *key,
            "name",
            F.when(F.col("lo") == F.col("hi"), F.col("lo"))
            .otherwise(F.lit("conflict"))
            .alias("state"),
        )
    )
    return one.groupBy(*key).agg(
        F.map_from_entries(F.collect_list(F.struct("name", "state"))).alias("facts")
    )


def _fact_masks(facts: DataFrame, key: list[str], vocabulary: list[str]) -> DataFrame:
    """`fact_map` of facts whose states are all known or null: a bit per fact in a mask per state."""
    bits = F.create_map(*[x for i, n in enumerate(vocabulary) for x in (F.lit(n), F.lit(1 << i).cast("bigint"))])
    bit = facts.select(*key, "state", bits[F.col("name")].alias("__bit"))
    masks = bit.groupBy(*key).agg(
        F.bit_or("__bit").alias("__seen"),
        *[F.coalesce(F.bit_or(F.when(F.col("state") == s, F.col("__bit"))), F.lit(0)).alias(f"__{s}") for s in STATES],
    )
    entries = []
    for i, name in enumerate(vocabulary):
        has = lambda mask, b=1 << i: F.col(f"__{mask}").bitwiseAND(F.lit(b).cast("bigint")) != 0
        # One state alone names the fact; several, or none but null, are a conflict.
        alone = reduce(lambda a, b: a + b, [F.when(has(s), F.lit(1)).otherwise(0) for s in STATES]) == 1
        state = reduce(lambda w, s: w.when(alone & has(s), F.lit(s)), STATES[1:], F.when(alone & has(STATES[0]), F.lit(STATES[0])))
        entries.append(F.when(has("seen"), F.struct(F.lit(name).alias("name"), state.otherwise("conflict").alias("state"))))
    return masks.select(*key, F.map_from_entries(F.array_compact(F.array(*entries))).alias("facts"))


def state_of(name: str, facts: Column | None = None) -> Column:
    facts = F.col("facts") if facts is None else facts
    return F.coalesce(F.try_element_at(facts, F.lit(name)), F.lit("unknown"))


def _all(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


# ---------------------------------------------------------------- exceptions


def exceptions(claims: DataFrame) -> DataFrame:
    """Add `effect`: override, cap, gap ids, unresolved names, rule ids, ordinal state.

    Reads superlative_quote, superlative_cited (the quote lies in a reference of
    its fact), safe_harbor_category and product_variant.
    """
    facts = F.col("facts")
    superlative = F.coalesce(~is_blank(F.col("superlative_quote")), F.lit(False))
    claimed = F.coalesce(F.col("superlative_quote") != "", F.lit(False)) | (
        F.map_contains_key(facts, "has_superlative") & (state_of("has_superlative") != "absent")
    )
    category = F.col("safe_harbor_category").isNotNull()
    sourced = (
        (state_of("has_superlative") == "present")
        & superlative
        & F.coalesce(F.col("superlative_cited"), F.lit(False))
    )
    operands = ("comparison_basis", "external_verification")
    none_shown = _all([state_of(n) == "absent" for n in operands])
    any_shown = reduce(lambda a, b: a | b, [state_of(n) == "present" for n in operands])
    open_operands = F.array_compact(
        F.array(*[F.when(state_of(n) != "absent", F.lit(n)) for n in operands])
    )
    override = ~category & claimed & sourced & none_shown
    empty = F.array().cast(_STRINGS)
    unresolved_superlative = (
        F.when(category | ~claimed, empty)
        .when(~sourced, F.array(F.lit("has_superlative")))
        .when(any_shown, empty)
        .otherwise(open_operands)
    )
    ordinal_track = (F.col("track") == "performance") & F.map_contains_key(
        facts, "categorical_ordinal"
    )
    pair = F.array(state_of("categorical_ordinal"), state_of("certification_provider"))
    ordinal = (
        F.when(~ordinal_track, F.lit(None))
        .when(F.forall(pair, lambda s: s == "present"), F.lit("present"))
        .when(F.array_contains(pair, "absent"), F.lit("absent"))
        .when(F.array_contains(pair, "conflict"), F.lit("conflict"))
        .otherwise(F.lit("unknown"))
    )
    product = F.coalesce(F.col("product_variant"), F.lit(False)) & ~category & ~override
    managed = product & (F.col("track") == "management")
    direct = state_of(R.PRODUCT_DIRECT_FACT)
    capped = managed & (direct == "absent")
    gaps = (
        F.when(category & claimed, F.array(F.lit("GAP-001"), F.lit("GAP-006")))
        .when(category, F.array(F.lit("GAP-001")))
        .when(override, empty)
        .when(
            (product & (F.col("track") != "management")) | (managed & (direct == "present")),
            F.array(F.lit("GAP-007")),
        )
        .otherwise(empty)
    )
    unresolved = F.concat(
        F.when(override, empty).otherwise(unresolved_superlative),
        F.when(
            managed & ~direct.isin("absent", "present"), F.array(F.lit(R.PRODUCT_DIRECT_FACT))
        ).otherwise(empty),
    )
    plain = ~category & ~override
    rules = (
        F.when(override, F.array(F.lit("SUPERLATIVE_E0")))
        .when(
            plain,
            F.array_compact(
                F.array(
                    F.when(ordinal_track, F.lit("CATEGORICAL_ORDINAL")),
                    F.when(capped, F.lit("PRODUCT_NAMES_CAP")),
                )
            ),
        )
        .otherwise(empty)
    )
    return claims.withColumn(
        "effect",
        F.struct(
            F.when(override, F.lit("E0")).alias("override_grade"),
            F.when(capped, F.lit(R.PRODUCT_CAP)).alias("cap_grade"),
            gaps.alias("gap_ids"),
            unresolved.alias("unresolved"),
            rules.alias("rule_ids"),
            F.when(plain, ordinal).alias("ordinal_state"),
        ),
    )


def without_exceptions(claims: DataFrame) -> DataFrame:
    """`effect` of claims that carry none of the exception inputs."""
    nothing = F.lit(None).cast("string")
    empty = F.array().cast(_STRINGS)
    return claims.withColumn(
        "effect",
        F.struct(
            nothing.alias("override_grade"),
            nothing.alias("cap_grade"),
            empty.alias("gap_ids"),
            empty.alias("unresolved"),
            empty.alias("rule_ids"),
            nothing.alias("ordinal_state"),
        ),
    )


# ---------------------------------------------------------------- ladder


# The ladder is stated as SQL text: one parsed expression per rule list is much
# cheaper to build than the same tree assembled node by node.

_OPEN = "NOT IN ('present', 'absent')"


def _sum(terms: list[str]) -> str:
    return " + ".join(terms)


def _case(build) -> str:
    """CASE over the tracks with one SQL expression each."""
    return "CASE track " + " ".join(f"WHEN '{t}' THEN {build(t)}" for t in R.BRANCHES) + " END"


def _bits(track: str, test: str) -> str:
    names = R.ladder_facts(track)
    return _sum([f"IF(__s_{n} {test}, {1 << i}, 0)" for i, n in enumerate(names)])


def _outcomes(track: str) -> str:
    """Distinct struct<grade, id> over every completion of the unknown ladder facts.

    Facts are bits: `__known` holds the present ones, `__open` the undecided
    ones. A completion is `__known` plus any subset of `__open`, and a branch is
    two masks. Cap branches win in file order, then the highest (grade, id).
    """
    names = R.ladder_facts(track)
    bit = {n: 1 << i for i, n in enumerate(names)}

    def test(branch: R.Branch) -> str:
        listed = {n: e for n, e in branch.when.items() if n != "exception_applies"}
        mask = sum(bit[n] for n in listed)
        wanted = sum(bit[n] for n, expected in listed.items() if expected)
        hit = f"(v & {mask}) = {wanted}"
        if "exception_applies" in branch.when:
            both = bit["target_metric"] | bit["transition_plan"]
            sign = "=" if branch.when["exception_applies"] else "<>"
            hit += f" AND (v & {both}) {sign} {both}"
        return hit

    caps = [b for b in R.BRANCHES[track] if b.cap]
    rest = [b for b in R.BRANCHES[track] if not b.cap]
    rest.sort(key=lambda b: (b.grade, b.id), reverse=True)
    ladder = " ".join(
        f"WHEN {test(b)} THEN named_struct('grade', '{b.grade}', 'id', '{b.id}')"
        for b in [*caps, *rest]
    )
    nothing = "named_struct('grade', CAST(NULL AS STRING), 'id', '')"
    every = (1 << len(names)) - 1
    completions = (
        "IF(__open = 0, array(__known), transform(filter("
        f"sequence(0, {every}), m -> (m & __open) = m), m -> m | __known))"
    )
    return f"array_distinct(transform({completions}, v -> CASE {ladder} ELSE {nothing} END))"


def _element_lists(track: str) -> dict[str, str]:
    """missing / unresolved / excluded element ids of a track as SQL."""
    lists: dict[str, list[str]] = {"missing": [], "unresolved": [], "excluded": []}
    for element, names in R.ELEMENTS[track].items():
        trigger = R.TRIGGERS.get(element)
        off = f"__s_{trigger} = 'absent'" if trigger else "false"
        open_ = " OR ".join(f"__s_{n} {_OPEN}" for n in names)
        if trigger:
            open_ += f" OR __s_{trigger} <> 'present'"
        lacking = " OR ".join(f"__s_{n} = 'absent'" for n in names)
        lists["excluded"].append(f"IF({off}, '{element}', NULL)")
        lists["unresolved"].append(f"IF(NOT {off} AND ({open_}), '{element}', NULL)")
        lists["missing"].append(f"IF(NOT {off} AND NOT ({open_}) AND ({lacking}), '{element}', NULL)")
    return {k: f"array_compact(array({', '.join(v)}))" for k, v in lists.items()}


def _states() -> dict[str, Column]:
    """One looked-up state column per fact; P1 facts take the ordinal qualification."""
    out = {}
    for name in sorted({n for _, n in R.required_facts()}):
        state = f"coalesce(try_element_at(facts, '{name}'), 'unknown')"
        if name in R.ELEMENTS["performance"]["P1"]:
            state = f"IF(track = 'performance', coalesce(effect.ordinal_state, {state}), {state})"
        out[f"__s_{name}"] = F.expr(state)
    return out


def grade(claims: DataFrame) -> DataFrame:
    """Decide every claim: status, grade, label, range, element lists, gap ids.

    One grade over all completions decides; several block on evidence and
    publish the range; none is a rule gap. Needs `effect` (see `exceptions`).
    """
    lists = {t: _element_lists(t) for t in R.BRANCHES}
    rows = claims.withColumns(_states())
    rows = rows.withColumns(
        {
            "__known": F.expr(_case(lambda t: _bits(t, "= 'present'"))),
            "__open": F.expr(_case(lambda t: _bits(t, _OPEN))),
            **{
                f"__{name}_elements": F.expr(_case(lambda t, n=name: lists[t][n]))
                for name in ("missing", "unresolved", "excluded")
            },
        }
    )
    rows = rows.withColumn("__outcomes", F.expr(_case(_outcomes)))
    effect = F.col("effect")
    rows = rows.withColumn(
        "__grades",
        F.array_distinct(
            F.transform(
                "__outcomes",
                lambda o: F.when(
                    o["grade"].isNotNull() & effect["cap_grade"].isNotNull(),
                    F.least(o["grade"], effect["cap_grade"]),
                ).otherwise(o["grade"]),
            )
        ),
    )
    grades = F.col("__grades")
    single = F.when(F.size(grades) == 1, F.get(grades, F.lit(0)))
    several = F.size(grades) > 1
    no_rule = ~several & single.isNull()
    blocked_by_effect = F.size(effect["unresolved"]) > 0
    gap_by_effect = F.size(effect["gap_ids"]) > 0
    overridden = effect["override_grade"].isNotNull()
    status = (
        F.when(gap_by_effect, F.lit("blocked_rule_gap"))
        .when(blocked_by_effect, F.lit("blocked_evidence"))
        .when(overridden, F.lit("decided"))
        .when(several, F.lit("blocked_evidence"))
        .when(no_rule, F.lit("blocked_rule_gap"))
        .otherwise(F.lit("decided"))
    )
    rows = rows.withColumn("decision_status", status)
    decided = F.col("decision_status") == "decided"
    final = F.when(decided, F.coalesce(effect["override_grade"], single))
    rows = rows.withColumn("evidence_grade", final)
    labels = F.create_map(*[F.lit(x) for pair in R.LABELS.items() for x in pair])
    unresolved = F.concat(F.col("__unresolved_elements"), effect["unresolved"])
    has_range = (
        (F.col("decision_status") == "blocked_evidence")
        & several
        & ~F.exists(grades, lambda g: g.isNull())
        & ~blocked_by_effect
        & ~gap_by_effect
    )
    sample = (
        (F.col("track") == "goal")
        & (F.col("evidence_grade") == "E1")
        & F.col("__missing_elements").eqNullSafe(
            F.array(*[F.lit(e) for e in ("G3", "G4", "G5", "G6")])
        )
        & F.expr(
            " AND ".join(
                f"__s_{n} = 'absent'"
                for e in ("G3", "G4", "G5", "G6")
                for n in R.ELEMENTS["goal"][e]
            )
        )
        & (F.size(unresolved) == 0)
        & F.col("__excluded_elements").eqNullSafe(F.array(F.lit("G7"), F.lit("G8")))
    )
    middle = F.col("evidence_grade").isin("E1", "E2") & ~F.coalesce(sample, F.lit(False))
    gap_ids = F.array_sort(
        F.array_distinct(
            F.concat(
                F.array_compact(
                    F.array(
                        F.when(no_rule & ~overridden, F.lit("GAP-007")),
                        F.when(middle, F.lit("GAP-005")),
                    )
                ),
                effect["gap_ids"],
            )
        )
    )
    rules = F.array_sort(
        F.array_distinct(
            F.concat(
                F.filter(F.transform("__outcomes", lambda o: o["id"]), lambda i: i != ""),
                effect["rule_ids"],
            )
        )
    )
    return rows.select(
        *claims.columns,
        "decision_status",
        "evidence_grade",
        labels[F.col("evidence_grade")].alias("label"),
        F.when(F.coalesce(sample, F.lit(False)), F.lit("IMPL")).alias("sublabel"),
        F.when(decided & (F.size(unresolved) == 0), F.lit("auto_confirmed"))
        .otherwise(F.lit("needs_review"))
        .alias("review_status"),
        F.col("__missing_elements").alias("missing_elements"),
        unresolved.alias("unresolved_elements"),
        F.col("__excluded_elements").alias("excluded_elements"),
        F.when(has_range, F.array_min(grades)).alias("grade_floor"),
        F.when(has_range, F.array_max(grades)).alias("grade_ceiling"),
        gap_ids.alias("gap_ids"),
        rules.alias("rule_ids"),
    )


# ---------------------------------------------------------------- checklists


def checklist(claims: DataFrame, policy_active: bool = True) -> DataFrame:
    """Safe-harbour checklist: `documented` false on any absence, true when all
    items are present, else null; null without a category or an active policy."""
    documented = None
    for category, names in R.SAFE_HARBOR.items():
        states = [state_of(n) for n in names]
        verdict = F.when(
            reduce(lambda a, b: a | b, [s == "absent" for s in states]), F.lit(False)
        ).when(_all([s == "present" for s in states]), F.lit(True))
        hit = F.col("safe_harbor_category") == category
        documented = (
            F.when(hit, verdict) if documented is None else documented.when(hit, verdict)
        )
    if not policy_active:
        documented = F.lit(None).cast("boolean")
    return claims.withColumns(
        {
            "applicable": F.col("safe_harbor_category").isNotNull(),
            "reasonable_basis_documented": documented,
        }
    )


# ---------------------------------------------------------------- rescore


def definition_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Reasons (reason, element_id) why tags made for `old` cannot be reused.

    Element definitions are (element_id, meaning, source_scopes); `meaning` is a
    canonical text of everything but basis and scopes.
    """
    o = old.select("element_id", F.col("meaning").alias("om"), F.col("source_scopes").alias("os"))
    n = new.select("element_id", F.col("meaning").alias("nm"), F.col("source_scopes").alias("ns"))
    both = o.join(n, "element_id", "full")
    reasons = F.array_compact(
        F.array(
            F.when(F.col("om").isNull() | F.col("nm").isNull(), F.lit("ELEMENT_SET_CHANGED")),
            F.when(F.col("om") != F.col("nm"), F.lit("ELEMENT_MEANING_CHANGED")),
            F.when(F.size(F.array_except("ns", "os")) > 0, F.lit("SOURCE_SCOPES_EXPANDED")),
        )
    )
    return both.select("element_id", F.explode(reasons).alias("reason"))


def rescore(claims: DataFrame, changes: DataFrame) -> DataFrame:
    """Re-grade claims whose stored facts answer the new pack, else RETAG reasons.

    Any definition change sends all claims to RETAG; otherwise a claim needs
    every fact its track reads, except facts of an element whose trigger is
    absent. `claims` need `facts` and `effect`.
    """
    pack = changes.agg(
        F.array_sort(
            F.collect_set(F.concat_ws(":", "reason", "element_id"))
        ).alias("__pack")
    )

    def missing(track: str) -> str:
        needed: dict[str, str] = {n: "true" for n in R.ladder_facts(track)}
        for element, names in R.ELEMENTS[track].items():
            trigger = R.TRIGGERS.get(element)
            asked = "true"
            if trigger:
                needed[trigger] = "true"
                asked = f"coalesce(try_element_at(facts, '{trigger}'), 'unknown') <> 'absent'"
            for n in names:
                needed[n] = f"({needed[n]} OR {asked})" if n in needed else asked
        checks = ", ".join(
            f"IF({need} AND NOT map_contains_key(facts, '{n}'), 'MISSING_FACT:{n}', NULL)"
            for n, need in needed.items()
        )
        return f"array_sort(array_compact(array({checks})))"

    # The reason list is one row of configuration, read as a scalar subquery.
    graded = grade(claims).withColumn("__pack", pack.scalar())
    reasons = F.when(F.size("__pack") > 0, F.col("__pack")).otherwise(
        F.expr(_case(missing))
    )
    retag = F.size("__retag") > 0
    out = graded.withColumn("__retag", reasons)
    return out.select(
        *claims.columns,
        F.when(retag, F.lit("RETAG_REQUIRED")).otherwise(F.lit("RESCORED")).alias("outcome"),
        F.col("__retag").alias("reasons"),
        F.when(~retag, F.col("decision_status")).alias("decision_status"),
        F.when(~retag, F.col("evidence_grade")).alias("evidence_grade"),
    )


