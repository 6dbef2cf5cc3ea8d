"""Numeric consistency of claims against observations, in exact integers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType

from claimgrove.functions.arrays import first_reason
from claimgrove.functions.numbers import (
    INTEGER,
    decimal_text,
    decimals_shown,
    display,
    number_text,
    plus,
    power10,
    reduce_fraction,
    times,
    twice_shown,
)
from claimgrove.functions.periods import is_supported_period
from claimgrove.functions.text import SPACE, axis_cues, let
from claimgrove.operators.claims import DOC

# --- fixed values: dimensions and kinds --------------------------------------------------
DIMENSIONS = (
    "metric_raw",
    "scope",
    "subject",
    "scope2_basis",
    "organizational_boundary",
    "unit_canonical",
    "denominator",
)
KINDS = ("comparison", "sum", "growth", "reduction", "product_reduction")
CLAIM_ROLES = {
    "metric": "metric_raw",
    "entity": "subject",
    "reporting_period": "reporting_period",
    "scope": "scope",
    "boundary": "organizational_boundary",
}
UNSUPPORTED = r"(?iU)목표|계획|예정|원단위|집약도|\b(?:target|goal|intensity)\b"
NUMBER = r"[+-]?(?:[0-9]{1,3}(?:,[0-9]{3})+|[0-9]+)(?:\.[0-9]+)?"
# --- end of fixed values -----------------------------------------------------------------


def scaled(number: Column, digits: Column) -> Column:
    """Displayed number (see `display`) as struct<lo, mid, hi> integers over 2 * 10^digits.

    A part is null when it needs more than 38 digits. Bound once: as a plain struct, its parts
    would be computed anew at every mention.
    """
    at = lambda v, step: times(plus(v["twice"], F.lit(step)), v["scale"])
    number = F.struct(number["twice"].alias("twice"), power10(digits - number["digits"]).alias("scale"))
    return let(number, lambda v: F.struct(at(v, -1).alias("lo"), at(v, 0).alias("mid"), at(v, 1).alias("hi")))


def scaled_sum(cells: Column, digits: Column) -> Column:
    """Sum of array<struct<twice, digits, n>> as struct<lo, mid, hi>; `n` numbers sum to `twice`."""
    zero = F.lit(0).cast(INTEGER)

    def add(total: Column, cell: Column) -> Column:
        scale = power10(digits - cell["digits"])
        part = lambda name, step: plus(
            total[name], times(plus(cell["twice"], step * cell["n"]), scale)
        ).alias(name)
        return F.struct(part("lo", -1), part("mid", 0), part("hi", 1))

    start = F.struct(zero.alias("lo"), zero.alias("mid"), zero.alias("hi"))
    return F.aggregate(cells, start, add)


def check_numeric(
    bindings: DataFrame, observations: DataFrame, doc: Sequence[str] = DOC, small_docs: bool = False
) -> DataFrame:
    """Verdict per binding: consistent, inconsistent, not_comparable, not_computable.

    Gates run in fixed order and the first failure gives the reason. Interval
    tests are cross-multiplied integers, so no quotient is rounded; operands are aligned to
    the longest decimals among them, and one beyond 38 digits ends as `precision_exceeded`.
    A claim may have several bindings, each with a verdict of its own; equal ones give one.
    With `small_docs` every observation of a document is tried for each operand: for documents
    of few observations, whose rows the caller has dealt out by document and which then stay there.

    `bindings`: doc, claim_id, kind, observation_ids, reported_value, the
    dimensions, unit, reporting_period, baseline_period, quantity_kind, and the
    upstream verdicts claim_verified, product_accepted, aggregation_accepted,
    baseline_subject. `observations`: doc, observation_id, dimensions,
    reporting_period, value_decimal, value_state, value_source_id,
    issue_open, notes_open.
    """
    doc = list(doc)
    # Every step has columns of its own here, so that none is computed anew where it is mentioned twice.
    obs = observations.select(
        *doc,
        "observation_id",
        *[F.col(d).alias(f"o_{d}") for d in (*DIMENSIONS, "reporting_period")],
        number_text(F.col("value_raw")).alias("text"),
        "value_state",
        "value_source_id",
        "issue_open",
        "notes_open",
    )
    obs = obs.withColumns(
        {
            "found": F.lit(True),
            "is_number": F.col("text").isNotNull(),
            "twice": twice_shown(F.col("text")),
            "decimals": decimals_shown(F.col("text")),
        }
    ).drop("text")
    kind = F.col("kind")
    temporal = kind.isin("growth", "reduction")
    product = kind == "product_reduction"
    periods_ok = is_supported_period(F.col("reporting_period")) & (
        ~temporal | is_supported_period(F.col("baseline_period"))
    )
    same_period = F.col("baseline_period").eqNullSafe(F.col("reporting_period"))
    period_relation = F.when(temporal, ~same_period).when(product, same_period).otherwise(F.lit(True))
    product_ok = ~product | F.coalesce(
        F.col("product_accepted") & (F.col("subject") != F.col("baseline_subject")), F.lit(False)
    )
    named = F.coalesce((F.col("unit") != "") & (F.col("metric_raw") != ""), F.lit(False))
    quantity_ok = ((F.col("quantity_kind") == "absolute") & F.col("denominator").isNull()) | (
        (F.col("quantity_kind") == "intensity") & (F.col("denominator") != "")
    )
    unit_ok = ~(F.contains(F.col("unit"), F.lit("/")) & F.col("denominator").isNull())
    own = {
        "n_wanted": F.size("observation_ids"),
        "verified": F.coalesce("claim_verified", F.lit(False)),
        "periods_ok": periods_ok,
        "product_ok": product_ok,
        "own_ok": period_relation & named & F.coalesce(quantity_ok, F.lit(False)) & F.coalesce(unit_ok, F.lit(False)),
        "additive": F.coalesce("aggregation_accepted", F.lit(False)),
    }
    expected = [F.col(d).alias(f"e_{d}") for d in DIMENSIONS if d not in ("unit_canonical", "subject")]
    # The bindings of one claim are told apart by a hash of all their columns.
    nested = [f.name for f in bindings.schema.fields if isinstance(f.dataType, (ArrayType, MapType, StructType))]
    flat = [F.col(c) for c in bindings.columns if c not in nested]
    identity = [F.to_json(F.struct(*nested), {"ignoreNullFields": "false"}), *(x for c in flat for x in (c.isNull(), c))]
    exploded = bindings.distinct().withColumns({"__binding": F.xxhash64(*identity), **own})
    exploded = exploded.withColumn("claim", F.struct("kind", "reported_value", *own)).select(
        *doc,
        "claim_id",
        "__binding",
        "claim",
        *expected,
        F.col("unit").alias("e_unit_canonical"),
        F.col("subject").alias("e_subject"),
        F.when(product, F.col("baseline_subject")).otherwise(F.col("subject")).alias("first_subject"),
        F.col("reporting_period").alias("e_reporting_period"),
        F.when(temporal, F.col("baseline_period")).otherwise(F.col("reporting_period")).alias("first_period"),
        F.posexplode_outer("observation_ids").alias("pos", "observation_id"),
    )
    first = F.coalesce("pos", F.lit(0)) == 0
    exploded = exploded.withColumns(
        {
            "claim": F.when(first, F.col("claim")),  # once per binding
            "e_subject": F.when(first, F.col("first_subject")).otherwise(F.col("e_subject")),
            "e_reporting_period": F.when(first, F.col("first_period")).otherwise(F.col("e_reporting_period")),
        }
    ).drop("first_subject", "first_period")
    if small_docs:
        # A range, as an equality would be a key of the join, by which all rows are dealt out anew.
        obs = obs.select(*[F.col(c).alias(f"o_{c}") if c in (*doc, "observation_id") else c for c in obs.columns])
        equal = [F.col(d) == F.col(f"o_{d}") for d in doc]
        joined = exploded.join(obs, [*equal, F.col("observation_id").between(F.col("o_observation_id"), F.col("o_observation_id"))], "left")
    else:
        joined = exploded.join(obs, [*doc, "observation_id"], "left")
    same = F.lit(True)
    for name in (*DIMENSIONS, "reporting_period"):
        same = same & F.col(f"o_{name}").eqNullSafe(F.col(f"e_{name}"))
    # Keys begin with the document: rows that the caller has dealt out by it are not moved again.
    folded = joined.groupBy(*doc, "claim_id", "__binding").agg(
        F.first("claim", ignorenulls=True).alias("claim"),
        F.count_if(F.coalesce("found", F.lit(False))).alias("n_found"),
        F.coalesce(F.bool_or("issue_open"), F.lit(False)).alias("issue_open"),
        F.coalesce(F.bool_or("notes_open"), F.lit(False)).alias("notes_open"),
        F.bool_and(
            F.coalesce((F.col("value_state") == "value") & F.col("is_number"), F.lit(False))
        ).alias("values_ok"),
        F.bool_or(F.coalesce("is_number", F.lit(False)) & F.col("twice").isNull()).alias("too_long"),
        F.bool_and(F.coalesce(same, F.lit(False))).alias("dimensions_ok"),
        # As many as the binding names. A distinct count would double the rows.
        F.collect_list(
            F.when(
                F.col("found"),
                F.struct("pos", "twice", F.col("decimals").alias("digits"), F.col("value_source_id").alias("cell")),
            )
        ).alias("operands"),
    )
    operand = lambda k: F.get(F.filter("operands", lambda o: (o["pos"] == k) & o["twice"].isNotNull()), F.lit(0))
    n_cells = F.size(F.array_compact(F.array_distinct(F.transform("operands", lambda o: o["cell"]))))
    rows = folded.select(
        *doc,
        "claim_id",
        "claim.*",
        *[c for c in folded.columns if c not in (*doc, "claim_id", "__binding", "claim")],
        number_text(F.col("claim.reported_value")).alias("text"),
        operand(0).alias("first"),
        operand(1).alias("second"),
    )
    rows = rows.withColumns({"twice": twice_shown(F.col("text")), "decimals": decimals_shown(F.col("text"))})
    longest = F.array_max(F.transform("operands", lambda o: F.when(o["twice"].isNotNull(), o["digits"])))
    rows = rows.withColumn("digits", F.greatest(longest, F.when(F.col("twice").isNotNull(), F.col("decimals"))))
    ones = F.transform(
        "operands",
        lambda o: F.struct(o["twice"].alias("twice"), o["digits"].alias("digits"), F.lit(1).alias("n")),
    )
    summed = (kind == "sum") & ~F.coalesce("too_long", F.lit(False))
    rows = rows.withColumns(
        {
            "power": power10(F.col("digits")),
            "unit_scale": times(power10(F.col("digits")), F.when(kind == "growth", F.lit(200)).otherwise(F.lit(-200))),
            "shown_scale": power10(F.col("digits") - F.col("decimals")),
            "first_scale": power10(F.col("digits") - F.col("first.digits")),
            "second_scale": power10(F.col("digits") - F.col("second.digits")),
            "total": F.when(summed, scaled_sum(ones, F.col("digits"))),
        }
    )
    parts = {"shown": F.col("twice"), "first": F.col("first.twice"), "second": F.col("second.twice")}
    rows = rows.withColumns({f"{part}_mid": times(twice, F.col(f"{part}_scale")) for part, twice in parts.items()})
    half = lambda part: F.col(f"{part}_scale")
    rows = rows.withColumns(
        {
            **{f"{part}_lo": plus(F.col(f"{part}_mid"), -half(part)) for part in parts},
            **{f"{part}_hi": plus(F.col(f"{part}_mid"), half(part)) for part in parts},
        }
    )
    direct = kind.isin("comparison", "sum")
    # growth g = 100 (c - b) / b, reduction r = 100 (b - c) / b. Both sides carry
    # the factor 2 * 10^D, which cancels in the ratio but not in the reported value:
    #   g <= R / (2 * 10^D)  <=>  200 * 10^D * (c - b) <= R * b   (b > 0)
    ratio = lambda value: F.when(~F.coalesce(direct, F.lit(False)), value)
    side = lambda b, c: times(plus(c, -b), F.col("unit_scale"))
    corners = [(x, y) for x in ("lo", "hi") for y in ("lo", "hi")]
    of = lambda part, x: F.col(f"{part}_{x}")
    rows = rows.withColumns(
        {
            **{f"side_{x}_{y}": ratio(side(of("first", x), of("second", y))) for x, y in corners},
            **{f"most_{x}": ratio(times(of("shown", "hi"), of("first", x))) for x in ("lo", "hi")},
            **{f"least_{x}": ratio(times(of("shown", "lo"), of("first", x))) for x in ("lo", "hi")},
        }
    )
    total = lambda x: F.when(kind == "sum", F.col(f"total.{x}")).otherwise(of("first", x))
    positive = lambda x: of("first", x) > 0
    rows = rows.withColumns(
        {
            "direct_mid": total("mid"),
            "direct_fits": (total("lo") <= of("shown", "hi")) & (of("shown", "lo") <= total("hi")),
            "below": F.array(
                *[F.when(positive(x), of("side", f"{x}_{y}") <= of("most", x)).otherwise(of("side", f"{x}_{y}") >= of("most", x)) for x, y in corners]
            ),
            "above": F.array(
                *[F.when(positive(x), of("side", f"{x}_{y}") >= of("least", x)).otherwise(of("side", f"{x}_{y}") <= of("least", x)) for x, y in corners]
            ),
        }
    )
    known = F.forall("below", lambda t: t.isNotNull()) & F.forall(F.slice("above", 2, 3), lambda t: t.isNotNull())
    met = lambda tests: F.exists(tests, lambda t: t)
    overlap = F.when(direct, F.col("direct_fits")).otherwise(F.when(known, met("below") & met("above")))
    zero_base = kind.isin("growth", "reduction", "product_reduction") & (
        (F.col("first_lo") <= 0) & (F.col("first_hi") >= 0)
    )
    gates = first_reason(
        (F.col("n_found") < F.coalesce("n_wanted", F.lit(0)), "observation_missing"),
        (~F.col("verified"), "claim_source_unresolved"),
        (F.col("issue_open"), "source_issue_unresolved"),
        (F.col("notes_open"), "footnote_conditions_unresolved"),
        (
            # A text may be no number at all, or a number too long to compute with.
            F.col("text").isNull() | ~F.coalesce("values_ok", F.lit(False)),
            "value_missing_or_unresolved",
        ),
        (~F.col("periods_ok"), "reporting_period_unresolved"),
        (~F.col("product_ok"), "product_comparison_unaccepted"),
        (~F.col("own_ok") | ~F.coalesce("dimensions_ok", F.lit(False)), "dimension_mismatch"),
        (
            (kind == "sum") & (~F.col("additive") | (n_cells != F.col("n_wanted"))),
            "aggregation_relation_unresolved",
        ),
        (F.coalesce(zero_base, F.lit(False)), "zero_baseline_interval"),
    )
    rows = rows.withColumn("overlap", overlap).withColumn(
        "__reason", F.coalesce(gates, F.when(F.col("overlap").isNull(), F.lit("precision_exceeded")))
    )
    open_ = F.col("__reason").isNull()
    # Exact quotient, only for rows that reached a verdict; with a power of ten below it is a plain text.
    tenths = times(F.col("direct_mid"), F.lit(5))
    plain = F.when(open_ & direct & F.col("power").isNotNull(), decimal_text(tenths, F.col("digits") + 1))
    rows = rows.withColumn("plain", plain)
    divided = open_ & F.col("plain").isNull()
    hundred = F.when(kind == "growth", F.lit(100)).otherwise(F.lit(-100))
    change = times(plus(F.col("second_mid"), -F.col("first_mid")), hundred)
    rows = rows.withColumns(
        {
            "over": F.when(divided, F.when(direct, F.col("direct_mid")).otherwise(change)),
            "under": F.when(divided, F.when(direct, times(F.col("power"), F.lit(2))).otherwise(F.col("first_mid"))),
        }
    )
    rows = rows.withColumn("__exact", reduce_fraction(F.col("over"), F.col("under")))
    comparable = F.col("__reason").isin(
        "reporting_period_unresolved",
        "dimension_mismatch",
        "product_comparison_unaccepted",
        "aggregation_relation_unresolved",
    )
    status = (
        F.when(comparable, F.lit("not_comparable"))
        .when(~open_, F.lit("not_computable"))
        .when(F.col("overlap"), F.lit("consistent"))
        .otherwise(F.lit("inconsistent"))
    )
    computed = F.coalesce("plain", "__exact.decimal")
    recurring = open_ & computed.isNull()
    return rows.select(
        *doc,
        "claim_id",
        "kind",
        status.alias("status"),
        "reported_value",
        computed.alias("computed"),
        F.when(recurring, F.col("__exact.numerator")).alias("numerator"),
        F.when(recurring, F.col("__exact.denominator")).alias("denominator_exact"),
        F.coalesce(
            "__reason", F.when(recurring, F.lit("non_terminating_decimal"))
        ).alias("reason"),
    )


def propose_bindings(
    claims: DataFrame, observations: DataFrame, doc: Sequence[str] = DOC
) -> DataFrame:
    """Literal comparison proposals: claims joined to observations on five dimensions.

    `claims`: doc, claim_id, quote, claim_verified and dims MAP<role, text>.
    0, 1 or several matches give distinct reasons; several are never picked
    from. Output: claim_id, n_matches, observation_id, reported_value, reasons.
    """
    doc = list(doc)
    dims = F.col("dims")
    role = lambda r: F.try_element_at(dims, F.lit(r))
    extra = F.size(F.array_except(F.map_keys(dims), F.array(*[F.lit(r) for r in CLAIM_ROLES]))) > 0
    cue = lambda axis: F.size(
        F.array_except(
            axis_cues(F.col("quote"), axis), axis_cues(F.coalesce(role(axis), F.lit("")), axis)
        )
    ) > 0
    before = F.array_distinct(
        F.array_compact(
            F.concat(
                F.array(
                    *[
                        F.when(
                            role(r).isNull() | (role(r) == ""), F.lit(f"dimension_unresolved:{r}")
                        )
                        for r in ("metric", "entity", "reporting_period")
                    ]
                ),
                F.transform(
                    F.filter(F.map_entries(dims), lambda e: e["value"].isNull()),
                    lambda e: F.concat(F.lit("dimension_unresolved:"), e["key"]),
                ),
                F.array(
                    F.when(
                        ~F.coalesce(F.col("claim_verified"), F.lit(False)),
                        F.lit("claim_source_unresolved"),
                    ),
                    F.when(cue("scope"), F.lit("dimension_unresolved:scope")),
                    F.when(cue("boundary"), F.lit("dimension_unresolved:boundary")),
                    F.when(
                        F.col("quote").rlike(UNSUPPORTED),
                        F.lit("target_or_intensity_requires_reviewed_input"),
                    ),
                    F.when(extra, F.lit("additional_dimensions_require_reviewed_input")),
                ),
            )
        )
    )
    open_claims = claims.withColumn("__before", before).withColumns(
        {f"k_{r}": role(r) for r in CLAIM_ROLES}
    )
    side = observations.select(
        *doc,
        *[F.col(c).alias(f"k_{r}") for r, c in CLAIM_ROLES.items()],
        "observation_id",
        "value_state",
        "unit_canonical",
        "scale_multiplier",
        "denominator",
        F.col("quality").alias("o_quality"),
    ).alias("o")
    ready = open_claims.filter(F.size("__before") == 0).select(
        *doc, "claim_id", "quote", *[f"k_{r}" for r in CLAIM_ROLES]
    ).alias("c")
    condition = None
    for name in [*doc, *[f"k_{r}" for r in CLAIM_ROLES]]:
        # Identity columns are never null; dimensions compare null-safe.
        left, right = F.col(f"c.{name}"), F.col(f"o.{name}")
        test = (left == right) if name in doc else left.eqNullSafe(right)
        condition = test if condition is None else condition & test
    matched = ready.join(side, condition).select(
        *[F.col(f"c.{d}").alias(d) for d in doc],
        "c.claim_id",
        "c.quote",
        "o.observation_id",
        "o.value_state",
        "o.unit_canonical",
        "o.scale_multiplier",
        "o.denominator",
        "o.o_quality",
    )
    # Number directly followed by the unit of the observation, whole in the text.
    numbers = F.regexp_extract_all(
        "quote",
        F.concat(
            F.lit(f"((?<![0-9.,]){NUMBER})[{SPACE}]*"),
            F.lit("\\Q"),
            F.col("unit_canonical"),
            F.lit("\\E(?=$|["), F.lit(SPACE), F.lit(".,;)])"),
        ),
        1,
    )
    checked = matched.withColumns(
        {
            "__numbers": F.when(F.col("unit_canonical").isNotNull(), numbers),
            "__why": first_reason(
                (
                    F.col("value_state") != "value",
                    F.concat(F.lit("value_state:"), F.col("value_state")),
                ),
                (
                    (F.coalesce("denominator", F.lit("")) != "")
                    | F.contains(F.coalesce("unit_canonical", F.lit("")), F.lit("/")),
                    "target_or_intensity_requires_reviewed_input",
                ),
                (
                    F.col("unit_canonical").isNull()
                    | (F.col("unit_canonical") == "")
                    | (F.col("scale_multiplier") != "1"),
                    "unit_missing_or_scale_requires_reviewed_input",
                ),
            ),
        }
    )
    checked = checked.withColumn(
        "__why",
        F.coalesce(
            "__why",
            F.when(
                F.size("__numbers") != 1, F.lit("number_unit_span_missing_or_ambiguous")
            ),
        ),
    )
    folded = checked.groupBy(*doc, "claim_id").agg(
        F.count("*").alias("n_matches"),
        F.min("observation_id").alias("observation_id"),
        F.min(F.when(F.col("__why").isNull(), F.get("__numbers", F.lit(0)))).alias("reported_value"),
        F.min("__why").alias("__why"),
        F.bool_or(F.coalesce(F.col("o_quality") != "verified", F.lit(True))).alias("__raw"),
    )
    out = open_claims.join(folded, [*doc, "claim_id"], "left")
    n = F.coalesce("n_matches", F.lit(0))
    bound = (n == 1) & F.col("__why").isNull() & F.col("reported_value").isNotNull()
    reasons = F.array_compact(
        F.concat(
            F.col("__before"),
            F.array(
                F.when(F.size("__before") == 0, F.col("__why")),
                F.when(n == 0, F.lit("no_exact_metric_year_entity_scope_boundary_observation")),
                F.when(F.col("__raw"), F.lit("observation_source_unresolved")),
                F.when(n > 1, F.lit("multiple_observations_require_reviewed_input")),
                F.when(bound, F.lit("explicit_review_required")),
                F.when(bound, F.lit("quantity_role_not_automatically_accepted")),
            ),
        )
    )
    return out.select(
        *doc,
        "claim_id",
        n.alias("n_matches"),
        F.when(bound, F.col("observation_id")).alias("observation_id"),
        F.when(bound, F.col("reported_value")).alias("reported_value"),
        reasons.alias("reasons"),
    )


def check_sum(
    reported: DataFrame, components: DataFrame, key: Sequence[str] = ("claim_id",)
) -> DataFrame:
    """Disjoint-sum check in long form: reported total against its components.

    Bounds are summed as integers (partial aggregation, any number of
    components). The same source cell must not count twice. `reported`: key,
    reported_value; `components`: key, value_raw, value_source_id.
    """
    key = list(key)
    number = number_text(F.col("value_raw"))
    shown = display(F.col("value_raw"))
    cells = components.select(
        *key,
        "value_source_id",
        number.isNull().alias("bad"),
        (number.isNotNull() & shown.isNull()).alias("long"),
        shown["twice"].alias("twice"),
        shown["digits"].alias("digits"),
    )
    once = cells.groupBy(*key, "value_source_id").agg(
        F.count("*").alias("repeats"),
        F.bool_or("bad").alias("bad"),
        F.bool_or("long").alias("long"),
        F.min("twice").alias("twice"),
        F.min("digits").alias("digits"),
    )
    # Numbers with equally many decimals add up first; at most 38 such sums meet in a row.
    level = once.groupBy(*key, "digits").agg(
        F.count("*").alias("n"),
        F.max("repeats").alias("repeats"),
        F.bool_or("bad").alias("bad"),
        F.bool_or("long").alias("long"),
        F.try_sum("twice").alias("twice"),
    )
    sums = level.groupBy(*key).agg(
        F.max("repeats").alias("repeats"),
        F.sum("n").alias("n_components"),
        F.bool_or("bad").alias("bad"),
        F.bool_or("long").alias("long"),
        F.max("digits").alias("longest"),
        F.collect_list(F.struct(F.col("twice").cast(INTEGER).alias("twice"), "digits", "n")).alias("parts"),
    )
    rows = reported.withColumn("shown", display(F.col("reported_value"))).join(sums, key, "left")
    rows = rows.withColumn("digits", F.greatest("longest", F.col("shown.digits")))
    rows = rows.withColumns(
        {
            "r": scaled(F.col("shown"), F.col("digits")),
            "total": F.when(~F.col("bad") & ~F.col("long"), scaled_sum(F.col("parts"), F.col("digits"))),
        }
    ).withColumns({"lo": F.col("total.lo"), "hi": F.col("total.hi")})
    unresolved = F.col("bad") | number_text(F.col("reported_value")).isNull()
    reason = first_reason(
        (F.col("n_components").isNull(), "observation_missing"),
        (unresolved, "value_missing_or_unresolved"),
        (F.col("repeats") > 1, "aggregation_relation_unresolved"),
        (
            F.col("lo").isNull() | F.col("hi").isNull() | F.col("r.lo").isNull() | F.col("r.hi").isNull(),
            "precision_exceeded",
        ),
    )
    overlap = (F.col("lo") <= F.col("r.hi")) & (F.col("r.lo") <= F.col("hi"))
    status = (
        F.when(reason == "aggregation_relation_unresolved", F.lit("not_comparable"))
        .when(reason.isNotNull(), F.lit("not_computable"))
        .when(overlap, F.lit("consistent"))
        .otherwise(F.lit("inconsistent"))
    )
    return rows.select(
        *key,
        F.coalesce("n_components", F.lit(0)).alias("n_components"),
        status.alias("status"),
        reason.alias("reason"),
    )
