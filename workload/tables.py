"""Tables, numbers, reconciliation, assurance and source queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimgrove.operators import assurance, numeric, reconcile, tables
from claimgrove.sources import filings, graphs, inputs, sinks, statements
from claimgrove.session import cut_lineage, small_side
from workload.common import cents, query, read

# ---------------------------------------------------------------- tables

_REVENUE = """
rev AS (SELECT n_regionkey, n_nationkey, n_name, year(o_orderdate) AS y, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS c
        FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY ALL)
"""


def _revenue(spark, folder):
    """Revenue cents per nation and year."""
    return (
        read(spark, folder, "orders")
        .join(read(spark, folder, "customer"), F.col("c_custkey") == F.col("o_custkey"))
        .join(small_side(read(spark, folder, "nation")), F.col("n_nationkey") == F.col("c_nationkey"))
        .groupBy("n_regionkey", "n_nationkey", "n_name", F.year("o_orderdate").alias("y"))
        .agg(F.sum(cents("o_totalprice")).alias("c"))
    )


def _money(c):
    return F.concat(F.floor(c / 100), F.lit("."), F.lpad((c % 100).cast("string"), 2, "0"))


def _region_tables(spark, folder):
    """One table per region: title row, header row, one row per nation."""
    rev = _revenue(spark, folder)
    first = rev.agg(F.min("y")).scalar()
    mark = (F.col("n_nationkey") + F.col("y")) % 11
    value = F.when(mark == 0, F.lit("-")).when(mark == 1, F.lit("12 kg")).otherwise(_money(F.col("c")))
    cell = lambda df, row, col, text, span=F.lit(1): df.select(
        "n_regionkey",
        row.cast("int").alias("row_number"),
        col.cast("int").alias("column_number"),
        F.lit(1).alias("row_span"),
        span.cast("int").alias("column_span"),
        text.alias("text"),
    )
    nations = read(spark, folder, "nation")
    row = F.col("n_nationkey") + 2
    unit = F.when(F.col("n_nationkey") % 5 == 0, F.lit("천 USD")).otherwise(F.lit("USD"))
    years = rev.select("n_regionkey", "y").distinct()
    regions = years.groupBy("n_regionkey").agg(F.count("*").alias("n"))
    cells = (
        cell(regions, F.lit(0), F.lit(0), F.lit("Revenue by nation"), F.col("n") + 2)
        .unionByName(cell(regions, F.lit(1), F.lit(0), F.lit("Metric")))
        .unionByName(cell(regions, F.lit(1), F.lit(1), F.lit("Unit")))
        .unionByName(cell(years, F.lit(1), F.col("y") - first + 2, F.col("y").cast("string")))
        .unionByName(cell(nations, row, F.lit(0), F.col("n_name")))
        .unionByName(cell(nations, row, F.lit(1), unit))
        .unionByName(cell(rev, row, F.col("y") - first + 2, value))
    )
    return cells.select(
        "*",
        F.concat_ws(":", "n_regionkey", "row_number", "column_number").alias("source_id"),
        F.lit("verified").alias("quality"),
        F.lit(0).alias("winner"),
    )


@query(
    "table_observations",
    f"""WITH {_REVENUE}, v AS (SELECT *, (n_nationkey + y) % 11 AS k, CASE WHEN n_nationkey % 5 = 0 THEN 1000 ELSE 1 END AS m FROM rev)
    SELECT n_regionkey, n_name AS metric_raw, CAST(y AS VARCHAR) AS reporting_period,
           CASE k WHEN 0 THEN '-' WHEN 1 THEN '12 kg' ELSE (c // 100) || '.' || lpad(CAST(c % 100 AS VARCHAR), 2, '0') END AS value_raw,
           CASE k WHEN 0 THEN 'missing' WHEN 1 THEN 'conflict' ELSE 'value' END AS value_state,
           CASE WHEN k > 1 THEN (c * m // 100) || '.' || lpad(CAST((c * m) % 100 AS VARCHAR), 2, '0') END AS value_decimal,
           CASE WHEN k = 1 AND m = 1000 THEN '천 USD' ELSE 'USD' END AS unit_canonical FROM v""",
)
def table_observations(spark, folder):
    """Wide region tables (title, header, units) normalised to observations."""
    key = ["n_regionkey"]
    cells = cut_lineage(_region_tables(spark, folder))
    grid, _ = tables.expand_grid(cells, key)
    columns, shape, _ = tables.detect_headers(grid, key)
    out = tables.unpivot_table(grid, columns, shape, table=key)
    return out.select(
        "n_regionkey", "metric_raw", "reporting_period", "value_raw", "value_state", "value_decimal", "unit_canonical"
    )


_PART_CELLS = """
c AS (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS i, p_size FROM part),
k AS (SELECT p_brand, p_partkey AS id, i // 4 AS r, i % 4 AS col, CASE WHEN p_size > 48 THEN 2 ELSE 1 END AS rs FROM c),
g AS (SELECT p_brand, id, CAST(unnest(generate_series(r, r + rs - 1)) AS BIGINT) AS row, CAST(col AS BIGINT) AS col FROM k),
bad AS (SELECT DISTINCT p_brand FROM (SELECT p_brand, row, col FROM g GROUP BY ALL HAVING count(*) > 1))
"""


@query(
    "table_grid",
    f"WITH {_PART_CELLS} SELECT g.p_brand, id AS source_id, row, col FROM g WHERE p_brand NOT IN (SELECT p_brand FROM bad)",
)
def table_grid(spark, folder):
    """Span expansion of brand tables; overlapping tables drop out."""
    grid, _ = tables.expand_grid(_part_cells(spark, folder), ["p_brand"])
    return grid.select("p_brand", "source_id", F.col("row").cast("bigint").alias("row"), F.col("col").cast("bigint").alias("col"))


@query(
    "table_grid_issues",
    f"WITH {_PART_CELLS} SELECT p_brand, 'cells_overlap' AS reason FROM bad",
)
def table_grid_issues(spark, folder):
    _, issues = tables.expand_grid(_part_cells(spark, folder), ["p_brand"])
    return issues


def _part_cells(spark, folder):
    from claimgrove.operators.ordered import numbered

    p = numbered(
        read(spark, folder, "part").select("p_brand", "p_partkey", "p_size"),
        ["p_brand"], ["p_partkey"], "i", F.floor(F.col("p_partkey") / 500),
    )
    i = F.col("i") - 1
    return p.select(
        "p_brand",
        F.col("p_partkey").alias("source_id"),
        F.floor(i / 4).cast("int").alias("row_number"),
        (i % 4).cast("int").alias("column_number"),
        F.when(F.col("p_size") > 48, 2).otherwise(1).alias("row_span"),
        F.lit(1).alias("column_span"),
    )


@query(
    "wide_to_long",
    """WITH w AS (SELECT l_suppkey, CAST(sum(l_quantity) FILTER (l_returnflag = 'A') AS BIGINT) AS thstrm_amount,
                    CAST(sum(l_quantity) FILTER (l_returnflag = 'N') AS BIGINT) AS frmtrm_amount,
                    CAST(sum(l_quantity) FILTER (l_returnflag = 'R') AS BIGINT) AS bfefrmtrm_amount FROM lineitem GROUP BY 1)
    SELECT l_suppkey, thstrm_amount AS amount_raw, 'current' AS period FROM w
    UNION ALL SELECT l_suppkey, frmtrm_amount, 'previous' FROM w UNION ALL SELECT l_suppkey, bfefrmtrm_amount, 'before_previous' FROM w""",
)
def wide_to_long(spark, folder):
    """Three amount columns per supplier as one row per period."""
    q = F.col("l_quantity")
    wide = read(spark, folder, "lineitem").groupBy("l_suppkey").agg(
        *[
            F.sum(F.when(F.col("l_returnflag") == f, q)).cast("bigint").alias(name)
            for f, name in (("A", "thstrm_amount"), ("N", "frmtrm_amount"), ("R", "bfefrmtrm_amount"))
        ]
    )
    return tables.unpivot_statement(wide, ["l_suppkey"])


# ---------------------------------------------------------------- numbers


@query(
    "numeric_sum_check",
    """WITH l AS (SELECT l_orderkey, l_linenumber, l_suppkey, CAST(round(l_extendedprice * 100) AS BIGINT) AS c FROM lineitem),
    s AS (SELECT l_orderkey, count(*) AS n, max(k) AS repeats, sum(2 * c - 1) AS lo, sum(2 * c + 1) AS hi FROM
            (SELECT l_orderkey, l_linenumber, min(c) AS c, count(*) AS k FROM l GROUP BY ALL) GROUP BY 1),
    t AS (SELECT l_orderkey, sum(c) AS c FROM l GROUP BY 1),
    r AS (SELECT o_orderkey, coalesce(c // 100, 0) + CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END AS v FROM orders LEFT JOIN t ON l_orderkey = o_orderkey)
    SELECT o_orderkey, coalesce(n, 0) AS n_components,
           CASE WHEN n IS NULL THEN 'not_computable' WHEN repeats > 1 THEN 'not_comparable' WHEN lo <= (2 * v + 1) * 100 AND (2 * v - 1) * 100 <= hi THEN 'consistent' ELSE 'inconsistent' END AS status,
           CASE WHEN n IS NULL THEN 'observation_missing' WHEN repeats > 1 THEN 'aggregation_relation_unresolved' END AS reason
    FROM r LEFT JOIN s ON l_orderkey = o_orderkey""",
)
def numeric_sum_check(spark, folder):
    """Order totals, shown without decimals, against the sum of their lines."""
    lines = read(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("o_orderkey"), F.col("l_linenumber").alias("value_source_id"), cents("l_extendedprice").alias("c")
    )
    total = lines.groupBy("o_orderkey").agg(F.sum("c").alias("c"))
    bump = F.when(F.col("o_orderkey") % 3 == 0, 1).otherwise(0)
    shown = F.coalesce(F.floor(F.col("c") / 100), F.lit(0)) + bump
    reported = (
        read(spark, folder, "orders").select("o_orderkey").join(total, "o_orderkey", "left")
        .select("o_orderkey", shown.cast("string").alias("reported_value"))
    )
    components = lines.select("o_orderkey", "value_source_id", _money(F.col("c")).alias("value_raw"))
    return numeric.check_sum(reported, components, ["o_orderkey"])


_GROWTH = f"""
{_REVENUE},
g AS (SELECT n_nationkey, y, c, lag(c) OVER (PARTITION BY n_nationkey ORDER BY y) AS b FROM rev),
h AS (SELECT *, ((c - b) * 1000) // b + n_nationkey % 3 AS t FROM g)
"""


@query(
    "growth_check",
    f"""WITH {_GROWTH}, k AS (SELECT n_nationkey, y, t, 2 * b - 1 AS b1, 2 * b + 1 AS b2, 2 * c - 1 AS c1, 2 * c + 1 AS c2, b FROM h),
    v AS (SELECT *, (2000::HUGEINT * (c1 - b1) <= (2 * t + 1)::HUGEINT * b1 OR 2000::HUGEINT * (c1 - b2) <= (2 * t + 1)::HUGEINT * b2
                 OR 2000::HUGEINT * (c2 - b1) <= (2 * t + 1)::HUGEINT * b1 OR 2000::HUGEINT * (c2 - b2) <= (2 * t + 1)::HUGEINT * b2) AS below,
                 (2000::HUGEINT * (c1 - b1) >= (2 * t - 1)::HUGEINT * b1 OR 2000::HUGEINT * (c1 - b2) >= (2 * t - 1)::HUGEINT * b2
                 OR 2000::HUGEINT * (c2 - b1) >= (2 * t - 1)::HUGEINT * b1 OR 2000::HUGEINT * (c2 - b2) >= (2 * t - 1)::HUGEINT * b2) AS above FROM k)
    SELECT CAST(n_nationkey * 10000 + y AS BIGINT) AS claim_id, CASE WHEN b IS NULL THEN 'not_computable' WHEN below AND above THEN 'consistent' ELSE 'inconsistent' END AS status,
           b IS NULL AS missing FROM v""",
)
def growth_check(spark, folder):
    """Reported yearly growth (one decimal) of every nation against its revenue."""
    rev = _revenue(spark, folder)
    doc = [F.lit("t").alias("tenant_id"), F.lit("d").alias("document_version_id")]
    dims = lambda unit: [
        F.lit("revenue").alias("metric_raw"),
        F.lit(None).cast("string").alias("scope"),
        F.col("n_name").alias("subject"),
        F.lit(None).cast("string").alias("scope2_basis"),
        F.lit(None).cast("string").alias("organizational_boundary"),
        F.lit(None).cast("string").alias("denominator"),
        F.lit("USD").alias(unit),
    ]
    oid = lambda y: (F.col("n_nationkey") * 10000 + y).cast("string")
    observations = rev.select(
        *doc,
        oid(F.col("y")).alias("observation_id"),
        *dims("unit_canonical"),
        F.col("y").cast("string").alias("reporting_period"),
        _money(F.col("c")).alias("value_raw"),
        F.lit("value").alias("value_state"),
        oid(F.col("y")).alias("value_source_id"),
        F.lit(False).alias("issue_open"),
        F.lit(False).alias("notes_open"),
    )
    prior = rev.select("n_nationkey", (F.col("y") + 1).alias("y"), F.col("c").alias("b"))
    both = rev.join(prior, ["n_nationkey", "y"], "left")
    tenths = F.expr("((c - b) * 1000) div b") + F.col("n_nationkey") % 3
    sign = F.when(tenths < 0, F.lit("-")).otherwise(F.lit(""))
    shown = F.concat(sign, F.floor(F.abs(tenths) / 10), F.lit("."), F.abs(tenths) % 10)
    bindings = both.select(
        *doc,
        (F.col("n_nationkey") * 10000 + F.col("y")).cast("bigint").alias("claim_id"),
        F.lit("growth").alias("kind"),
        F.array(oid(F.col("y") - 1), oid(F.col("y"))).alias("observation_ids"),
        F.coalesce(shown, F.lit("0.0")).alias("reported_value"),
        *dims("unit"),
        F.col("y").cast("string").alias("reporting_period"),
        (F.col("y") - 1).cast("string").alias("baseline_period"),
        F.lit("absolute").alias("quantity_kind"),
        F.lit(True).alias("claim_verified"),
        F.lit(False).alias("product_accepted"),
        F.lit(False).alias("aggregation_accepted"),
        F.lit(None).cast("string").alias("baseline_subject"),
    )
    out = numeric.check_numeric(bindings, observations)
    return out.select("claim_id", "status", F.coalesce(F.col("reason") == "observation_missing", F.lit(False)).alias("missing"))


@query(
    "binding_proposals",
    f"""WITH {_REVENUE}, o AS (SELECT n_name, CAST(y AS VARCHAR) AS period, count(*) AS n FROM rev GROUP BY ALL)
    SELECT o_orderkey AS claim_id, coalesce(n, 0) AS n_matches, CASE WHEN n = 1 AND o_orderkey % 4 <> 0 THEN CAST(o_orderkey % 1000 AS VARCHAR) END AS reported_value
    FROM (SELECT o_orderkey, n_name, CAST(year(o_orderdate) + o_orderkey % 3 AS VARCHAR) AS period FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey)
    LEFT JOIN o USING (n_name, period)""",
)
def binding_proposals(spark, folder):
    """Claims about a nation's year joined to the one observation with equal dimensions."""
    doc = [F.lit("t").alias("tenant_id"), F.lit("d").alias("document_version_id")]
    null = F.lit(None).cast("string")
    observations = _revenue(spark, folder).select(
        *doc,
        F.lit("revenue").alias("metric_raw"),
        F.col("n_name").alias("subject"),
        F.col("y").cast("string").alias("reporting_period"),
        null.alias("scope"),
        null.alias("organizational_boundary"),
        F.concat_ws(":", "n_nationkey", "y").alias("observation_id"),
        F.lit("value").alias("value_state"),
        F.lit("MWh").alias("unit_canonical"),
        F.lit("1").alias("scale_multiplier"),
        null.alias("denominator"),
        F.lit("verified").alias("quality"),
    )
    claims = (
        read(spark, folder, "orders")
        .join(read(spark, folder, "customer"), F.col("c_custkey") == F.col("o_custkey"))
        .join(small_side(read(spark, folder, "nation")), F.col("n_nationkey") == F.col("c_nationkey"))
    )
    key = F.col("o_orderkey")
    number = (key % 1000).cast("string")
    quote = F.concat(
        F.lit("used "), number, F.when(key % 4 == 0, F.lit(" GWh")).otherwise(F.lit(" MWh")), F.lit(" in all.")
    )
    claims = claims.select(
        *doc,
        key.alias("claim_id"),
        quote.alias("quote"),
        F.lit(True).alias("claim_verified"),
        F.map_from_arrays(
            F.array(F.lit("metric"), F.lit("entity"), F.lit("reporting_period")),
            F.array(F.lit("revenue"), F.col("n_name"), (F.year("o_orderdate") + key % 3).cast("string")),
        ).alias("dims"),
    )
    return numeric.propose_bindings(claims, observations).select("claim_id", "n_matches", "reported_value")


# ---------------------------------------------------------------- reconciliation

_PACKETS = """
p AS (SELECT p_partkey AS k, p_size AS z, 'C' || (p_partkey % 4 + 1) AS item, CAST(round(p_retailprice * 100) AS BIGINT) AS cap FROM part),
x AS (SELECT *, CASE WHEN k % 9 = 0 THEN 'e1' END AS expl, CASE WHEN k % 5 = 0 THEN 'incomplete' ELSE 'complete' END AS search,
        CASE WHEN k % 23 = 0 THEN 'unknown' WHEN k % 29 = 0 THEN 'not_comparable' ELSE 'comparable' END AS cmp FROM p),
d AS (SELECT *, CASE WHEN expl IS NOT NULL THEN 'matched' WHEN search = 'complete' THEN 'needs_explanation' END AS dstat,
        CASE WHEN expl IS NOT NULL THEN CASE item WHEN 'C2' THEN 'period_difference_explained' ELSE 'difference_explained' END
             WHEN search = 'complete' THEN 'explanation_not_found' ELSE 'search_incomplete' END AS dreason FROM x),
o AS (SELECT k, item,
   CASE WHEN cmp = 'not_comparable' THEN 'not_applicable' WHEN cmp = 'unknown' THEN NULL
     WHEN item = 'C1' THEN CASE WHEN z % 7 = 0 THEN NULL WHEN z % 3 = z % 2 THEN 'matched' ELSE dstat END
     WHEN item = 'C2' THEN CASE WHEN z % 10 = 9 THEN 'not_applicable' WHEN z % 10 = 0 THEN 'matched' ELSE dstat END
     WHEN item = 'C3' THEN CASE WHEN z % 6 = 0 THEN 'not_applicable' WHEN z % 6 = 1 THEN 'matched' WHEN z * 10000 <= 3 * cap THEN 'matched' ELSE dstat END
     ELSE CASE WHEN z % 2 = 0 AND z % 3 = 0 THEN 'matched' WHEN search <> 'complete' THEN NULL ELSE 'needs_explanation' END END AS status,
   CASE WHEN cmp = 'not_comparable' THEN 'not_comparable' WHEN cmp = 'unknown' THEN 'comparability_unknown'
     WHEN item = 'C1' THEN CASE WHEN z % 7 = 0 THEN 'entity_set_empty' WHEN z % 3 = z % 2 THEN 'same_verified_entity_set' ELSE dreason END
     WHEN item = 'C2' THEN CASE WHEN z % 10 = 9 THEN 'period_out_of_scope' WHEN z % 10 = 0 THEN 'same_period' ELSE dreason END
     WHEN item = 'C3' THEN CASE WHEN z % 6 = 0 THEN 'c3_trigger_absent' WHEN z % 6 = 1 THEN 'commitment_disclosed' WHEN z * 10000 <= 3 * cap THEN 'capex_within_threshold' ELSE dreason END
     ELSE CASE WHEN z % 2 = 0 AND z % 3 = 0 THEN 'classification_basis_present' WHEN search <> 'complete' THEN 'search_incomplete'
               WHEN z % 2 = 0 THEN 'calculation_basis_not_found' WHEN z % 3 = 0 THEN 'definition_not_found' ELSE 'definition_not_found,calculation_basis_not_found' END END AS reason FROM d)
"""


def _packets(spark, folder):
    """A reconciliation row per part, its item and sides taken from key, size and price."""
    k, z = F.col("p_partkey"), F.col("p_size")
    item = F.concat(F.lit("C"), (k % 4 + 1).cast("string"))
    names = lambda n: F.array(F.lit("base"), F.concat(F.lit("e"), n.cast("string")))
    none = F.array().cast("array<string>")
    kind = (
        F.when(item == "C1", F.lit("entity_set"))
        .when(item == "C2", F.lit("period"))
        .when(item == "C3", F.lit("currency_amount"))
        .otherwise(F.lit("classification"))
    )
    side = lambda sid: F.struct(
        F.lit("raw").alias("raw"), F.lit("norm").alias("normalized"), kind.alias("kind"), F.lit("KRW").alias("unit"), F.lit(sid).alias("source_id")
    )
    period = lambda a, b: F.struct(a.cast("date").alias("start"), b.cast("date").alias("end"))
    year = period(F.lit("2024-01-01"), F.lit("2024-12-31"))
    s_period = F.when(z % 10 == 9, period(F.lit("2020-01-01"), F.lit("2020-12-31"))).otherwise(
        period(F.date_add(F.lit("2024-01-01").cast("date"), (z % 10).cast("int")), F.lit("2024-12-31"))
    )
    ids = lambda cond, v: F.when(cond, F.array(F.lit(v))).otherwise(none)
    text = lambda cond, v: F.when(cond, F.lit(v))
    policy = F.struct(
        F.lit(True).alias("approved"),
        F.lit(1).alias("current_stage"),
        F.lit(False).alias("synthetic_only"),
        F.array(*[F.lit(c) for c in ("C1", "C2", "C3", "C4")]).alias("enabled_items"),
        F.lit(True).alias("c3_account_mapping_approved"),
        F.array(F.lit("a1"), F.lit("a2")).alias("allowed_capex_account_ids"),
        F.lit(3).cast("decimal(10,0)").alias("c3_threshold"),
        F.array(F.lit("definition"), F.lit("calculation_basis")).alias("c4_required_explanations"),
    )
    c3 = F.struct(
        F.lit("KRW").alias("currency"),
        F.array(F.lit("a1")).alias("capex_account_ids"),
        text(z % 6 == 1, "c1").alias("commitment_source_id"),
        F.lit(None).cast("string").alias("funding_plan_source_id"),
        *[F.lit(d).cast("date").alias(n) for n, d in (("target_start", "2025-01-01"), ("target_end", "2030-12-31"), ("capex_start", "2024-01-01"), ("capex_end", "2024-12-31"))],
    )
    return read(spark, folder, "part").select(
        k.alias("claim_id"),
        item.alias("item"),
        F.lit(False).alias("synthetic"),
        F.when(k % 23 == 0, F.lit("unknown")).when(k % 29 == 0, F.lit("not_comparable")).otherwise(F.lit("comparable")).alias("comparability"),
        F.lit("goal").alias("claim_track"),
        ids(z % 6 != 0, "currency_amount").alias("trigger_elements"),
        side("s1").alias("s"),
        side("f1").alias("f"),
        F.when(z % 7 == 0, none).otherwise(names(z % 3)).alias("s_set"),
        names(z % 2).alias("f_set"),
        s_period.alias("s_period"),
        year.alias("f_period"),
        (z * 10000).cast("decimal(18,0)").alias("s_amount"),
        cents("p_retailprice").cast("decimal(18,0)").alias("f_amount"),
        year.alias("period"),
        year.alias("fin_period"),
        F.lit("consolidated").alias("consolidation"),
        text(k % 9 == 0, "e1").alias("explanation_source_id"),
        F.when(k % 5 == 0, F.lit("incomplete")).otherwise(F.lit("complete")).alias("search_state"),
        c3.alias("c3"),
        F.struct(ids(z % 2 == 0, "d1").alias("definition_source_ids"), ids(z % 3 == 0, "k1").alias("calculation_source_ids")).alias("c4"),
        policy.alias("policy"),
    )


@query(
    "reconcile_items",
    f"""WITH {_PACKETS} SELECT k AS claim_id, item, CASE WHEN status IS NULL THEN 'blocked' ELSE 'completed' END AS execution_state, status, reason AS reason_codes FROM o""",
)
def reconcile_items(spark, folder):
    """Items C1 to C4 for every part."""
    out = reconcile.reconcile(_packets(spark, folder))
    return out.select("claim_id", "item", "execution_state", "status", F.array_join("reason_codes", ",").alias("reason_codes"))


@query(
    "packet_violations",
    """SELECT p_partkey AS claim_id, concat_ws(',', CASE WHEN p_size % 5 = 0 THEN 'period_order' END, CASE WHEN p_size % 3 = 0 THEN 'explanation_source_unknown' END,
        CASE WHEN p_size % 4 = 0 THEN 'complete_search_has_failures' END, CASE WHEN p_partkey % 4 = 3 AND p_size % 2 = 0 THEN 'c4_context_required' END) AS violations FROM part""",
)
def packet_violations(spark, folder):
    """Contract rules each packet breaks."""
    z = F.col("claim_id")
    size = read(spark, folder, "part").select(F.col("p_partkey").alias("claim_id"), F.col("p_size").alias("z"))
    rows = _packets(spark, folder).join(size, "claim_id")
    z = F.col("z")
    none = F.array().cast("array<string>")
    bad_period = F.struct(F.lit("2024-12-31").cast("date").alias("start"), F.lit("2024-01-01").cast("date").alias("end"))
    search = F.struct(
        F.lit("complete").alias("state"),
        F.when(z % 4 == 0, F.array(F.lit("d9"))).otherwise(none).alias("failed_document_ids"),
        F.lit("p").alias("coverage_policy_id"),
        F.lit("r").alias("receipt_id"),
        F.array(F.lit("d1")).alias("required_document_ids"),
    )
    rows = rows.withColumns(
        {
            "claim_id": F.col("claim_id").cast("string"),
            "period": F.when(z % 5 == 0, bad_period).otherwise(F.col("period")),
            "known_source_ids": F.array(F.lit("s1"), F.lit("f1")),
            "explanation_source_id": F.when(z % 3 == 0, F.lit("zz")),
            "claim_source_id": F.lit("s1"),
            "search": search,
            "c4": F.when(~((F.col("item") == "C4") & (z % 2 == 0)), F.col("c4")),
        }
    )
    out = reconcile.packet_violations(rows)
    return out.select(F.col("claim_id").cast("bigint").alias("claim_id"), F.array_join("violations", ",").alias("violations"))


# ---------------------------------------------------------------- assurance

_ASSURANCE = """
s AS (SELECT n_regionkey, list_sort(list(DISTINCT n_name)) AS ents, CASE n_regionkey % 3 WHEN 0 THEN 'limited' WHEN 1 THEN 'none' ELSE 'reasonable' END AS level FROM nation GROUP BY 1),
c AS (SELECT c_custkey, n_name, c_custkey % 5 AS region, c_mktsegment AS metric, CASE WHEN c_custkey % 7 = 0 THEN '2023' WHEN c_custkey % 11 = 0 THEN 'FY24' ELSE '2024년' END AS period
      FROM customer JOIN nation ON n_nationkey = c_nationkey),
m AS (SELECT c.*, level, CASE WHEN metric IN ('BUILDING', 'MACHINERY', 'FURNITURE') THEN 'yes' ELSE 'no' END AS mm,
        CASE WHEN period = 'FY24' THEN 'unknown' WHEN period = '2023' THEN 'no' ELSE 'yes' END AS pm,
        CASE WHEN list_contains(ents, n_name) THEN 'yes' ELSE 'no' END AS bm, metric = 'FURNITURE' AS excluded
      FROM c JOIN s ON s.n_regionkey = region)
"""


@query(
    "assurance_match",
    f"""WITH {_ASSURANCE} SELECT c_custkey, mm AS metric_match, pm AS period_match, bm AS boundary_match,
        CASE WHEN excluded THEN 'explicit_exclusion' WHEN level = 'none' OR 'no' IN (mm, pm, bm) THEN 'scope_mismatch_or_no_assurance'
             WHEN mm = 'yes' AND pm = 'yes' AND bm = 'yes' THEN NULL ELSE 'insufficient_scope_information' END AS reason,
        CASE WHEN excluded OR level = 'none' OR 'no' IN (mm, pm, bm) THEN 'not_covered' WHEN mm = 'yes' AND pm = 'yes' AND bm = 'yes' THEN 'covered' ELSE 'undetermined' END AS status FROM m""",
)
def assurance_match(spark, folder):
    """Customers as claims against one opinion per region."""
    nation = read(spark, folder, "nation")
    level = F.element_at(F.array(F.lit("limited"), F.lit("none"), F.lit("reasonable")), (F.col("n_regionkey") % 3 + 1).cast("int"))
    # Bounded: the nations of a region are a fixed list of 25.
    statements_ = nation.groupBy("n_regionkey").agg(F.array_sort(F.collect_set("n_name")).alias("entities")).select(
        F.col("n_regionkey").alias("region"),
        F.col("n_regionkey").cast("string").alias("statement_id"),
        "entities",
        F.array(F.lit("site")).alias("facilities"),
        F.array(*[F.lit(m) for m in ("BUILDING", "MACHINERY", "FURNITURE")]).alias("covered_metrics"),
        F.array().cast("array<string>").alias("excluded_entities"),
        F.array().cast("array<string>").alias("excluded_facilities"),
        F.array(F.lit("FURNITURE")).alias("excluded_metrics"),
        F.array().cast("array<string>").alias("excluded_periods"),
        F.array().cast("array<string>").alias("explicit_exclusions"),
        F.array().cast("array<string>").alias("unresolved_fields"),
        F.lit("KPMG").alias("provider"),
        F.lit("ISAE 3000").alias("standard_raw"),
        level.alias("level"),
        F.lit("2024").alias("reporting_period"),
    )
    key = F.col("c_custkey")
    claims = read(spark, folder, "customer").join(nation, F.col("n_nationkey") == F.col("c_nationkey")).select(
        "c_custkey",
        (key % 5).cast("int").alias("region"),
        F.col("c_mktsegment").alias("metric"),
        F.when(key % 7 == 0, F.lit("2023")).when(key % 11 == 0, F.lit("FY24")).otherwise(F.lit("2024년")).alias("claim_period"),
        F.array("n_name").alias("claim_entities"),
        F.array(F.lit("site")).alias("claim_facilities"),
    )
    out = assurance.match_assurance(claims.join(statements_, "region"))
    return out.select("c_custkey", "metric_match", "period_match", "boundary_match", "reason", "status")


# ---------------------------------------------------------------- sources and sinks


@query(
    "payload_dedupe",
    """SELECT 'sha256:' || sha256(text) AS payload_ref, length(min(text)) AS n_chars, count(*) AS n_uses, false AS collision FROM documents GROUP BY text""",
)
def payload_dedupe(spark, folder):
    """Distinct document texts and how often each is used."""
    _, payloads = sinks.dedupe_payloads(read(spark, folder, "documents").select("doc_id", "text"), ["text"])
    return payloads.select("payload_ref", F.length("payload").cast("bigint").alias("n_chars"), "n_uses", "collision")


@query("payload_rehydrate", "SELECT doc_id, sha256(text) AS text_hash FROM documents")
def payload_rehydrate(spark, folder):
    """Round trip through compact references."""
    docs = read(spark, folder, "documents").select("doc_id", "text")
    compact, payloads = sinks.dedupe_payloads(docs, ["text"])
    return sinks.rehydrate(compact, payloads, ["text"]).select("doc_id", F.sha2("text", 256).alias("text_hash"))


@query(
    "formula_guard",
    """WITH t AS (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN '=' || c_name WHEN 1 THEN '-' || c_custkey WHEN 2 THEN ' @x' ELSE c_name END AS v FROM customer)
    SELECT c_custkey, CASE WHEN c_custkey % 4 < 3 THEN '''' || v ELSE v END AS v FROM t""",
)
def formula_guard(spark, folder):
    """CSV cells that could be read as formulas."""
    key = F.col("c_custkey")
    v = (
        F.when(key % 4 == 0, F.concat(F.lit("="), "c_name"))
        .when(key % 4 == 1, F.concat(F.lit("-"), key))
        .when(key % 4 == 2, F.lit(" @x"))
        .otherwise(F.col("c_name"))
    )
    return sinks.csv_ready(read(spark, folder, "customer").select("c_custkey", v.alias("v")))


@query(
    "statement_rows",
    """SELECT o_orderkey AS source_id, CAST(i AS BIGINT) AS position, 'acct' || i AS account_id, CAST(o_orderkey * i AS VARCHAR) AS thstrm_amount
    FROM orders, (VALUES (0), (1)) AS k(i) WHERE o_orderkey % 5 > 1""",
)
def statement_rows(spark, folder):
    """Statement JSON of every order: rejected unless status and filing identity hold."""
    payloads, manifest = _statements(spark, folder)
    rows, _ = statements.statements_from_json(payloads, manifest)
    return rows.select("source_id", F.col("position").cast("bigint").alias("position"), "account_id", "thstrm_amount")


@query(
    "statement_rejects",
    """SELECT o_orderkey AS source_id, CASE o_orderkey % 5 WHEN 0 THEN 'statements_status_invalid' ELSE 'statement_row_identity_mismatch' END AS reason
    FROM orders WHERE o_orderkey % 5 < 2""",
)
def statement_rejects(spark, folder):
    _, rejects = statements.statements_from_json(*_statements(spark, folder))
    return rejects


def _statements(spark, folder):
    key = F.col("o_orderkey")
    line = lambda i: F.struct(
        F.when((key % 5 == 1) & F.lit(i == 1), F.lit("other")).otherwise(F.lit("r1")).alias("rcept_no"),
        F.lit("2024").alias("bsns_year"),
        F.lit("00126380").alias("corp_code"),
        F.lit(f"acct{i}").alias("account_id"),
        (key * i).cast("string").alias("thstrm_amount"),
    )
    o = read(spark, folder, "orders")
    payload = F.to_json(
        F.struct(F.when(key % 5 == 0, F.lit("013")).otherwise(F.lit("000")).alias("status"), F.array(line(0), line(1)).alias("list"))
    )
    manifest = o.select(
        key.alias("source_id"), F.lit("00126380").alias("corp_code"), F.lit(2024).alias("fiscal_year"), F.lit("r1").alias("rcept_no")
    )
    return o.select(key.alias("source_id"), payload.alias("payload")), manifest


@query(
    "manifest_violations",
    """WITH a AS (SELECT s_suppkey AS k, s_suppkey // 2 AS pair FROM supplier)
    SELECT k, concat_ws(',', CASE WHEN k % 4 = 1 THEN 'retrieved_without_hash' END, CASE WHEN k % 4 = 2 THEN 'absent_with_locator' END,
           CASE WHEN k % 6 = 5 THEN 'fetched_after_manifest' END, CASE WHEN k % 10 < 2 THEN 'duplicate_source' END) AS violations FROM a""",
)
def manifest_violations(spark, folder):
    """Suppliers as manifest artifacts with planted faults."""
    k = F.col("s_suppkey")
    absent = k % 4 == 2
    artifacts = read(spark, folder, "supplier").select(
        k.alias("k"),
        F.when(k % 10 < 2, F.concat(F.lit("p"), F.floor(k / 10))).otherwise(F.concat(F.lit("s"), k)).alias("source_id"),
        F.lit("v1").alias("document_version_id"),
        F.lit("00126380").alias("corp_code"),
        F.lit(2024).alias("fy"),
        F.lit("consolidated").alias("consolidation"),
        F.lit("DART").alias("source_system"),
        F.when(absent, F.lit("failed")).otherwise(F.lit("retrieved")).alias("status"),
        F.when(~absent & (k % 4 != 1), F.sha2(k.cast("string"), 256)).alias("artifact_sha256"),
        F.lit("r1").alias("rcept_no"),
        F.lit("loc").alias("locator"),
        F.when(absent, F.lit("E1")).alias("error_code"),
        F.when(k % 6 == 5, F.lit("2026-02-01T00:00:00Z")).otherwise(F.lit("2026-01-01T00:00:00Z")).alias("fetched_at"),
    )
    out = inputs.validate_manifest(artifacts, "2026-01-15T00:00:00Z")
    return out.select("k", F.array_join("violations", ",").alias("violations"))


@query(
    "billing_rows",
    """SELECT count(*) AS n_rows, count(*) FILTER (CAST(o_orderdate AS DATE) NOT BETWEEN DATE '1996-01-01' AND DATE '2030-12-31') AS n_violated,
        CASE WHEN count(*) FILTER (CAST(o_orderdate AS DATE) NOT BETWEEN DATE '1996-01-01' AND DATE '2030-12-31') = 0 THEN round(sum(CAST(round(o_totalprice * 100) AS BIGINT)) / 100, 2) END AS total
    FROM orders""",
)
def billing_rows(spark, folder):
    """Billing export check over every order as a usage row."""
    o = read(spark, folder, "orders")
    price = F.concat(F.lit("$"), _money(cents("o_totalprice")))
    rows = o.select(
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"),
        F.lit("k").alias("api_key_id"),
        F.lit("n").alias("api_key_name"),
        F.lit("api").alias("usage_type"),
        F.lit("payg").alias("billing_source"),
        F.lit("p").alias("product"),
        F.lit("std").alias("pricing_options"),
        F.lit("1,000").alias("quantity"),
        price.alias("item_cost"),
        F.lit("0").alias("used_credit"),
        price.alias("subtotal"),
    )
    out = inputs.billing_total(inputs.check_billing(rows, "1996-01-01", "2030-12-31"))
    return out.select("n_rows", "n_violated", F.round(F.col("total").cast("double"), 2).alias("total"))


@query(
    "submission_violations",
    """SELECT 'claims' AS "table", CAST(doc_id AS VARCHAR) AS claim_id, 'page_invalid' AS reason FROM documents WHERE n_chars % 40 = 0
    UNION ALL SELECT 'elements', CAST(doc_id + 100000000 AS VARCHAR), 'claim_unknown' FROM labels WHERE quality = 0""",
)
def submission_violations(spark, folder):
    """Documents as submitted claims, labels as their element rows."""
    claims = read(spark, folder, "documents").select(
        F.col("doc_id").cast("string").alias("claim_id"),
        F.lit("d1").alias("document_id"),
        (F.col("n_chars") % 40).cast("string").alias("physical_page"),
        F.lit("q").alias("quote"),
    )
    labels = read(spark, folder, "labels")
    off = F.when(F.col("quality") == 0, F.lit(100000000)).otherwise(F.lit(0))
    elements = labels.select((F.col("doc_id") + off).cast("string").alias("claim_id"))
    rest = labels.select(F.col("doc_id").cast("string").alias("claim_id"))
    return inputs.validate_submission({"claims": claims, "elements": elements, "numeric": rest, "assurance": rest})


@query(
    "graph_identity",
    """SELECT CAST(source AS VARCHAR) AS document_version_id, 'identity_mismatch' AS reason FROM documents GROUP BY source HAVING count(DISTINCT lang = 'de') > 1
    UNION ALL SELECT source, 'text_hash_mismatch' FROM documents WHERE n_chars % 50 = 0 GROUP BY source""",
)
def graph_identity(spark, folder):
    """Documents of a source as one graph with planted identity faults."""
    docs = read(spark, folder, "documents")
    blocks = docs.select(
        F.lit("t").alias("tenant_id"),
        F.col("source").alias("document_version_id"),
        F.when(F.col("lang") == "de", F.lit("m2")).otherwise(F.lit("m1")).alias("parse_manifest_id"),
        F.lit("h").alias("source_sha256"),
        F.col("doc_id").alias("source_id"),
        F.col("text").alias("raw_text"),
        F.when(F.col("n_chars") % 50 == 0, F.lit("x")).otherwise(F.sha2("text", 256)).alias("raw_text_sha256"),
    )
    return graphs.identity_violations(blocks).drop("tenant_id")


@query("text_nodes")
def text_nodes(spark, folder):
    """Text nodes of every web page (parsed markup, so no SQL equivalent)."""
    return filings.filing_text_nodes(read(spark, folder, "pages"), ["page_id"])
