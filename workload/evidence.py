"""Context budgets, index pages, packet assembly, attribution and page lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimgrove.operators import attribution, claims, layout, lineage, reconcile
from workload.common import query, read


@query(
    "bounded_context",
    """WITH RECURSIVE o AS (SELECT o_custkey, o_orderkey, length(o_orderpriority) AS size, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn,
             count(*) OVER (PARTITION BY o_custkey) AS total FROM orders),
    f AS (SELECT o_custkey, CAST(0 AS BIGINT) AS rn, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS used, '' AS chosen, '' AS omitted FROM (SELECT DISTINCT o_custkey FROM orders)
      UNION ALL SELECT f.o_custkey, o.rn,
        f.n + CASE WHEN used + size + CASE WHEN n > 0 THEN 1 ELSE 0 END <= 30 THEN 1 ELSE 0 END,
        f.used + CASE WHEN used + size + CASE WHEN n > 0 THEN 1 ELSE 0 END <= 30 THEN size + CASE WHEN n > 0 THEN 1 ELSE 0 END ELSE 0 END,
        chosen || CASE WHEN used + size + CASE WHEN n > 0 THEN 1 ELSE 0 END <= 30 THEN ',' || o_orderkey ELSE '' END,
        omitted || CASE WHEN used + size + CASE WHEN n > 0 THEN 1 ELSE 0 END <= 30 THEN '' ELSE ',' || o_orderkey END
      FROM f JOIN o ON o.o_custkey = f.o_custkey AND o.rn = f.rn + 1 WHERE o.rn <= 6)
    SELECT o_custkey, substr(arg_max(chosen, rn), 2) AS chosen, substr(arg_max(omitted, rn), 2) AS omitted, arg_max(used, rn) AS used,
           greatest(0, (SELECT count(*) FROM orders x WHERE x.o_custkey = f.o_custkey) - 6) AS n_beyond FROM f GROUP BY o_custkey""",
)
def bounded_context(spark, folder):
    """Whole blocks of each customer's first six that fit thirty characters."""
    o = read(spark, folder, "orders").select("o_custkey", "o_orderkey", "o_orderpriority")
    out = layout.bounded_context(o, ["o_custkey"], ["o_orderkey"], "o_orderkey", "o_orderpriority", 6, 30)
    return out.select(
        "o_custkey",
        F.array_join("chosen", ",").alias("chosen"),
        F.array_join("omitted", ",").alias("omitted"),
        F.col("used").cast("bigint").alias("used"),
        F.col("n_beyond").cast("bigint").alias("n_beyond"),
    )


@query(
    "index_pages",
    """WITH r AS (SELECT s_suppkey AS k, s_suppkey % 30 AS a, s_suppkey % 7 AS b FROM supplier),
    p AS (SELECT k, a, b, list_sort(list_distinct(list_concat(CASE WHEN a < 25 THEN [a * 2, a * 2 + 1] ELSE [] END, [b * 2, b * 2 + 1]))) AS pages FROM r)
    SELECT k AS source_id, array_to_string(pages, ',') AS pages, CASE WHEN a < 25 THEN 'resolved' ELSE 'unresolved' END AS resolution_state FROM p""",
)
def index_pages(spark, folder):
    """Printed page labels of index rows mapped to physical pages."""
    k = F.col("s_suppkey")
    rows = read(spark, folder, "supplier").select(
        F.lit("d").alias("doc"),
        k.alias("source_id"),
        F.lit("302-1").alias("indicator_code"),
        F.array((k % 30).cast("string"), (k % 7).cast("string")).alias("printed_page_refs"),
    )
    n = F.col("n_nationkey")
    pages = read(spark, folder, "nation").select(
        F.lit("d").alias("doc"), n.cast("string").alias("label"), F.explode(F.array(n * 2, n * 2 + 1)).alias("page_num")
    )
    out = lineage.resolve_pages(rows, pages, ["doc"])
    return out.select("source_id", F.array_join("resolved_physical_pages", ",").alias("pages"), "resolution_state")


@query(
    "packet_assembly",
    """WITH f AS (SELECT l_orderkey, CASE l_returnflag WHEN 'A' THEN 's' WHEN 'N' THEN 'f' END AS side, l_linenumber, l_linestatus, l_tax < 0.07 AS ok FROM lineitem WHERE l_returnflag <> 'R'),
    g AS (SELECT l_orderkey, side, bool_and(ok) AS ok, count(DISTINCT l_linestatus) AS n, min(l_linenumber) AS src FROM f GROUP BY ALL),
    j AS (SELECT o_orderkey, o_orderkey % 4 AS ctx, o_orderstatus, s.ok AS sok, s.n AS sn, s.src AS ssrc, f.ok AS fok, f.n AS fn FROM orders
          LEFT JOIN g s ON s.l_orderkey = o_orderkey AND s.side = 's' LEFT JOIN g f ON f.l_orderkey = o_orderkey AND f.side = 'f')
    SELECT o_orderkey AS claim_id, CASE WHEN o_orderstatus = 'P' THEN 'trigger_absent' WHEN ctx = 0 THEN 'financial_context_absent' WHEN ctx = 3 THEN 'financial_context_ambiguous'
        WHEN ctx = 2 THEN 'financial_context_unapproved' WHEN sok IS NULL THEN 'sustainability_fact_absent' WHEN fok IS NULL THEN 'financial_fact_absent'
        WHEN sn > 1 OR fn > 1 THEN 'fact_conflict' WHEN NOT sok OR NOT fok THEN 'fact_unverified' END AS blocked_reason FROM j""",
)
def packet_assembly(spark, folder):
    """Orders as claims, their lines as facts of the two sides."""
    o = read(spark, folder, "orders")
    key = F.col("o_orderkey")
    claims_ = o.select(
        key.alias("k"), key.alias("claim_id"), F.when(F.col("o_orderstatus") != "P", F.lit("C1")).alias("trigger_item")
    )
    side = F.when(F.col("l_returnflag") == "A", F.lit("sustainability")).otherwise(F.lit("financial"))
    facts = read(spark, folder, "lineitem").filter("l_returnflag <> 'R'").select(
        F.col("l_orderkey").alias("k"),
        F.col("l_orderkey").alias("claim_id"),
        F.lit("C1").alias("item"),
        side.alias("side"),
        F.col("l_linenumber").cast("string").alias("source_id"),
        F.col("l_linestatus").alias("quote"),
        F.lit("x").alias("locator"),
        (F.col("l_tax") < 0.07).alias("verified"),
    )
    ctx = key % 4
    contexts = o.filter(ctx > 0).select(
        key.alias("k"),
        F.explode(F.when(ctx == 3, F.array(F.lit("p1"), F.lit("p2"))).otherwise(F.array(F.lit("p1")))).alias("package_id"),
        (ctx != 2).alias("approved"),
        F.lit("2024").alias("financial_period"),
    )
    return reconcile.build_packets(claims_, facts, contexts, ["k"]).select("claim_id", "blocked_reason")


@query(
    "selection_binding",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN 'candidate_unknown' WHEN o_orderkey % 5 = 0 THEN 'role_mismatch'
         WHEN position(o_orderstatus IN o_orderpriority) = 0 AND o_orderstatus <> 'O' THEN 'raw_value_not_literal' END AS reason FROM orders""",
)
def selection_binding(spark, folder):
    """Chosen values checked to be literal in their candidate."""
    o = read(spark, folder, "orders")
    key = F.col("o_orderkey")
    selections = o.select(
        "o_orderkey",
        F.when(key % 5 == 0, F.lit("financial")).otherwise(F.lit("sustainability")).alias("document_role"),
        F.lit("cell").alias("candidate_type"),
        F.col("o_orderstatus").alias("raw_value"),
    )
    candidates = o.filter(key % 11 != 0).select(
        "o_orderkey",
        F.col("o_orderpriority").alias("quote"),
        F.array(F.lit("O")).alias("raw_values"),
        F.lit("sustainability").alias("document_role"),
        F.lit("cell").alias("candidate_type"),
    )
    return claims.bind_selections(selections, candidates, ["o_orderkey"]).select("o_orderkey", "reason")


@query(
    "page_lines",
    """WITH RECURSIVE w AS (SELECT p_partkey, p_partkey // 50 AS page, CAST((p_partkey * 29) % 97 AS DOUBLE) AS y0, CAST(p_size AS DOUBLE) AS x0 FROM part),
    o AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY y0, x0, p_partkey) AS rn FROM w),
    f AS (SELECT page, rn, p_partkey, y0 AS top, CAST(1 AS BIGINT) AS line_no FROM o WHERE rn = 1
      UNION ALL SELECT o.page, o.rn, o.p_partkey, CASE WHEN abs(o.y0 - f.top) > 2.5 THEN o.y0 ELSE f.top END,
             f.line_no + CASE WHEN abs(o.y0 - f.top) > 2.5 THEN 1 ELSE 0 END FROM f JOIN o ON o.page = f.page AND o.rn = f.rn + 1)
    SELECT p_partkey, page, line_no FROM f""",
)
def page_lines(spark, folder):
    """Words joined to lines by the first word of the line."""
    key = F.col("p_partkey")
    words = read(spark, folder, "part").select(
        "p_partkey",
        F.floor(key / 50).alias("page"),
        key.alias("word_id"),
        ((key * 29) % 97).cast("double").alias("y0"),
        F.col("p_size").cast("double").alias("x0"),
    )
    out = layout.group_lines(words, ["page"])
    return out.select("p_partkey", "page", F.col("line_no").cast("bigint").alias("line_no"))


@query(
    "binding_acceptance",
    """WITH b AS (SELECT o_orderkey AS k, o_orderkey % 2 = 0 AS direct, o_orderkey % 13 AS src, o_orderkey % 7 AS d FROM orders)
    SELECT k AS binding_id, CASE WHEN src = 0 THEN 'rejected' WHEN src = 1 THEN 'undetermined' WHEN d = 1 THEN 'rejected' WHEN d = 2 THEN 'undetermined'
        WHEN d = 3 AND NOT direct THEN 'undetermined' WHEN direct THEN 'accepted' WHEN k % 3 = 0 THEN 'accepted' WHEN k % 3 = 1 THEN 'rejected' ELSE 'accepted' END AS state FROM b""",
)
def binding_acceptance(spark, folder):
    """Attribution state of a binding per order over its three required roles."""
    k = F.col("o_orderkey")
    o = read(spark, folder, "orders")
    source = F.when(k % 13 == 0, F.lit("rejected")).when(k % 13 == 1, F.lit("undetermined")).otherwise(F.lit("accepted"))
    bindings = o.select(
        k.alias("binding_id"),
        source.alias("source_state"),
        F.lit(True).alias("has_roles"),
        (k % 2 == 0).alias("direct"),
        F.lit(False).alias("cues_open"),
        F.when(k % 3 == 2, F.array(F.lit("global_bound"))).otherwise(F.array(F.lit("same_table"))).alias("source_scopes"),
        (k % 3 != 2).alias("same_table"),
        (k % 3 == 0).alias("same_column"),
        F.lit(True).alias("coordinates_known"),
        F.lit("G2").alias("element_id"),
    )
    d = k % 7
    names = F.array(F.lit("entity"), F.lit("metric"), F.lit("reporting_period"))
    rows = o.select(k.alias("binding_id"), d.alias("d"), F.explode(names).alias("name"))
    period = F.col("name") == "reporting_period"
    entity = F.col("name") == "entity"
    d = F.col("d")
    value = F.when(period, F.when(d == 2, F.lit("some day")).otherwise(F.lit("2024"))).otherwise(F.lit("v"))
    dims = rows.select(
        "binding_id",
        "name",
        value.alias("expected"),
        F.when(entity & (d == 1), F.lit("other")).when(entity & (d == 3), F.lit(None)).otherwise(value).alias("actual"),
        F.lit(True).alias("expected_given"),
        F.lit(True).alias("actual_given"),
        *[F.lit("accepted").alias(n) for n in ("expected_citation", "actual_citation", "expected_attribution", "actual_attribution")],
    )
    return attribution.accept_bindings(bindings, dims)
