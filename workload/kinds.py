"""Verdicts of every numeric kind on neighbouring order lines."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from claimgrove.operators import numeric
from workload.common import cents, query

DOC = ["tenant_id", "document_version_id"]
LINES = 100_000  # in a task; a line becomes wide rows there


@query(
    "numeric_kinds",
    """WITH l AS (SELECT l_orderkey, l_linenumber, min(CAST(round(l_extendedprice * 100) AS BIGINT)) AS b FROM lineitem GROUP BY ALL),
    n AS (SELECT l_orderkey * 10 + l_linenumber AS claim_id, l_orderkey % 4 AS kind, b, l_linenumber % 2 AS bump,
          lead(b) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS c FROM l),
    m AS (SELECT *, CASE kind WHEN 0 THEN b WHEN 1 THEN b + c END AS s, claim_id % 7 = 0 AS open_issue, claim_id % 11 = 0 AS no_source,
          claim_id % 13 = 0 AS other_unit FROM n WHERE c IS NOT NULL),
    v AS (SELECT *, CASE WHEN kind < 2 THEN s // 100 + bump ELSE ((b - c) * 1000) // b + bump END AS t FROM m),
    w AS (SELECT *, CASE kind WHEN 0 THEN 1 ELSE 2 END AS wide, (t * 2 + 1)::HUGEINT AS hi, (t * 2 - 1)::HUGEINT AS lo, 2 * b - 1 AS b1, 2 * b + 1 AS b2, 2 * c - 1 AS c1, 2 * c + 1 AS c2 FROM v),
    x AS (SELECT *, CASE WHEN kind < 2 THEN 2 * s - wide <= hi * 100 AND lo * 100 <= 2 * s + wide
            ELSE (2000::HUGEINT * (b1 - c1) <= hi * b1 OR 2000::HUGEINT * (b2 - c1) <= hi * b2 OR 2000::HUGEINT * (b1 - c2) <= hi * b1 OR 2000::HUGEINT * (b2 - c2) <= hi * b2)
             AND (2000::HUGEINT * (b1 - c1) >= lo * b1 OR 2000::HUGEINT * (b2 - c1) >= lo * b2 OR 2000::HUGEINT * (b1 - c2) >= lo * b1 OR 2000::HUGEINT * (b2 - c2) >= lo * b2) END AS fits,
           CASE WHEN no_source THEN 'claim_source_unresolved' WHEN open_issue THEN 'source_issue_unresolved' WHEN other_unit THEN 'dimension_mismatch' END AS gate,
           (b - c) * 100 // gcd(abs((b - c) * 100), b) AS num, b // gcd(abs((b - c) * 100), b) AS den FROM w),
    y AS (SELECT *, gate IS NULL AND kind >= 2 AND 100000000000000000000000::HUGEINT % den <> 0 AS recurring FROM x)
    SELECT claim_id, CASE kind WHEN 0 THEN 'comparison' WHEN 1 THEN 'sum' WHEN 2 THEN 'reduction' ELSE 'product_reduction' END AS kind,
           CASE WHEN gate = 'dimension_mismatch' THEN 'not_comparable' WHEN gate IS NOT NULL THEN 'not_computable' WHEN fits THEN 'consistent' ELSE 'inconsistent' END AS status,
           CASE WHEN gate IS NULL AND kind < 2 THEN rtrim(rtrim(printf('%d.%02d', s // 100, s % 100), '0'), '.') END AS computed,
           CASE WHEN recurring THEN CAST(num AS VARCHAR) END AS numerator, CASE WHEN recurring THEN CAST(den AS VARCHAR) END AS denominator_exact,
           coalesce(gate, CASE WHEN recurring THEN 'non_terminating_decimal' END) AS reason FROM y""",
)
def numeric_kinds(spark, folder):
    """Comparisons, sums, reductions and product reductions claimed of every line and the next of its order."""
    lines = spark.read.parquet(f"{folder}/lineitem.parquet").select("l_orderkey", "l_linenumber", cents("l_extendedprice").alias("b"))
    # An order is a document: dealt out by it once, lines, claims and observations meet without another exchange.
    tasks = max(spark.sparkContext.defaultParallelism, -(-lines.count() // LINES))
    lines = lines.repartition(tasks, "l_orderkey").groupBy("l_orderkey", "l_linenumber").agg(F.min("b").alias("b"))
    after = Window.partitionBy("l_orderkey").orderBy("l_linenumber")  # an order has few lines
    pairs = lines.withColumn("c", F.lead("b").over(after)).where("c IS NOT NULL")
    kind = F.get(
        F.array(*(F.lit(x) for x in ("comparison", "sum", "reduction", "product_reduction"))), (F.col("l_orderkey") % 4).cast("int")
    )
    bump = F.col("l_linenumber") % 2
    pairs = pairs.select(
        F.lit("t").alias("tenant_id"),
        F.col("l_orderkey").alias("document_version_id"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("claim_id"),
        kind.alias("kind"),
        "b",
        "c",
        bump.alias("bump"),
    )
    claim, b, c, kind = (F.col(x) for x in ("claim_id", "b", "c", "kind"))
    money = lambda v: F.concat(F.floor(v / 100), F.lit("."), F.lpad((v % 100).cast("string"), 2, "0"))
    name = lambda k: F.concat(claim, F.lit(f"-{k}"))
    null = F.lit(None).cast("string")
    side = lambda k, value: F.struct(F.lit(k).alias("k"), name(k).alias("observation_id"), money(value).alias("value_raw"))
    sides = pairs.select("*", F.inline(F.array(side(0, b), side(1, c))))
    first = F.col("k") == 0
    observations = sides.select(
        *DOC,
        "observation_id",
        F.lit("price").alias("metric_raw"),
        null.alias("scope"),
        F.when(first & (kind == "product_reduction"), "old").otherwise("new").alias("subject"),
        null.alias("scope2_basis"),
        null.alias("organizational_boundary"),
        F.when(claim % 13 == 0, "EUR").otherwise("USD").alias("unit_canonical"),
        null.alias("denominator"),
        F.when(first & (kind == "reduction"), "2020").otherwise("2021").alias("reporting_period"),
        "value_raw",
        F.lit("value").alias("value_state"),
        F.col("observation_id").alias("value_source_id"),
        (claim % 7 == 0).alias("issue_open"),
        F.lit(False).alias("notes_open"),
    )
    whole = F.when(kind == "comparison", b).otherwise(b + c)
    tenths = F.expr("((b - c) * 1000) div b") + F.col("bump")
    sign = F.when(tenths < 0, F.lit("-")).otherwise(F.lit(""))
    shown = F.concat(sign, F.floor(F.abs(tenths) / 10), F.lit("."), F.abs(tenths) % 10)
    direct = kind.isin("comparison", "sum")
    bindings = pairs.select(
        *DOC,
        "claim_id",
        "kind",
        F.when(kind == "comparison", F.array(name(0))).otherwise(F.array(name(0), name(1))).alias("observation_ids"),
        F.when(direct, (F.floor(whole / 100) + F.col("bump")).cast("string")).otherwise(shown).alias("reported_value"),
        F.lit("price").alias("metric_raw"),
        null.alias("scope"),
        F.lit("new").alias("subject"),
        null.alias("scope2_basis"),
        null.alias("organizational_boundary"),
        null.alias("denominator"),
        F.lit("USD").alias("unit"),
        F.lit("2021").alias("reporting_period"),
        F.when(kind == "reduction", "2020").otherwise("2021").alias("baseline_period"),
        F.lit("absolute").alias("quantity_kind"),
        (claim % 11 != 0).alias("claim_verified"),
        F.lit(True).alias("product_accepted"),
        F.lit(True).alias("aggregation_accepted"),
        F.when(kind == "product_reduction", "old").alias("baseline_subject"),
    )
    out = numeric.check_numeric(bindings, observations, small_docs=True)
    return out.select(
        "claim_id",
        "kind",
        "status",
        F.when(F.col("kind").isin("comparison", "sum"), F.col("computed")).alias("computed"),
        "numerator",
        "denominator_exact",
        "reason",
    )
