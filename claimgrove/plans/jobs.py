"""Composite jobs over whole corpora; every intermediate frame stays lazy unless noted."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimgrove.operators import (
    grading,
    lineage,
    metrics,
    numeric,
    reconcile,
    search,
    tables,
    votes,
)
from claimgrove.operators.claims import DOC
from claimgrove.operators.ordered import numbered
from claimgrove.operators.rulebook import ELEMENTS, GRADES
from claimgrove.session import cut_lineage

ROUTES = ("index", "lineage", "lexical", "vector")


def retrieve(
    claims: DataFrame,
    blocks: DataFrame,
    edges: DataFrame,
    issues: DataFrame,
    index_pages: DataFrame | None = None,
    vectors: tuple[DataFrame, DataFrame] | None = None,
    doc: Sequence[str] = DOC,
) -> tuple[DataFrame, DataFrame]:
    """(packets, candidates): hybrid evidence packets of all claims.

    `claims`: doc, claim_id, source_id, page_num, quote, verified. Routes are
    index pages, table lineage, BM25 and optionally vectors; they are fused by
    rank, the claim's own source comes first, blocks with open issues or unowned
    notes are set aside, and what fits the budget is picked greedily. A local or
    same-table block that is set aside or omitted blocks the packet.
    """
    doc = list(doc)
    key = [*doc, "claim_id"]
    closure = lineage.ancestors(edges, doc=doc)
    roots = lineage.table_roots(closure, blocks, doc)
    own_roots = claims.select(*key, "source_id").join(roots, [*doc, "source_id"]).select(
        *key, "table_id"
    )
    same_table = (
        own_roots.join(roots, [*doc, "table_id"])
        .select(*key, "source_id")
        .distinct()
        .withColumn("same_table", F.lit(True))
    )
    queries = claims.select(*doc, F.col("claim_id").alias("query_id"), F.col("quote").alias("text"))
    corpus = blocks.select(*doc, "source_id", F.col("normalized_text").alias("text"))
    lexical = search.bm25(queries, corpus, scope=doc).select(
        *doc, F.col("query_id").alias("claim_id"), F.lit("lexical").alias("route"), "source_id",
        F.col("rank").cast("bigint").alias("position"),
    )
    related = numbered(same_table, key, ["source_id"], "position").select(
        *key, F.lit("lineage").alias("route"), "source_id", F.col("position").cast("bigint").alias("position")
    )
    routes = [lexical, related]
    if index_pages is not None:
        on_page = (
            claims.select(*key)
            .join(index_pages.select(*key, "page_num").distinct(), key)
            .join(blocks.select(*doc, "page_num", "source_id"), [*doc, "page_num"])
        )
        routes.append(
            numbered(on_page, key, ["page_num", "source_id"], "position").select(
                *key, F.lit("index").alias("route"), "source_id", F.col("position").cast("bigint").alias("position")
            )
        )
    if vectors is not None:
        asked, stored = vectors
        routes.append(
            search.vector_search(asked, stored, doc).select(
                *doc, F.col("query_id").alias("claim_id"), F.lit("vector").alias("route"), "source_id",
                F.col("rank").cast("bigint").alias("position"),
            )
        )
    fused = search.rrf(search.union_routes(*routes), ROUTES, key=key)
    own = claims.select(*key, "source_id", F.lit(True).alias("own"))
    ranked = fused.join(own, [*key, "source_id"], "full").join(
        same_table, [*key, "source_id"], "left"
    )
    side = blocks.select(
        *doc, "source_id", "quality", "winner", F.length("raw_text").alias("size")
    )
    wanted = blocks.select(*doc, "source_id")
    bad = (
        lineage.open_issues(closure, issues, wanted, doc)
        .select(*doc, "source_id")
        .unionByName(lineage.note_holds(blocks, edges, closure, doc).select(*doc, "source_id"))
        .distinct()
        .withColumn("held", F.lit(True))
    )
    no = F.lit(False)
    candidates = (
        ranked.join(side, [*doc, "source_id"])
        .join(bad, [*doc, "source_id"], "left")
        .select(
            *key,
            "source_id",
            F.coalesce("own", no).alias("own"),
            F.coalesce("rrf", F.lit(0.0)).alias("rrf"),
            F.when(F.coalesce("own", no), F.lit("local_claim"))
            .when(F.coalesce("same_table", no), F.lit("same_table"))
            .otherwise(F.lit("global_bound"))
            .alias("source_scope"),
            "size",
            (
                F.coalesce("held", no)
                | F.col("winner").isNull()
                | (F.col("quality") != "verified")
            ).alias("set_aside"),
        )
    )
    candidates = candidates.withColumn("first", F.when(F.col("own"), 0).otherwise(1)).withColumn(
        "neg_rrf", -F.col("rrf")
    )
    picked = search.budgeted_pick(
        candidates.filter(~F.col("set_aside")), key, ["first", "neg_rrf", "source_id"], "source_id", "size"
    )
    chosen = picked.select(*key, F.explode("picked").alias("source_id")).withColumn(
        "picked", F.lit(True)
    )
    judged = candidates.join(chosen, [*key, "source_id"], "left").withColumn(
        "picked", F.coalesce("picked", no)
    )
    near = F.col("source_scope").isin("local_claim", "same_table")
    blocked = judged.groupBy(*key).agg(
        F.bool_or(near & ~F.col("picked")).alias("near_missing"),
        F.count_if("set_aside").alias("n_set_aside"),
    )
    packets = (
        claims.select(*key, "verified")
        .join(picked, key, "left")
        .join(blocked, key, "left")
        .select(
            *key,
            "picked",
            "used",
            "n_omitted",
            "n_set_aside",
            F.when(
                ~F.coalesce("verified", no) | F.coalesce("near_missing", F.lit(True)),
                F.lit("blocked_evidence"),
            )
            .otherwise(F.lit("ready"))
            .alias("status"),
        )
    )
    return packets, judged.drop("first", "neg_rrf")


def extract_observations(
    cells: DataFrame, notes: DataFrame | None = None, table: Sequence[str] = tables.TABLE
) -> tuple[DataFrame, DataFrame]:
    """(observations, issues) of all tables: expand, find headers, wide to long."""
    grid, size_issues = tables.expand_grid(cells, table)
    grid = cut_lineage(grid)
    columns, shape, header_issues = tables.detect_headers(grid, table)
    observed = tables.unpivot_table(grid, columns, shape, notes, table)
    return observed, size_issues.unionByName(header_issues)


def check_numbers(
    claims: DataFrame, observations: DataFrame, accepted: DataFrame, doc: Sequence[str] = DOC
) -> tuple[DataFrame, DataFrame]:
    """(proposals, results): literal proposals for review, verdicts of accepted bindings."""
    return (
        numeric.propose_bindings(claims, observations, doc),
        numeric.check_numeric(accepted, observations, doc),
    )


def grade_claims(
    ballots: DataFrame, claims: DataFrame, key: Sequence[str] = ("claim_id",)
) -> DataFrame:
    """Strict replica profile, element facts, exceptions and ladder for all claims.

    `ballots`: key, element_id, state, normalized_value, binding_hash,
    source_scope. `claims`: key, track, superlative_quote, superlative_cited,
    safe_harbor_category, product_variant.
    """
    key = list(key)
    agreed = votes.partial_facts(ballots, [*key, "element_id"])
    names = [(e, n) for elements in ELEMENTS.values() for e, ns in elements.items() for n in ns]
    spark = ballots.sparkSession
    mapping = spark.createDataFrame(names, "element_id string, name string")
    facts = agreed.join(F.broadcast(mapping), "element_id").select(*key, "name", "state")
    folded = grading.fact_map(facts, key)
    empty = F.create_map().cast("map<string,string>")
    rows = claims.join(folded, key, "left").withColumn("facts", F.coalesce("facts", empty))
    return grading.grade(grading.exceptions(rows))


def reconcile_disclosures(
    packets: DataFrame, sources: DataFrame, registry: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """(outcomes, rejected): packets whose sources all pass the registry are decided.

    `sources` carry packet_id next to what `check_documents` reads. A packet with
    a failing source is rejected with the first reason and decides nothing.
    """
    checked = reconcile.check_documents(sources, registry)
    failing = (
        checked.filter(F.col("reason").isNotNull())
        .groupBy("packet_id")
        .agg(F.min_by("reason", "source_id").alias("reason"))
    )
    sound = packets.join(failing, "packet_id", "left_anti")
    return reconcile.reconcile(sound), failing


def evaluate_model(
    pred_facts: DataFrame,
    gold_facts: DataFrame,
    pred_grades: DataFrame,
    gold_grades: DataFrame,
    items: DataFrame,
) -> dict[str, DataFrame]:
    """All evaluation tables of one dataset; `leakage` must be empty to trust the rest."""
    return {
        "leakage": metrics.verify_split(items),
        "elements": metrics.element_metrics(pred_facts, gold_facts),
        "grades": metrics.classification_metrics(pred_grades, gold_grades, GRADES),
        "confusion": metrics.confusion(pred_grades, gold_grades, GRADES),
        "baseline": metrics.baseline(pred_grades, gold_grades),
    }
