"""Lineage over block edges: ancestors, cycles, footnote ownership, open issues."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimgrove.operators.claims import DOC
from claimgrove.session import cut_lineage

TABLE_KINDS = ("table", "table_row", "table_cell")


def ancestors(
    edges: DataFrame,
    relation: str = "table_parent",
    doc: Sequence[str] = DOC,
) -> DataFrame:
    """Transitive closure (doc, source_id, ancestor_id), `is_cycle` on self pairs.

    Doubles the covered path length per round (depth 4 needs two rounds) and
    checkpoints between rounds in the cluster's shared folder. Stops when a
    round adds nothing, so the depth is not capped.
    """
    doc = list(doc)
    step = (
        edges.filter(F.col("relation") == relation)
        .select(*doc, "source_id", F.col("target_id").alias("ancestor_id"))
        .distinct()
    )
    closure = cut_lineage(step)
    known = closure.count()
    while True:
        upper = closure.select(
            *[F.col(c).alias(f"__{c}") for c in doc],
            F.col("source_id").alias("__via"),
            F.col("ancestor_id").alias("__top"),
        )
        condition = F.col("ancestor_id") == F.col("__via")
        for c in doc:
            condition = condition & (F.col(c) == F.col(f"__{c}"))
        longer = closure.join(upper, condition).select(
            *doc, "source_id", F.col("__top").alias("ancestor_id")
        )
        closure = cut_lineage(closure.unionByName(longer).distinct())
        size = closure.count()
        if size == known:
            break
        known = size
    return closure.withColumn("is_cycle", F.col("source_id") == F.col("ancestor_id"))


def ancestors_within(
    edges: DataFrame,
    depth: int = 4,
    relation: str = "table_parent",
    doc: Sequence[str] = DOC,
) -> DataFrame:
    """Ancestors up to a fixed depth as a lazy plan of `depth - 1` joins.

    For graphs whose depth is bounded by construction (cell, row, table, page).
    """
    doc = list(doc)
    step = (
        edges.filter(F.col("relation") == relation)
        .select(*doc, "source_id", F.col("target_id").alias("ancestor_id"))
        .distinct()
    )
    level, out = step, step
    for _ in range(depth - 1):
        upper = step.select(
            *doc,
            F.col("source_id").alias("ancestor_id"),
            F.col("ancestor_id").alias("__top"),
        )
        level = (
            level.join(upper, [*doc, "ancestor_id"])
            .select(*doc, "source_id", F.col("__top").alias("ancestor_id"))
            .distinct()
        )
        out = out.unionByName(level)
    return out.distinct().withColumn("is_cycle", F.col("source_id") == F.col("ancestor_id"))


def table_roots(closure: DataFrame, blocks: DataFrame, doc: Sequence[str] = DOC) -> DataFrame:
    """(doc, source_id, table_id): ancestors that are tables."""
    tables = blocks.filter(F.col("kind") == "table").select(
        *doc, F.col("source_id").alias("ancestor_id")
    )
    return closure.join(tables, [*doc, "ancestor_id"], "left_semi").select(
        *doc, "source_id", F.col("ancestor_id").alias("table_id")
    )


def open_issues(
    closure: DataFrame, issues: DataFrame, sources: DataFrame, doc: Sequence[str] = DOC
) -> DataFrame:
    """(doc, source_id, issue_id): open issues on a source or any of its ancestors."""
    doc = list(doc)
    live = issues.filter(F.col("state").isin("open", "unreadable")).select(
        *doc, "issue_id", F.explode("source_ids").alias("related_id")
    )
    related = (
        sources.select(*doc, "source_id", F.col("source_id").alias("related_id"))
        .unionByName(closure.select(*doc, "source_id", F.col("ancestor_id").alias("related_id")))
        .join(sources.select(*doc, "source_id"), [*doc, "source_id"], "left_semi")
    )
    return related.join(live, [*doc, "related_id"]).select(*doc, "source_id", "issue_id").distinct()


def note_holds(
    blocks: DataFrame, edges: DataFrame, closure: DataFrame, doc: Sequence[str] = DOC
) -> DataFrame:
    """(doc, source_id, note_id): unowned footnotes that hold a block.

    A note is owned when it is attached to a table or to a row/cell of one. An
    unowned note holds itself and every table node with a related node on its
    page; it is uncertainty about ownership, never absence.
    """
    doc = list(doc)
    tables = blocks.filter(F.col("kind") == "table").select(*doc, "source_id")
    known = blocks.filter(F.col("kind").isin("table_cell", "table_row")).select(*doc, "source_id")
    roots = table_roots(closure, blocks, doc)
    inside = known.join(roots, [*doc, "source_id"], "left_semi")
    owned = tables.unionByName(inside).distinct()
    notes = blocks.filter(F.col("kind") == "footnote").select(*doc, "source_id", "page_num")
    attached = (
        edges.filter(F.col("relation") == "footnote_of")
        .join(
            owned.select(*doc, F.col("source_id").alias("target_id")),
            [*doc, "target_id"],
            "left_semi",
        )
        .select(*doc, "source_id")
    )
    loose = notes.join(attached, [*doc, "source_id"], "left_anti")
    self_holds = loose.select(*doc, "source_id", F.col("source_id").alias("note_id"))
    nodes = blocks.filter(F.col("kind").isin(*TABLE_KINDS)).select(*doc, "source_id")
    related = nodes.select(*doc, "source_id", F.col("source_id").alias("related_id")).unionByName(
        closure.join(nodes, [*doc, "source_id"], "left_semi")
        .select(*doc, "source_id", F.col("ancestor_id").alias("related_id"))
        .join(
            owned.select(*doc, F.col("source_id").alias("related_id")),
            [*doc, "related_id"],
            "left_semi",
        )
    )
    pages = related.join(
        blocks.select(*doc, F.col("source_id").alias("related_id"), "page_num"),
        [*doc, "related_id"],
    ).select(*doc, "source_id", "page_num")
    # Only pages that hold an unowned note take part in the join.
    held = pages.distinct().join(
        loose.select(*doc, "page_num", F.col("source_id").alias("note_id")), [*doc, "page_num"]
    )
    return self_holds.unionByName(held.select(*doc, "source_id", "note_id")).distinct()


def column_note_targets(
    cells: DataFrame, targets: DataFrame, table: Sequence[str] = (*DOC, "table_native_id")
) -> DataFrame:
    """First-row cells above the columns of the target cells: (table, target_id, source_id)."""
    table = list(table)
    first = cells.groupBy(*table).agg(F.min("row_number").alias("__first"))
    head = (
        cells.join(first, table)
        .filter(F.col("row_number") == F.col("__first"))
        .withColumn(
            "__col",
            F.explode(F.sequence("column_number", F.col("column_number") + F.col("column_span") - 1)),
        )
        .select(*table, "source_id", "__col")
    )
    wanted = (
        cells.join(targets.select(*table, "source_id"), [*table, "source_id"], "left_semi")
        .withColumn(
            "__col",
            F.explode(F.sequence("column_number", F.col("column_number") + F.col("column_span") - 1)),
        )
        .select(*table, F.col("source_id").alias("target_id"), "__col")
    )
    return wanted.join(head, [*table, "__col"]).select(*table, "target_id", "source_id").distinct()


def resolve_pages(
    rows: DataFrame, page_map: DataFrame, doc: Sequence[str] = DOC
) -> DataFrame:
    """Index rows with physical pages; resolved only if every printed label maps.

    `rows` are (doc, source_id, indicator_code, printed_page_refs ARRAY), the map
    is (doc, label, page_num), one label to many pages.
    """
    doc = list(doc)
    labels = page_map.select(*doc, F.trim("label").alias("label"), "page_num").distinct()
    exploded = rows.select(*doc, "source_id", "indicator_code", F.explode("printed_page_refs").alias("label"))
    per_label = exploded.join(labels, [*doc, "label"], "left")
    found = per_label.groupBy(*doc, "source_id", "indicator_code").agg(
        F.bool_and(F.col("page_num").isNotNull()).alias("__all"),
        # Bounded: one index row names at most a few hundred pages.
        F.array_sort(F.collect_set("page_num")).alias("resolved_physical_pages"),
    )
    return rows.join(found, [*doc, "source_id", "indicator_code"]).select(
        *rows.columns,
        "resolved_physical_pages",
        F.when(F.col("__all"), F.lit("resolved")).otherwise(F.lit("unresolved")).alias("resolution_state"),
    )
