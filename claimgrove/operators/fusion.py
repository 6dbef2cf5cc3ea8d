"""Fusion of parser candidates into canonical blocks."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimgrove.functions.canonical import canonical_hash
from claimgrove.functions.text import nfc
from claimgrove.operators.claims import DOC

PAGE_KIND = [*DOC, "page_num", "kind"]
NATIVE = ("parser_name", "parser_run_id", "source_native_id")


def clusters(candidates: DataFrame, keys: Sequence[str] = PAGE_KIND) -> DataFrame:
    """Candidates with `cluster`: only candidates of one cluster can ever be fused.

    Fusion needs equal context and IoU >= 0.8, so the horizontal extents of two
    fusible boxes overlap and likewise the vertical ones. Splitting each page at
    horizontal gaps (a sweep over y) separates independent bands exactly; a
    group then holds one band of one page and kind instead of the page.
    """
    keys = list(keys)
    from claimgrove.operators.ordered import running

    located = candidates.filter(F.col("bbox").isNotNull()).withColumns(
        {"__y0": F.col("bbox.y0"), "__y1": F.col("bbox.y1")}
    )
    swept = running(
        located,
        keys,
        ["__y0", "__y1", *NATIVE],
        maxima_before={"__reach": F.col("__y1")},
        bucket=F.floor(F.col("__y0") / 64),
    )
    fresh = (F.col("__reach").isNull() | (F.col("__y0") >= F.col("__reach"))).cast("int")
    banded = running(
        swept.withColumn("__fresh", fresh),
        keys,
        ["__y0", "__y1", *NATIVE],
        sums={"cluster": F.col("__fresh")},
        bucket=F.floor(F.col("__y0") / 64),
    )
    return banded.select(*candidates.columns, "cluster")


def group_candidates(candidates: DataFrame, keys: Sequence[str] = PAGE_KIND) -> DataFrame:
    """Candidates with `group_no` per (page, kind, band): greedy complete link.

    Order-dependent by definition: candidates come in parser order, each joins
    the first group all of whose members it matches (same context, IoU >= 0.8,
    same fused table), else opens a group. Unlocated candidates stay alone.
    """
    keys = list(keys)
    banded = clusters(candidates, keys)
    types = {f.name: f.dataType.simpleString() for f in banded.schema.fields}
    schema = ", ".join(f"`{c}` {t}" for c, t in types.items()) + ", group_no int"
    order = list(NATIVE)

    def link(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values([order[0], order[1], order[2]], kind="stable")
        boxes = [(b["x0"], b["y0"], b["x1"], b["y1"]) for b in rows["bbox"]]
        contexts = [tuple(c) if c is not None else () for c in rows["context"]]
        kinds = rows["kind"].tolist()
        table_group = rows["table_group"].tolist() if "table_group" in rows else [None] * len(rows)
        if kinds and kinds[0] == "table_cell":
            # Grid numbers of parsers may differ; every other context must agree.
            contexts = [
                tuple(e for e in c if not e.startswith(("row number=", "column number=")))
                for c in contexts
            ]

        def matches(i, j):
            if contexts[i] != contexts[j] or table_group[i] != table_group[j]:
                return False
            a, b = boxes[i], boxes[j]
            w = max(0.0, min(a[2], b[2]) - max(a[0], b[0]))
            h = max(0.0, min(a[3], b[3]) - max(a[1], b[1]))
            both = w * h
            union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - both
            return union > 0 and both / union >= 0.8

        groups: list[list[int]] = []
        numbers = []
        for j in range(len(rows)):
            for g, members in enumerate(groups):
                if all(matches(i, j) for i in members):
                    members.append(j)
                    numbers.append(g)
                    break
            else:
                groups.append([j])
                numbers.append(len(groups) - 1)
        return rows.assign(group_no=numbers)

    linked = banded.groupBy(*keys, "cluster").applyInPandas(link, schema)
    group = canonical_hash(
        **{k: F.col(k).cast("string") for k in [*keys, "cluster", "group_no"]}
    )
    located = linked.withColumn("group_key", group).drop("cluster", "group_no")
    alone = candidates.filter(F.col("bbox").isNull()).withColumn(
        "group_key",
        canonical_hash(**{k: F.col(k).cast("string") for k in [*keys, *NATIVE]}),
    )
    return located.unionByName(alone)


def fuse(
    candidates: DataFrame, edges: DataFrame, keys: Sequence[str] = PAGE_KIND
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(blocks, edges, issues): canonical blocks, remapped edges, quality issues.

    Tables are grouped first; other kinds then merge only inside the same fused
    table. Text disagreement after normalisation is `conflicted` without winner;
    a block without a box is `unlocated`. All provenance stays in `members`.
    """
    doc = list(DOC)
    tables = group_candidates(candidates.filter(F.col("kind") == "table"), keys)
    lookup = tables.select(
        *doc,
        "parser_run_id",
        F.col("source_native_id").alias("table_native_id"),
        F.col("group_key").alias("table_group"),
    )
    others = candidates.filter(F.col("kind") != "table").join(
        lookup, [*doc, "parser_run_id", "table_native_id"], "left"
    ).select(*candidates.columns, "table_group")
    # A named table that is unknown keeps its own name, so it merges with nothing else.
    others = others.withColumn(
        "table_group",
        F.coalesce(
            "table_group",
            F.when(
                F.col("table_native_id").isNotNull(),
                F.concat_ws(":", "parser_run_id", "table_native_id"),
            ),
        ),
    )
    grouped = tables.withColumn("table_group", F.lit(None).cast("string")).unionByName(
        group_candidates(others, keys)
    )
    ordered = F.struct(*NATIVE, "raw_text", "bbox", "parser_family")
    text = nfc(F.col("raw_text"))
    blocks = (
        grouped.withColumn("__nfc", text)
        .groupBy(*keys, "group_key")
        .agg(
            # A group holds one candidate per matching region and parser.
            F.array_sort(F.collect_list(ordered)).alias("members"),
            F.min("__nfc").alias("__lo"),
            F.max("__nfc").alias("__hi"),
        )
    )
    conflict = F.col("__lo") != F.col("__hi")
    first = F.get("members", F.lit(0))
    blocks = blocks.select(
        *keys,
        F.col("group_key").alias("source_id"),
        F.when(conflict, F.lit("conflicted"))
        .when(first["bbox"].isNull(), F.lit("unlocated"))
        .otherwise(F.lit("unverified"))
        .alias("quality"),
        F.when(~conflict, F.lit(0)).alias("winner"),
        F.when(~conflict, first["raw_text"]).alias("raw_text"),
        first["bbox"].alias("bbox"),
        F.array_sort(
            F.array_distinct(F.transform("members", lambda m: m["parser_family"]))
        ).alias("parser_families"),
        "members",
    )
    alias = grouped.select(
        *doc, "parser_run_id", "source_native_id", F.col("group_key")
    )
    mapped = (
        edges.join(alias, [*doc, "parser_run_id", "source_native_id"], "left")
        .withColumnRenamed("group_key", "source_id")
        .drop("source_native_id")
        .join(
            alias.withColumnRenamed("source_native_id", "target_native_id"),
            [*doc, "parser_run_id", "target_native_id"],
            "left",
        )
        .withColumnRenamed("group_key", "target_id")
    )
    canonical_edges = (
        mapped.filter(F.col("source_id").isNotNull() & F.col("target_id").isNotNull())
        .select(*doc, "source_id", "target_id", "relation")
        .distinct()
    )
    issues = blocks.filter(F.col("quality").isin("conflicted", "unlocated")).select(
        *doc,
        "page_num",
        F.sha2(F.concat_ws(":", "source_id", "quality"), 256).alias("issue_id"),
        F.when(F.col("quality") == "conflicted", F.lit("parse_conflict"))
        .otherwise(F.lit("source_unlocated"))
        .alias("kind"),
        F.array("source_id").alias("source_ids"),
        F.lit("open").alias("state"),
    )
    dangling = mapped.filter(F.col("source_id").isNull() | F.col("target_id").isNull()).select(
        *doc,
        F.lit(None).cast("int").alias("page_num"),
        F.sha2(F.concat_ws(":", "parser_run_id", "target_native_id", "relation"), 256).alias("issue_id"),
        F.lit("dangling_edge").alias("kind"),
        F.array_compact(F.array("source_id", "target_id")).alias("source_ids"),
        F.lit("open").alias("state"),
    )
    return blocks, canonical_edges, issues.unionByName(dangling)
