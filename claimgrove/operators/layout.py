"""Page and table layout: axis roles, box overlap, nearest blocks, lines, sections."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from claimgrove.functions.geometry import iou
from claimgrove.functions.text import SPACE, casefold, collapse_space, section_role
from claimgrove.operators.claims import DOC
from claimgrove.operators.ordered import neighbours, numbered, running, top_k
from claimgrove.operators.search import chunked_top

TABLE = [*DOC, "table_native_id"]
PAGE = [*DOC, "page_num"]

# --- fixed values: tolerances, roles and priorities --------------------------------
IOU_THRESHOLD = 0.8
LINE_TOLERANCE = 2.5
BAND_TOLERANCE = 0.001
MARGIN_SHARE = 0.15
CONTEXT_PRIORITY = {"parent_paragraph": 0, "heading": 1, "nearby": 2}
CONTEXT_EXCLUDED_KINDS = ("table", "table_row", "table_cell")
CONTEXT_QUALITIES = ("verified", "unverified")
AXIS_PRIORITY = {"row_header": 0, "column_header": 1, "row_qualifier": 2}
# --- end of fixed values -------------------------------------------------------------


# ---------------------------------------------------------------- tables


def table_layout(cells: DataFrame, table: Sequence[str] = TABLE) -> DataFrame:
    """Per table: header band and stub columns, from its first cell's row span."""
    corner = F.min(F.struct("row_number", "column_number", "row_span")).alias("__corner")
    base = cells.groupBy(*table).agg(corner, F.min("column_number").alias("first_column"))
    depth = F.when(
        F.col("__corner.column_number") == F.col("first_column"), F.col("__corner.row_span")
    ).otherwise(F.lit(1))
    base = base.select(
        *table,
        F.col("__corner.row_number").alias("first_row"),
        "first_column",
        depth.alias("header_depth"),
    )
    stub = (
        cells.join(base, list(table))
        .filter(
            (F.col("row_number") == F.col("first_row"))
            & (F.col("row_span") == F.col("header_depth"))
        )
        .groupBy(*table)
        .agg(F.collect_set("column_number").alias("__stub"))
    )
    columns = F.coalesce("__stub", F.array().cast("array<int>"))
    return base.join(stub, list(table), "left").select(
        *base.columns,
        F.array_sort(
            F.array_distinct(F.concat(columns, F.array(F.col("first_column").cast("int"))))
        ).alias("stub_columns"),
    )


def table_axes(cells: DataFrame, table: Sequence[str] = TABLE) -> DataFrame:
    """Axis cells of every cell: (table, source_id, axis_id, role).

    Covering cells are spread over the rows (columns) they span, so the join is
    an equality on (table, row) or (table, column) and meets only related cells.
    """
    table = list(table)
    layout = table_layout(cells, table)
    focal = cells.select(
        *table,
        "source_id",
        F.col("row_number").alias("fr"),
        F.col("column_number").alias("fc"),
        (F.col("row_number") + F.col("row_span")).alias("fr_end"),
        (F.col("column_number") + F.col("column_span")).alias("fc_end"),
    )
    other = cells.join(layout, table).select(
        *table,
        F.col("source_id").alias("axis_id"),
        F.col("row_number").alias("r"),
        F.col("column_number").alias("c"),
        (F.col("row_number") + F.col("row_span")).alias("r_end"),
        (F.col("column_number") + F.col("column_span")).alias("c_end"),
        (F.col("first_row") + F.col("header_depth")).alias("header_end"),
        F.array_contains("stub_columns", F.col("column_number")).alias("stub"),
    )
    above = (
        other.filter(F.col("r_end") <= F.col("header_end"))
        .withColumn("fc", F.explode(F.sequence("c", F.col("c_end") - 1)))
        .join(focal, [*table, "fc"])
        .filter((F.col("fc_end") <= F.col("c_end")) & (F.col("r_end") <= F.col("fr")))
        .select(*table, "source_id", "axis_id", F.lit("column_header").alias("role"))
    )
    beside = (
        other.withColumn("fr", F.explode(F.sequence("r", F.col("r_end") - 1)))
        .join(focal, [*table, "fr"])
        .filter((F.col("fr_end") <= F.col("r_end")) & (F.col("c_end") <= F.col("fc")))
        .select(
            *table,
            "source_id",
            "axis_id",
            F.when(F.col("stub"), F.lit("row_header"))
            .otherwise(F.lit("row_qualifier"))
            .alias("role"),
        )
    )
    return above.unionByName(beside)


def axis_sources(axes: DataFrame, cells: DataFrame, table: Sequence[str] = TABLE) -> DataFrame:
    """Axis roles with their coordinates, in the order in which they are offered."""
    side = cells.select(
        *table,
        F.col("source_id").alias("axis_id"),
        F.col("row_number").alias("axis_row"),
        F.col("column_number").alias("axis_column"),
        F.col("text").alias("axis_text"),
    )
    priority = F.create_map(
        *[F.lit(x) for pair in AXIS_PRIORITY.items() for x in pair]
    )
    return axes.join(side, [*table, "axis_id"]).withColumn("priority", priority[F.col("role")])


def check_bands(
    bands: DataFrame,
    key: Sequence[str],
    index: str = "band",
    tolerance: float = BAND_TOLERANCE,
) -> DataFrame:
    """Bands with `reason`: degenerate_band, band_overlap_or_disorder or null."""
    rows = neighbours(
        bands, key, [index], previous={"__hi": F.col("hi")}, bucket=F.floor(F.col(index) / 1024)
    )
    return rows.withColumn(
        "reason",
        F.when(F.col("hi") <= F.col("lo"), F.lit("degenerate_band")).when(
            F.col("lo") + tolerance < F.col("__hi"), F.lit("band_overlap_or_disorder")
        ),
    ).drop("__hi")


def match_cells(
    cells: DataFrame, fragments: DataFrame, key: Sequence[str] = PAGE
) -> DataFrame:
    """Cells with the layout fragment of the same unique text, if there is one.

    A proposal needs the text once among cells, once among all fragments and
    once among the usable (unclipped) ones.
    """
    key = list(key)
    c = cells.withColumn("__t", collapse_space(F.col("text")))
    f = fragments.withColumn("__t", collapse_space(F.col("text")))
    per_cell = c.groupBy(*key, "__t").agg(F.count("*").alias("__cells"))
    per_fragment = f.groupBy(*key, "__t").agg(
        F.count("*").alias("__native"),
        F.count_if(~F.col("clipped")).alias("__usable"),
        F.min(F.when(~F.col("clipped"), F.col("fragment_id"))).alias("__id"),
    )
    joined = c.join(per_cell, [*key, "__t"]).join(per_fragment, [*key, "__t"], "left")
    usable = F.coalesce("__usable", F.lit(0))
    status = (
        F.when((F.col("__t") == "") | (usable == 0), F.lit("not_found"))
        .when(
            (usable == 1) & (F.col("__cells") == 1) & (F.col("__native") == 1),
            F.lit("unique_proposal"),
        )
        .otherwise(F.lit("ambiguous"))
    )
    return joined.withColumns(
        {
            "status": status,
            "fragment_id": F.when(status == "unique_proposal", F.col("__id")),
        }
    ).select(*cells.columns, "status", "fragment_id")


def compare_grids(
    evidence: DataFrame, claim: DataFrame, key: Sequence[str] = ("review_id",)
) -> DataFrame:
    """Literal comparison per (key, label, unit, year): shared / equal / differing / ambiguous."""
    key = list(key)
    cell = [*key, "label", "unit", "year"]

    def index(df: DataFrame, name: str) -> DataFrame:
        clean = df.select(
            *key,
            *[collapse_space(F.coalesce(c, F.lit(""))).alias(c) for c in ("label", "unit", "year", "value")],
        )
        return (
            clean.groupBy(*cell, "value")
            .agg(F.lit(1).alias("one"))
            .groupBy(*cell)
            .agg(
                F.count("*").alias(f"{name}_values"),
                F.min("value").alias(f"{name}_min"),
                # Order-free digest of the distinct values of the cell.
                F.sum(F.xxhash64("value").cast("decimal(38,0)")).alias(f"{name}_set"),
            )
        )

    joined = index(evidence, "e").join(index(claim, "c"), cell, "full")
    shared = F.col("e_values").isNotNull() & F.col("c_values").isNotNull()
    same = (F.col("e_values") == F.col("c_values")) & (F.col("e_set") == F.col("c_set"))
    ambiguous = shared & ((F.col("e_values") != 1) | (F.col("c_values") != 1))
    return joined.select(
        *cell,
        shared.alias("shared"),
        F.coalesce(shared & same & ~ambiguous, F.lit(False)).alias("equal"),
        F.coalesce(shared & ~same, F.lit(False)).alias("differing"),
        F.coalesce(ambiguous, F.lit(False)).alias("ambiguous"),
    )


def grid_holds(compared: DataFrame, key: Sequence[str] = ("review_id",)) -> DataFrame:
    """Counts and holds per review; equal values never establish identity."""
    labels = compared.groupBy(*key, "label").agg(
        F.bool_or("shared").alias("both"), F.bool_and(~F.col("shared")).alias("single")
    )
    label_diff = labels.groupBy(*key).agg(F.bool_or("single").alias("labels_differ"))
    totals = compared.groupBy(*key).agg(
        F.count_if("shared").alias("shared_cells"),
        F.count_if("differing").alias("differing_cells"),
        F.count_if("ambiguous").alias("ambiguous_cells"),
    )
    return totals.join(label_diff, list(key)).withColumn(
        "holds",
        F.array_compact(
            F.array(
                F.when(F.col("differing_cells") > 0, F.lit("shared_grid_values_differ")),
                F.when(F.col("ambiguous_cells") > 0, F.lit("shared_grid_cell_not_unique")),
                F.when(F.col("labels_differ"), F.lit("shared_grid_row_labels_differ")),
                F.lit("population_not_established_by_equal_values"),
            )
        ),
    )


# ---------------------------------------------------------------- boxes


def iou_pairs(
    boxes: DataFrame,
    keys: Sequence[str] = (*PAGE, "kind"),
    box_id: str = "candidate_id",
    threshold: float = IOU_THRESHOLD,
) -> DataFrame:
    """Pairs of distinct boxes of a page with IoU >= threshold, with member counts.

    Equal boxes are folded into one (`left_n`, `right_n` members, smallest id as
    name), so a pile of copies gives one row and not its square. IoU >= t bounds
    the width and height ratios by 1/t and the corner offsets by (1-t) times the
    larger side; boxes therefore meet on (size class, position cell) keys only. A box
    probes the next cell only from nearer than that offset. The cells are sorted and merged: their
    rows are many times the boxes, which the size estimate of a broadcast does not see.
    """
    keys = list(keys)
    sides = ["x0", "y0", "x1", "y1"]
    folded = boxes.groupBy(*keys, *[F.col(f"bbox.{s}").alias(s) for s in sides]).agg(
        F.min(box_id).alias("id"), F.count("*").alias("n")
    )
    folded = folded.filter((F.col("x1") > F.col("x0")) & (F.col("y1") > F.col("y0")))
    base = math.log(1 / threshold)
    # The epsilon keeps sizes that sit exactly on a class edge comparable.
    cls = lambda a, b: F.floor(F.log(F.col(b) - F.col(a)) / base - 1e-9).cast("int")
    sized = folded.withColumns({"cw": cls("x0", "x1"), "ch": cls("y0", "y1")})
    either = lambda c: F.explode(F.array(F.col(c), F.col(c) + 1))
    spread = sized.withColumn("kw", either("cw")).withColumn("kh", either("ch"))
    at = lambda pos, k: F.col(pos) / F.exp((F.col(k) + 2) * base)
    cell = lambda c: F.floor(c).cast("bigint")
    placed = spread.withColumns({"gx": cell(at("x0", "kw")), "gy": cell(at("y0", "kh"))})
    # The larger side of class k is below threshold^-(k+1), a cell is threshold^-(k+2) wide.
    reach = (1 - threshold) * threshold + 1e-6
    around = lambda pos, k: F.explode(
        F.sequence(cell(at(pos, k) - reach), cell(at(pos, k) + reach))
    )
    probe = placed.withColumn("px", around("x0", "kw")).withColumn("py", around("y0", "kh"))
    probe = probe.select(
        *[F.col(k).alias(f"__{k}") for k in keys],
        F.col("kw").alias("__kw"),
        F.col("kh").alias("__kh"),
        F.col("px").alias("__gx"),
        F.col("py").alias("__gy"),
        F.struct(*sides).alias("right"),
        F.col("id").alias("right_id"),
        F.col("n").alias("right_n"),
        F.col("cw").alias("rw"),
        F.col("ch").alias("rh"),
    )
    condition = F.col("id") < F.col("right_id")
    for k in [*keys, "kw", "kh", "gx", "gy"]:
        condition = condition & (F.col(k) == F.col(f"__{k}"))
    # A pair meets once: in the class of its larger box.
    condition = condition & (F.col("kw") == F.greatest("cw", "rw"))
    condition = condition & (F.col("kh") == F.greatest("ch", "rh"))
    pairs = placed.withColumn("left", F.struct(*sides)).join(probe.hint("merge"), condition)
    return (
        pairs.withColumn("iou", iou(F.col("left"), F.col("right")))
        .filter(F.col("iou") >= threshold)
        .select(
            *keys,
            F.col("id").alias("left_id"),
            "right_id",
            F.col("n").alias("left_n"),
            "right_n",
            "iou",
        )
    )


def nearest_blocks(
    claims: DataFrame, blocks: DataFrame, page: Sequence[str] = PAGE, k: int = 2
) -> DataFrame:
    """The `k` nearest eligible blocks of a claim's page by centre distance.

    `claims` are (page, query_id, bbox, exclude ARRAY of ids); ties go by box,
    text and id. Tables and unreadable or blank blocks never count.
    """
    eligible = blocks.filter(
        F.col("quality").isin(*CONTEXT_QUALITIES)
        & F.col("winner").isNotNull()
        & ~F.col("kind").isin(*CONTEXT_EXCLUDED_KINDS)
        & F.col("raw_text").rlike(f"[^{SPACE}]")
        & F.col("bbox").isNotNull()
    )
    corners = [F.col(f"bbox.{s}").alias(s) for s in ("x0", "y0", "x1", "y1")]
    targets = eligible.select(*page, "source_id", *corners, "raw_text")
    queries = claims.filter(F.col("bbox").isNotNull()).select(
        *page,
        "query_id",
        ((F.col("bbox.x0") + F.col("bbox.x1")) / 2).alias("cx"),
        ((F.col("bbox.y0") + F.col("bbox.y1")) / 2).alias("cy"),
        "exclude",
    )

    def closeness(a: pd.DataFrame, b: pd.DataFrame):
        import numpy as np

        bx = ((b["x0"] + b["x1"]) / 2).to_numpy()
        by = ((b["y0"] + b["y1"]) / 2).to_numpy()
        score = -(
            np.abs(a["cx"].to_numpy()[:, None] - bx[None, :])
            + np.abs(a["cy"].to_numpy()[:, None] - by[None, :])
        )
        place = {source: i for i, source in enumerate(b["source_id"])}
        for row, excluded in enumerate(a["exclude"]):
            for source in excluded if excluded is not None else ():
                if source in place:
                    score[row, place[source]] = np.nan
        return score

    found = chunked_top(
        queries,
        targets,
        page,
        closeness,
        ["cx", "cy", "exclude"],
        ["x0", "y0", "x1", "y1", "raw_text"],
        k,
        tie=["x0", "y0", "x1", "y1", "raw_text", "source_id"],
    )
    return found.select(*page, "query_id", "source_id", "rank", (-F.col("score")).alias("distance"))


def context_blocks(
    claims: DataFrame, blocks: DataFrame, edges: DataFrame, page: Sequence[str] = PAGE
) -> DataFrame:
    """Context of each claim: parent paragraph, unambiguous heading, two nearest blocks.

    `claims` are one source span each: (page, claim_id, source_id, char_start,
    char_end). One row per context block with `role` and its priority.
    """
    doc = list(page[:-1])
    block = blocks.select(
        *page,
        "source_id",
        "bbox",
        "quality",
        "winner",
        "raw_text",
    )
    own = claims.join(block, [*page, "source_id"])
    parent = own.filter(
        F.col("winner").isNotNull()
        & (F.col("char_end") - F.col("char_start") < F.length("raw_text"))
    ).select(
        *doc, "claim_id", F.col("source_id").alias("context_id"), F.lit("parent_paragraph").alias("role")
    )
    section = (
        edges.filter(F.col("relation") == "section_parent")
        .groupBy(*doc, "source_id")
        .agg(F.min("target_id").alias("lo"), F.max("target_id").alias("hi"))
        .filter(F.col("lo") == F.col("hi"))
        .select(*doc, "source_id", F.col("lo").alias("context_id"))
    )
    usable = blocks.filter(
        F.col("quality").isin(*CONTEXT_QUALITIES)
        & F.col("winner").isNotNull()
        & F.col("raw_text").rlike(f"[^{SPACE}]")
    ).select(*doc, F.col("source_id").alias("context_id"))
    heading = (
        own.select(*doc, "claim_id", "source_id")
        .join(section, [*doc, "source_id"])
        .filter(F.col("context_id") != F.col("source_id"))
        .join(usable, [*doc, "context_id"], "left_semi")
        .select(*doc, "claim_id", "context_id", F.lit("heading").alias("role"))
    )
    known = (
        claims.select(*doc, "claim_id", F.col("source_id").alias("context_id"))
        .unionByName(heading.select(*doc, "claim_id", "context_id"))
        .groupBy(*doc, "claim_id")
        .agg(F.collect_set("context_id").alias("exclude"))
    )
    queries = own.join(known, [*doc, "claim_id"]).select(
        *page, F.col("claim_id").alias("query_id"), "bbox", "exclude"
    )
    near = nearest_blocks(queries, blocks, page).select(
        *doc,
        F.col("query_id").alias("claim_id"),
        F.col("source_id").alias("context_id"),
        F.lit("nearby").alias("role"),
    )
    priority = F.create_map(*[F.lit(x) for p in CONTEXT_PRIORITY.items() for x in p])
    return (
        parent.unionByName(heading)
        .unionByName(near)
        .withColumn("priority", priority[F.col("role")])
        .groupBy(*doc, "claim_id", "context_id")
        .agg(F.min(F.struct("priority", "role")).alias("best"))
        .select(*doc, "claim_id", "context_id", "best.role", "best.priority")
    )


def bounded_context(
    context: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    item: str,
    text: str,
    max_blocks: int = 6,
    max_chars: int = 2000,
) -> DataFrame:
    """Whole blocks of the first `max_blocks` that fit the character budget.

    Every block after the first costs one separator. Returns chosen and omitted
    ids in order; only `max_blocks` rows per group are gathered.
    """
    by = list(by)
    counted = context.groupBy(*by).agg(F.count("*").alias("n_context"))
    first = top_k(context, by, order, max_blocks, "__rank")
    entry = F.struct("__rank", F.col(item).alias("__item"), F.length(text).alias("__size"))
    gathered = first.groupBy(*by).agg(F.array_sort(F.collect_list(entry)).alias("__items"))
    kind = context.schema[item].dataType.simpleString()
    start = F.struct(
        F.array().cast(f"array<{kind}>").alias("chosen"),
        F.array().cast(f"array<{kind}>").alias("omitted"),
        F.lit(0).alias("used"),
    )

    def step(acc: Column, e: Column) -> Column:
        size = e["__size"] + F.when(F.size(acc["chosen"]) > 0, 1).otherwise(0)
        fits = acc["used"] + size <= max_chars
        one = F.array(e["__item"])
        return F.struct(
            F.when(fits, F.concat(acc["chosen"], one)).otherwise(acc["chosen"]).alias("chosen"),
            F.when(fits, acc["omitted"]).otherwise(F.concat(acc["omitted"], one)).alias("omitted"),
            F.when(fits, acc["used"] + size).otherwise(acc["used"]).alias("used"),
        )

    folded = gathered.select(*by, F.aggregate("__items", start, step).alias("f"))
    return folded.join(counted, by).select(
        *by,
        "f.chosen",
        "f.omitted",
        "f.used",
        F.greatest(F.lit(0), F.col("n_context") - max_blocks).alias("n_beyond"),
    )


# ---------------------------------------------------------------- lines, runs, notes


def _line_starts(rows: pd.DataFrame, tolerance: float) -> list[int]:
    lines, top, line = [], None, 0
    for value in rows["y0"]:
        if top is None or abs(value - top) > tolerance:
            line, top = line + 1, value
        lines.append(line)
    return lines


def group_lines(
    words: DataFrame, page: Sequence[str] = PAGE, tolerance: float = LINE_TOLERANCE
) -> DataFrame:
    """Words with `line_no`: a word joins a line within `tolerance` of its *first* word.

    The reference point is the line's start, so a plain lag gap would be wrong.
    Line starts more than `tolerance` apart from every earlier word begin a new
    independent stretch; only such a stretch is folded in one group, not a page.
    """
    page = list(page)
    rows = neighbours(
        words, page, ["y0", "x0", "word_id"], previous={"__py": F.col("y0")},
        bucket=F.floor(F.col("y0") / 64),
    )
    fresh = (F.col("__py").isNull() | (F.col("y0") - F.col("__py") > tolerance)).cast("int")
    rows = running(
        rows.withColumn("__fresh", fresh),
        page,
        ["y0", "x0", "word_id"],
        sums={"__stretch": F.col("__fresh")},
        bucket=F.floor(F.col("y0") / 64),
    )
    rows = rows.withColumn("__chunk", F.floor((F.col("__stretch") - 1) / 256)).drop(
        "__py", "__fresh", "__stretch"
    )
    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = ", ".join(f"`{c}` {t}" for c, t in types.items()) + ", __local int"

    def fold(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["y0", "x0", "word_id"])
        return group.assign(__local=_line_starts(group, tolerance))

    # A stretch always opens a line, so a run of stretches folds as one group.
    local = rows.groupBy(*page, "__chunk").applyInPandas(fold, schema)
    counts = local.groupBy(*page, "__chunk").agg(F.max("__local").alias("__n"))
    w = W.partitionBy(*page).orderBy("__chunk").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select(
        *page, "__chunk", F.coalesce(F.sum("__n").over(w), F.lit(0)).alias("__off")
    )
    return local.join(offsets, [*page, "__chunk"]).select(
        *words.columns, (F.col("__local") + F.col("__off")).cast("int").alias("line_no")
    )


def word_runs(words: DataFrame, page: Sequence[str] = PAGE) -> DataFrame:
    """Runs of words of one visual line, cut where the gap exceeds the text height.

    A word joins the latest line whose first word is within a quarter of the
    smaller height. Where the tops of two words in order lie further apart than a quarter of
    the page's greatest height, no later word can join an earlier line, so only the
    stretches between such places are folded, each in a group of its own.
    """
    page = list(page)
    height = F.col("y1") - F.col("y0")
    tallest = words.groupBy(*page).agg(F.max(height).alias("__tallest"))
    order = ["y0", "x0", "word_id"]
    bucket = F.floor(F.col("y0") / 64)
    rows = neighbours(
        words.join(tallest, page), page, order, previous={"__py": F.col("y0")}, bucket=bucket
    )
    apart = F.col("y0") - F.col("__py") > F.col("__tallest") * 0.25
    fresh = (F.col("__py").isNull() | apart).cast("int")
    rows = running(
        rows.withColumn("__fresh", fresh), page, order, sums={"__stretch": F.col("__fresh")}, bucket=bucket
    ).select(*words.columns, "__stretch")
    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = ", ".join(f"`{c}` {t}" for c, t in types.items()) + ", __local int"

    def fold(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(order)
        tops, heights = group["y0"].to_numpy(), (group["y1"] - group["y0"]).to_numpy()
        opened: list[int] = []  # rows that opened a line
        numbers = []
        for row, (top, tall) in enumerate(zip(tops, heights)):
            own = np.array(opened, dtype=int)
            near = np.abs(tops[own] - top) <= np.minimum(heights[own], tall) * 0.25
            if near.any():
                numbers.append(int(np.flatnonzero(near)[-1]))
            else:
                numbers.append(len(opened))
                opened.append(row)
        return group.assign(__local=numbers)

    local = rows.groupBy(*page, "__stretch").applyInPandas(fold, schema)
    counts = local.groupBy(*page, "__stretch").agg((F.max("__local") + 1).alias("__n"))
    before = W.partitionBy(*page).orderBy("__stretch").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select(
        *page, "__stretch", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__off")
    )
    lined = local.join(offsets, [*page, "__stretch"]).select(
        *words.columns, (F.col("__local") + F.col("__off")).cast("int").alias("line_no")
    )
    w = W.partitionBy(*page, "line_no").orderBy("x0", "word_id")
    tall = F.greatest(
        F.col("y1") - F.col("y0"), F.lag("y1").over(w) - F.lag("y0").over(w)
    )
    cut = F.coalesce((F.col("x0") - F.lag("x1").over(w)) > tall, F.lit(True)).cast("int")
    numbered_runs = lined.withColumn("__cut", cut).withColumn("run_no", F.sum("__cut").over(w))
    entry = F.struct("x0", "word_id", "text")
    return (
        numbered_runs.groupBy(*page, "line_no", "run_no")
        .agg(
            F.array_sort(F.collect_list(entry)).alias("w"),
            F.min("x0").alias("x0"),
            F.min("y0").alias("y0"),
            F.max("x1").alias("x1"),
            F.max("y1").alias("y1"),
        )
        .select(
            *page,
            "line_no",
            "run_no",
            F.array_join(F.transform("w", lambda e: e["text"]), " ").alias("text"),
            F.transform("w", lambda e: e["word_id"]).alias("word_ids"),
            "x0",
            "y0",
            "x1",
            "y1",
        )
    )


def note_groups(
    lines: DataFrame,
    page: Sequence[str] = PAGE,
    order: Sequence[str] = ("y0", "x0"),
    start: str = r"^[\[(]?\d{1,2}[\])]",
    bucket: Column | None = None,
) -> DataFrame:
    """Lines with `note_no`: a numbered start opens a note, following lines attach."""
    is_start = F.col("text").rlike(start).cast("int")
    return running(
        lines.withColumn("__s", is_start), page, order, sums={"note_no": F.col("__s")}, bucket=bucket
    ).drop("__s")


def row_islands(
    nodes: DataFrame,
    key: Sequence[str],
    order: Sequence[str] = ("position",),
    group: str = "row_group",
    bucket: Column | None = None,
    max_chars: int | None = None,
) -> DataFrame:
    """Complete consecutive runs of one disclosed row: (key, group, first, last, n, text length).

    A run counts only with at least two nodes, exactly the disclosed number of
    cells (`disclosed`) and, if `max_chars` is given, at most that length; partial
    rows are skipped.
    """
    key = list(key)
    bucket = F.floor(F.col(order[0]) / 8192) if bucket is None else bucket
    sided = neighbours(nodes, key, order, previous={"__pg": F.struct(F.col(group).alias("g"))}, bucket=bucket)
    change = (F.col("__pg").isNull() | ~F.col("__pg.g").eqNullSafe(F.col(group))).cast("int")
    runs = running(
        sided.withColumn("__change", change), key, order, sums={"__run": F.col("__change")}, bucket=bucket
    )
    position = F.col(order[0])
    folded = (
        runs.filter(F.col(group).isNotNull())
        .groupBy(*key, group, "__run")
        .agg(
            F.min(position).alias("first_position"),
            F.max(position).alias("last_position"),
            F.count("*").alias("n"),
            F.max("disclosed").alias("disclosed"),
            (F.sum(F.length("text")) + F.count("*") - 1).alias("n_chars"),
        )
    )
    whole = folded.filter((F.col("n") > 1) & (F.col("n") == F.col("disclosed"))).drop("__run")
    return whole if max_chars is None else whole.filter(F.col("n_chars") <= max_chars)


# ---------------------------------------------------------------- sections


def section_ranges(
    anchors: DataFrame, documents: DataFrame, key: Sequence[str] = DOC
) -> DataFrame:
    """Sections of each document: start, end and role, from anchors on pages.

    Page 1 always starts a section. Anchors of one page must agree on one role,
    else the section is a conflict. An unmatched large heading does not override
    a classified outline entry of the same page.
    """
    key = list(key)
    roles = anchors.withColumn("role", section_role(F.col("path")))
    listed = F.col("method").isin("outline", "toc_links", "toc_text_fallback")
    matched_any = section_role_any(F.col("path"))
    per_page = roles.groupBy(*key, "page").agg(
        F.bool_or(listed & (F.col("role") != "unknown")).alias("explicit"),
        F.collect_set("role").alias("all_roles"),
        F.collect_set(
            F.when(
                ~(
                    (F.col("method") == "large_heading_fallback")
                    & (F.col("role") == "unknown")
                    & ~matched_any
                ),
                F.col("role"),
            )
        ).alias("strong_roles"),
    )
    chosen = F.when(F.col("explicit"), F.col("strong_roles")).otherwise(F.col("all_roles"))
    role = (
        F.when(F.size(chosen) == 0, F.lit("unknown"))
        .when(F.size(chosen) == 1, F.get(chosen, F.lit(0)))
        .otherwise(F.lit("conflict"))
    )
    starts = per_page.select(*key, F.col("page").alias("start_page"), role.alias("role"))
    first = documents.select(*key, F.lit(1).alias("start_page")).join(
        starts.select(*key, "start_page"), [*key, "start_page"], "left_anti"
    )
    every = starts.unionByName(first.withColumn("role", F.lit("unknown")))
    ended = neighbours(
        every,
        key,
        ["start_page"],
        following={"__next": F.col("start_page")},
        bucket=F.floor(F.col("start_page") / 1024),
    )
    return ended.join(documents.select(*key, "page_count"), key).select(
        *key,
        "start_page",
        F.coalesce(F.col("__next") - 1, F.col("page_count")).alias("end_page"),
        "role",
    )


def section_role_any(path: Column) -> Column:
    """True when any title of the path matches any role pattern."""
    from claimgrove.functions.text import SECTION_ROLES

    pattern = "(?i)" + "|".join(f"(?:{p})" for p in SECTION_ROLES.values())
    return F.exists(path, lambda t: t.rlike(pattern))


def section_pages(sections: DataFrame, key: Sequence[str] = DOC) -> DataFrame:
    """One row per page with its role and whether it feeds claims or evidence."""
    return sections.select(
        *key, "role", F.explode(F.sequence("start_page", "end_page")).alias("page_num")
    ).withColumns(
        {
            "claim_candidate": F.col("role") == "e_narrative",
            "evidence_candidate": F.col("role").isin("e_narrative", "esg_data", "appendix"),
        }
    )


def boilerplate_lines(
    lines: DataFrame,
    key: Sequence[str] = DOC,
    page: str = "page_num",
    min_pages: int = 2,
) -> DataFrame:
    """Margin lines whose text, without digits and blanks, repeats on several pages.

    `lines` bring top, bottom and page_height. Pages are counted in two partial
    aggregations, so a line on very many pages is never gathered.
    """
    key = list(key)
    margin = (F.col("top") <= MARGIN_SHARE * F.col("page_height")) | (
        F.col("bottom") >= (1 - MARGIN_SHARE) * F.col("page_height")
    )
    folded = F.regexp_replace(casefold(F.col("text")), rf"[{SPACE}]+|\p{{Nd}}+", "")
    once = (
        lines.filter(margin)
        .select(*key, page, folded.alias("line"))
        .filter(F.col("line") != "")
        .groupBy(*key, "line", page)
        .agg(F.lit(1).alias("one"))
    )
    return (
        once.groupBy(*key, "line")
        .agg(F.count("*").alias("n_pages"))
        .filter(F.col("n_pages") >= min_pages)
    )


def interleave(
    df: DataFrame, kind: str, kinds: Sequence[str], order: Sequence[str], limit: int
) -> DataFrame:
    """Round-robin over kinds (first of each, second of each, ...) up to `limit` rows."""
    place = F.create_map(*[F.lit(x) for i, k in enumerate(kinds) for x in (k, i)])
    ranked = top_k(df.filter(F.col(kind).isin(*kinds)), [kind], order, limit, "__rn")
    return (
        ranked.withColumn("__kind", place[F.col(kind)])
        .orderBy("__rn", "__kind")
        .limit(limit)
        .drop("__rn", "__kind")
    )


def position_numbers(df: DataFrame, key: Sequence[str], order: Sequence[str], bucket=None) -> DataFrame:
    return numbered(df, key, order, "position", bucket)
