"""Tables to observations: span expansion, header roles, wide to long."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimgrove.functions.canonical import canonical_hash
from claimgrove.functions.numbers import in_cell_unit, normalize_value
from claimgrove.functions.text import scope_note, strip, unit_note
from claimgrove.operators.claims import DOC
from claimgrove.session import cut_lineage

TABLE = [*DOC, "table_native_id"]

# --- fixed values: header vocabulary ---------------------------------------------------
HEADERS = {
    "metric_raw": ("지표", "metric", "항목"),
    "scope": ("scope",),
    "subject": ("사업장", "조직", "기업", "entity", "subject"),
    "reporting_period": ("연도", "기간", "year", "period"),
    "scope2_basis": ("산정방식", "시장/위치기반", "measurement basis", "scope2 basis"),
    "organizational_boundary": ("조직경계", "organizational boundary"),
    "unit_raw": ("단위", "unit"),
    "value_raw": ("값", "수치", "value"),
    "denominator": ("분모", "denominator"),
    "baseline_period": ("기준연도", "baseline year"),
    "category": ("카테고리", "category"),
    "method": ("산정방법", "method"),
}
BASIS_HEADERS = ("시장기반", "위치기반", "market-based", "location-based")
YEAR_HEADER = "^[12][0-9]{3}년?$"
# --- end of fixed values -----------------------------------------------------------------

FIELDS = tuple(f for f in HEADERS if f != "value_raw")


def header_role(text: Column) -> Column:
    """Role named by a header literal, else null."""
    pairs = [
        F.lit(x) for field, labels in HEADERS.items() for label in labels for x in (label, field)
    ]
    return F.create_map(*pairs)[F.lower(strip(text))]


def expand_grid(
    cells: DataFrame, table: Sequence[str] = TABLE, limit: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """(grid, issues): one row per covered grid position; a table with overlapping
    cells is an issue and keeps no grid rows, and so is one above `limit` positions, if
    a limit is given. The size is summed before anything is expanded.
    """
    table = list(table)
    area = F.coalesce("row_span", F.lit(1)).cast("bigint") * F.coalesce("column_span", F.lit(1))
    sizes = cells.groupBy(*table).agg(F.sum(area).alias("__area"))
    sized = cells.join(sizes, table)
    within = F.lit(True) if limit is None else F.col("__area") <= limit
    ok = sized.filter(within).drop("__area")
    last = lambda start, span: F.col(start) + F.coalesce(span, F.lit(1)) - 1
    grid = (
        ok.withColumn(
            "row", F.explode(F.sequence(F.col("row_number"), last("row_number", "row_span")))
        )
        .withColumn(
            "col",
            F.explode(F.sequence(F.col("column_number"), last("column_number", "column_span"))),
        )
    )
    overlapping = (
        grid.groupBy(*table, "row", "col")
        .agg(F.count("*").alias("n"))
        .groupBy(*table)
        .agg(F.max("n").alias("n"))
        .filter("n > 1")
        .select(*table)
    )
    issues = (
        sizes.filter(F.col("__area") > limit)
        .select(*table, F.lit("cell_expansion_limit_exceeded").alias("reason"))
        .unionByName(overlapping.withColumn("reason", F.lit("cells_overlap")))
    )
    return grid.join(overlapping, table, "left_anti"), issues


def detect_headers(
    grid: DataFrame, table: Sequence[str] = TABLE
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(columns, layout, issues) of expanded tables.

    Leading full-width single-cell rows are titles and never give roles. The
    first other row is the header; a second header row may give the market or
    location basis. Anything ambiguous is an issue of the whole table.
    """
    table = list(table)
    shape = grid.groupBy(*table).agg(
        F.min("row").alias("min_row"),
        F.min("col").alias("min_col"),
        F.count_distinct("col").alias("n_cols"),
    )
    bands = grid.groupBy(*table, "row").agg(
        F.count("*").alias("n"),
        F.min("source_id").alias("lo"),
        F.max("source_id").alias("hi"),
        F.min("column_number").alias("start"),
        F.min(F.coalesce("column_span", F.lit(1))).alias("span"),
    )
    marked = bands.join(shape, table).withColumn(
        "title",
        (F.col("lo") == F.col("hi"))
        & (F.col("n") == F.col("n_cols"))
        & (F.col("start") == F.col("min_col"))
        & (F.col("span") == F.col("n_cols")),
    )
    first_plain = marked.groupBy(*table).agg(
        F.min(F.when(~F.col("title"), F.col("row"))).alias("plain_row"),
        F.max("row").alias("max_row"),
    )
    gaps = (
        marked.join(first_plain, table)
        .filter(F.col("row") <= F.col("plain_row"))
        .groupBy(*table)
        .agg(F.count("*").alias("upto"))
    )
    layout = (
        shape.join(first_plain, table)
        .join(gaps, table, "left")
        .withColumn(
            "header_row",
            F.when(
                F.col("plain_row").isNotNull()
                & (F.col("upto") == F.col("plain_row") - F.col("min_row") + 1),
                F.col("plain_row"),
            ).otherwise(F.col("min_row")),
        )
        .select(*table, "min_row", "header_row", "n_cols", "max_row")
    )
    # Header facts are tiny next to the grid and read by many branches below, so
    # each step is materialised once instead of being replanned per branch.
    layout = cut_lineage(layout)
    placed = grid.join(layout.select(*table, "header_row"), table)
    head = cut_lineage(placed.filter(F.col("row") == F.col("header_row"))).select(
        *table,
        "col",
        F.col("source_id").alias("header_id"),
        F.col("text").alias("header_text"),
        header_role(F.col("text")).alias("role"),
        strip(F.col("text")).rlike(YEAR_HEADER).alias("is_year"),
        (F.col("row_number") + F.coalesce("row_span", F.lit(1))).alias("header_end"),
    )
    is_basis = F.lower(strip(F.col("text"))).isin(*BASIS_HEADERS)
    second = (
        placed.filter(F.col("row") == F.col("header_row") + 1)
        .join(head.select(*table, F.col("header_id").alias("source_id")).distinct().withColumn("__h", F.lit(True)), [*table, "source_id"], "left")
        .select(
            *table,
            "col",
            F.col("source_id").alias("basis_id"),
            F.col("text").alias("basis_text"),
            is_basis.alias("is_basis"),
            F.coalesce("__h", F.lit(False)).alias("is_header"),
        )
    )
    basis_row = second.groupBy(*table).agg(
        (F.bool_or("is_basis") & F.bool_and(F.col("is_basis") | F.col("is_header"))).alias("has_basis")
    )
    columns = (
        head.join(second.filter("is_basis").select(*table, "col", "basis_id", "basis_text"), [*table, "col"], "left")
        .join(basis_row, table, "left")
        .withColumn("has_basis", F.coalesce("has_basis", F.lit(False)))
    )
    columns = cut_lineage(columns).withColumns(
        {
            "basis_text": F.when(F.col("has_basis"), F.col("basis_text")),
            "basis_id": F.when(F.col("has_basis"), F.col("basis_id")),
        }
    )
    roles = columns.groupBy(*table).agg(
        F.max(F.when(F.col("role") == "reporting_period", 1).otherwise(0)).alias("has_period"),
        F.max(F.when(F.col("role") == "metric_raw", 1).otherwise(0)).alias("has_metric"),
        F.max(F.when(F.col("role") == "value_raw", 1).otherwise(0)).alias("has_value"),
        F.max("header_end").alias("header_end"),
        F.max("has_basis").alias("has_basis"),
    )
    columns = columns.drop("has_basis", "header_end").join(roles, table)
    metric_column = (
        F.col("role").isNull()
        & (F.col("has_period") == 1)
        & (F.col("has_metric") == 0)
        & (F.col("has_value") == 0)
    )
    columns = columns.withColumn("is_metric", metric_column).withColumn(
        "is_value", (F.col("role") == "value_raw") | F.col("is_year") | F.col("is_metric")
    )
    columns = cut_lineage(columns.withColumn("is_value", F.coalesce("is_value", F.lit(False))))
    roles = cut_lineage(roles)
    repeated_role = (
        columns.filter(F.col("role").isNotNull())
        .groupBy(*table, "role")
        .agg(F.count("*").alias("n"))
        .groupBy(*table)
        .agg((F.max("n") > 1).alias("repeated_role"))
    )
    shared_header = (
        columns.filter("is_value")
        .groupBy(*table, "header_id")
        .agg(
            F.count("*").alias("n"),
            F.bool_and(F.col("basis_id").isNotNull()).alias("all_basis"),
        )
        .groupBy(*table)
        .agg(
            F.bool_or((F.col("n") > 1) & ~F.col("all_basis")).alias("second_level"),
            F.lit(True).alias("has_values"),
        )
    )
    deeper = (
        grid.join(columns.filter("is_value").select(*table, "col", "header_end", "has_basis"), [*table, "col"])
        .join(layout.select(*table, "header_row"), table)
        .filter((F.col("row") > F.col("header_row")) & (F.col("row") < F.col("header_end")))
        .filter(~(F.col("has_basis") & (F.col("row") == F.col("header_row") + 1)))
        .join(
            head.select(*table, F.col("header_id").alias("source_id")).distinct(),
            [*table, "source_id"],
            "left_anti",
        )
        .select(*table)
        .distinct()
        .withColumn("deeper", F.lit(True))
    )
    verdict = (
        roles.join(repeated_role, table, "left")
        .join(shared_header, table, "left")
        .join(deeper, table, "left")
        .join(columns.groupBy(*table).agg(F.bool_or("is_metric").alias("any_metric"), F.bool_or("is_year").alias("any_year")), table)
    )
    no = F.lit(False)
    bad = (
        F.coalesce("repeated_role", no)
        | F.coalesce("second_level", no)
        | F.coalesce("deeper", no)
        | F.col("has_values").isNull()
        | ((F.col("has_metric") == 0) & ~F.col("any_metric"))
        | ((F.col("has_period") == 0) & ~F.col("any_year"))
    )
    issues = cut_lineage(
        verdict.filter(bad).select(*table, F.lit("table_headers_ambiguous").alias("reason"))
    )
    return (
        columns.join(issues, table, "left_anti"),
        layout.join(roles.select(*table, "has_basis"), table).join(issues, table, "left_anti"),
        issues,
    )


def unpivot_table(
    grid: DataFrame,
    columns: DataFrame,
    layout: DataFrame,
    notes: DataFrame | None = None,
    table: Sequence[str] = TABLE,
) -> DataFrame:
    """Observations: one row per value column and data row, with its bound fields.

    `notes` are footnotes attached to a cell or to the table (table, target_id,
    note_id, text). Unknown never becomes zero: `value_state` is value, missing,
    unreadable or conflict and the raw text always stays.
    """
    table = list(table)
    body = grid.join(layout.select(*table, "header_row", "has_basis"), table).filter(
        (F.col("row") > F.col("header_row"))
        & ~(F.col("has_basis") & (F.col("row") == F.col("header_row") + 1))
    )
    named = columns.filter(F.col("role").isNotNull() & (F.col("role") != "value_raw"))
    bound = body.join(named.select(*table, "col", "role"), [*table, "col"])
    fields = bound.groupBy(*table, "row").agg(
        *[F.max(F.when(F.col("role") == f, F.col("text"))).alias(f) for f in FIELDS],
        F.max(F.struct(F.lit(1), F.col("source_id"))).alias("__any"),
        # Bounded by the vocabulary: one cell per role.
        F.collect_set("source_id").alias("__bound_ids"),
        F.bool_or(F.coalesce(F.col("quality") == "conflicted", F.lit(False)) | F.col("winner").isNull()).alias("__bound_conflict"),
        F.bool_or(F.coalesce(F.col("quality").isin("unreadable", "unlocated"), F.lit(False))).alias("__bound_unreadable"),
    ).drop("__any")
    value_cols = columns.filter("is_value").select(
        *table, "col", "header_id", "header_text", "is_year", "is_metric", "basis_text", "basis_id"
    )
    rows = body.select(*table, "row").distinct()
    wanted = rows.join(value_cols, table)
    cells = body.select(
        *table,
        "row",
        "col",
        F.col("source_id").alias("value_id"),
        F.col("text").alias("value_raw"),
        F.col("quality").alias("value_quality"),
        F.col("winner").alias("value_winner"),
    )
    joined = wanted.join(cells, [*table, "row", "col"], "left").join(fields, [*table, "row"], "left")
    joined = joined.withColumns(
        {
            "reporting_period": F.when(F.col("is_year"), F.col("header_text")).otherwise(
                F.col("reporting_period")
            ),
            "metric_raw": F.when(F.col("is_metric"), F.col("header_text")).otherwise(
                F.col("metric_raw")
            ),
            "scope2_basis": F.coalesce("basis_text", "scope2_basis"),
        }
    )
    blank_to_null = {f: F.nullif(strip(F.col(f)), F.lit("")) for f in FIELDS}
    joined = joined.withColumns(blank_to_null)
    if notes is not None:
        targets = F.array_compact(
            F.concat(
                F.array("value_id", "header_id", "basis_id", F.lit("__table")),
                F.coalesce("__bound_ids", F.array().cast("array<string>")),
            )
        )
        attached = (
            joined.select(*table, "row", "col", F.explode(F.array_distinct(targets)).alias("target_id"))
            .join(notes, [*table, "target_id"])
            .dropDuplicates([*table, "row", "col", "note_id"])
        )
        is_unit = strip(F.col("text")).rlike(r"^(?i:단위|unit)\s*:")
        is_scope = strip(F.col("text")).rlike(r"^Scope(?:\s|:)")
        unit, scope = unit_note(F.col("text")), scope_note(F.col("text"))
        per_cell = attached.groupBy(*table, "row", "col").agg(
            F.min(F.when(is_unit, unit)).alias("__u_lo"),
            F.max(F.when(is_unit, unit)).alias("__u_hi"),
            F.min(F.when(is_scope, scope)).alias("__s_lo"),
            F.max(F.when(is_scope, scope)).alias("__s_hi"),
            F.bool_or((is_unit & unit.isNull()) | (is_scope & scope.isNull())).alias("__open_note"),
        )
        joined = joined.join(per_cell, [*table, "row", "col"], "left")
    else:
        null = F.lit(None).cast("string")
        joined = joined.withColumns(
            {"__u_lo": null, "__u_hi": null, "__s_lo": null, "__s_hi": null, "__open_note": F.lit(False)}
        )
    no = F.lit(False)
    clash = lambda lo, hi, own: F.coalesce(F.col(lo) != F.col(hi), no) | F.coalesce(F.col(lo) != F.col(own), no)
    unit_conflict, scope_conflict = clash("__u_lo", "__u_hi", "unit_raw"), clash("__s_lo", "__s_hi", "scope")
    header_unit = F.coalesce("unit_raw", F.when(~unit_conflict, F.col("__u_lo")))
    joined = joined.withColumns(
        {
            "scope": F.coalesce("scope", F.when(~scope_conflict, F.col("__s_lo"))),
            "unit_raw": F.coalesce(header_unit, in_cell_unit(F.col("value_raw"))),
            "__parsed": normalize_value(F.col("value_raw"), header_unit),
            "__conflict": unit_conflict
            | scope_conflict
            | F.coalesce("__bound_conflict", no)
            | (F.col("value_quality") == "conflicted")
            | F.col("value_winner").isNull(),
            "__unreadable": F.coalesce("__bound_unreadable", no)
            | F.col("value_quality").isin("unreadable", "unlocated"),
        }
    )
    incomplete = (
        F.coalesce("__open_note", no)
        | (F.col("__parsed.state") == "unreadable")
        | F.col("metric_raw").isNull()
        | F.col("reporting_period").isNull()
    )
    state = (
        F.when(F.col("value_id").isNull(), F.lit("cell_missing"))
        .when(F.col("__conflict"), F.lit("conflict"))
        .when(F.col("__unreadable") | incomplete, F.lit("unreadable"))
        .otherwise(F.col("__parsed.state"))
    )
    out = joined.withColumn("value_state", state)
    identity = {k: F.col(k) for k in [*table, "row", "col", "value_id", "value_raw"]}
    return out.select(
        canonical_hash(**identity).alias("observation_id"),
        *table,
        "row",
        "col",
        "value_id",
        *FIELDS,
        F.col("__parsed.unit").alias("unit_canonical"),
        F.col("__parsed.multiplier").alias("scale_multiplier"),
        "value_raw",
        F.when(F.col("value_state") == "value", F.col("__parsed.value")).alias("value_decimal"),
        "value_state",
    )


ROLE_KEYS = ("metric_raw", "reporting_period", "value_raw")


def bind_roles(
    assignments: DataFrame, cells: DataFrame, table: Sequence[str] = TABLE
) -> DataFrame:
    """Explicit role assignments with the first reason one is not admissible.

    `assignments` are (table, binding_id, role, source_id). A role cell must lie
    in the value's row, or be the year above the value's column without an
    unread text tier in between.
    """
    table = list(table)
    coords = cells.select(
        *table,
        "source_id",
        "text",
        F.col("row_number").alias("r"),
        F.col("column_number").alias("c"),
        F.coalesce("row_span", F.lit(1)).alias("rs"),
        F.coalesce("column_span", F.lit(1)).alias("cs"),
    )
    placed = assignments.join(coords, [*table, "source_id"], "left")
    value = placed.filter(F.col("role") == "value_raw").select(
        *table,
        "binding_id",
        F.col("source_id").alias("value_id"),
        F.col("r").alias("vr"),
        F.col("c").alias("vc"),
        F.col("rs").alias("vrs"),
        F.col("cs").alias("vcs"),
    )
    same = placed.join(value, [*table, "binding_id"], "left")
    in_row = (F.col("r") <= F.col("vr")) & (F.col("vr") + F.col("vrs") <= F.col("r") + F.col("rs"))
    year_above = (
        (F.col("role") == "reporting_period")
        & (F.col("r") + F.col("rs") <= F.col("vr"))
        & (F.col("c") <= F.col("vc"))
        & (F.col("vc") + F.col("vcs") <= F.col("c") + F.col("cs"))
    )
    # Text tiers between a year header and its value, met on the covered column.
    tiers = (
        coords.withColumn("__col", F.explode(F.sequence("c", F.col("c") + F.col("cs") - 1)))
        .filter(~normalize_value(F.col("text"), F.lit(None).cast("string"))["state"].isin("value", "missing"))
        .select(*table, "__col", F.col("r").alias("tier_row"))
    )
    above = (
        same.filter(year_above & ~in_row)
        .withColumn("__col", F.explode(F.sequence("vc", F.col("vc") + F.col("vcs") - 1)))
        .join(tiers, [*table, "__col"])
        .filter((F.col("r") + F.col("rs") <= F.col("tier_row")) & (F.col("tier_row") < F.col("vr")))
        .select(*table, "binding_id", "role")
        .distinct()
        .withColumn("__tier", F.lit(True))
    )
    checked = same.join(above, [*table, "binding_id", "role"], "left")
    counted = assignments.groupBy(*table, "binding_id").agg(
        F.count_if(F.col("role").isin(*ROLE_KEYS)).alias("__required")
    )
    reused = (
        assignments.filter(F.col("role") == "value_raw")
        .groupBy(*table, "source_id")
        .agg(F.count("*").alias("n"))
        .filter("n > 1")
        .select(*table, F.col("source_id").alias("value_id"), F.lit(True).alias("__reused"))
    )
    full = checked.join(counted, [*table, "binding_id"]).join(reused, [*table, "value_id"], "left")
    reason = F.coalesce(
        F.when(~F.col("role").isin(*HEADERS), F.lit("role_unknown")),
        F.when(F.col("__required") < len(ROLE_KEYS), F.lit("required_role_missing")),
        F.when(F.col("r").isNull(), F.lit("cell_unknown")),
        F.when(F.coalesce("__reused", F.lit(False)), F.lit("duplicate_value_binding")),
        F.when(F.coalesce("__tier", F.lit(False)), F.lit("year_header_omits_table_level")),
        F.when(~F.coalesce(in_row | year_above, F.lit(False)), F.lit("binding_crosses_row_or_column")),
    )
    return full.withColumn("reason", reason).select(*assignments.columns, "text", "reason")


STATEMENT_PERIODS = {"thstrm": "current", "frmtrm": "previous", "bfefrmtrm": "before_previous"}


def unpivot_statement(rows: DataFrame, ids: Sequence[str]) -> DataFrame:
    """Three amount columns of a statement row -> one row per period."""
    amounts = [f"{p}_amount" for p in STATEMENT_PERIODS]
    long = rows.select(*ids, *amounts).unpivot(list(ids), amounts, "column", "amount_raw")
    names = F.create_map(
        *[F.lit(x) for p, n in STATEMENT_PERIODS.items() for x in (f"{p}_amount", n)]
    )
    return long.withColumn("period", names[F.col("column")]).drop("column")


def wide_to_long(
    df: DataFrame, ids: Sequence[str], columns: Sequence[str], name: str, value: str
) -> DataFrame:
    return df.unpivot(list(ids), list(columns), name, value)


def numeric_literal(text: Column) -> Column:
    """Bare numeric literal -> struct<value, reason>; every other text keeps no value."""
    parsed = normalize_value(text, F.lit(None).cast("string"))
    plain = (parsed["state"] == "value") & parsed["unit"].isNull()
    reason = (
        F.when(text.isNull(), F.lit("value_not_text"))
        .when(F.upper(strip(text)).isin("", "-", "N/A"), F.lit("value_missing_not_zero"))
        .when(F.contains(text, F.lit("%")), F.lit("percent_sign_preserved_no_unit_inferred"))
        .when(text.rlike("[A-Za-z가-힣]"), F.lit("value_combined_or_prose_preserved"))
        .when(plain, F.lit("plain_numeric_literal"))
        .otherwise(F.lit("value_not_plain_numeric_preserved"))
    )
    return F.struct(
        F.when(reason == "plain_numeric_literal", parsed["value"]).alias("value"),
        reason.alias("reason"),
    )


def period_qualifier(text: Column) -> Column:
    """Year header -> struct<year, qualifier, footnote>; a bare year is never an achievement."""
    literal = strip(text)
    footnote = F.nullif(F.regexp_extract(literal, r"\s([1-9][0-9]?\))$", 1), F.lit(""))
    core = F.when(footnote.isNotNull(), F.regexp_replace(literal, r"\s+[1-9][0-9]?\)$", "")).otherwise(
        literal
    )
    shape = r"^((?:19|20|21)[0-9]{2})년?(?:\s*\((목표|실적)\))?$"
    year = F.nullif(F.regexp_extract(core, shape, 1), F.lit(""))
    word = F.regexp_extract(core, shape, 2)
    qualifier = (
        F.when(year.isNull(), F.lit("non_year_prose"))
        .when(word == "목표", F.lit("target"))
        .when(word == "실적", F.lit("actual"))
        .otherwise(F.lit("unqualified_bare_year"))
    )
    return F.struct(
        year.alias("year"),
        qualifier.alias("qualifier"),
        F.when(year.isNotNull(), footnote).alias("footnote"),
    )


def table_candidates(cells: DataFrame, axes: DataFrame, table: Sequence[str] = TABLE) -> DataFrame:
    """Every cell as value candidate with its one row metric and one year column.

    A metric or year that is not unique stays null. `axes` come from the cover
    relation of the same cells (see `layout.table_axes`).
    """
    table = list(table)
    texts = cells.select(
        *table,
        F.col("source_id").alias("axis_id"),
        F.col("text").alias("axis_text"),
        period_qualifier(F.col("text")).alias("p"),
    )
    labelled = axes.join(texts, [*table, "axis_id"])
    is_year = (F.col("role") == "column_header") & F.col("p.year").isNotNull()
    is_metric = F.col("role") == "row_header"
    per_value = labelled.groupBy(*table, "source_id").agg(
        F.max(F.when(is_metric, F.col("axis_text"))).alias("metric_raw"),
        F.count_if(is_metric).alias("n_metric"),
        F.max(F.when(is_year, F.col("p"))).alias("p"),
        F.count_if(is_year).alias("n_year"),
    )
    parsed = numeric_literal(F.col("text"))
    return (
        cells.withColumn("__v", parsed)
        .join(per_value, [*table, "source_id"])
        .select(
            *table,
            "source_id",
            F.col("text").alias("value_raw"),
            F.col("__v.value").alias("value_decimal"),
            F.col("__v.reason").alias("reason"),
            F.when(F.col("n_metric") == 1, F.col("metric_raw")).alias("metric_raw"),
            F.when(F.col("n_year") == 1, F.col("p.year")).alias("year"),
            F.when(F.col("n_year") == 1, F.col("p.qualifier")).alias("year_qualifier"),
        )
    )
