"""Operators on small fixtures, against brute force where order or geometry matters."""

import itertools
import random

from pyspark.sql import functions as F

from claimgrove.operators import (
    assurance,
    attribution,
    claims,
    fusion,
    grading,
    layout,
    lineage,
    numeric,
    ordered,
    search,
    tables,
)
from claimgrove.operators.rulebook import ELEMENTS
from claimgrove.sources.filings import filing_text_nodes


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_bucketed_scans_equal_plain_windows(spark):
    rnd = random.Random(7)
    data = [(k, i, rnd.choice([None, i * 3 % 17])) for k in "ab" for i in range(60)]
    df = spark.createDataFrame(data, "k string, i int, v int")
    bucket = F.floor(F.col("i") / 7)
    for fn in (
        lambda b: ordered.neighbours(df, ["k"], ["i"], {"p": F.col("v")}, {"n": F.col("v")}, b),
        lambda b: ordered.last_before(df, ["k"], ["i"], {"l": F.col("v")}, b),
        lambda b: ordered.running(df, ["k"], ["i"], {"s": F.coalesce("v", F.lit(0))}, {"m": F.col("v")}, b),
    ):
        assert rows(fn(bucket), "k", "i") == rows(fn(None), "k", "i")


def test_budgeted_pick_skips_and_goes_on(spark):
    rnd = random.Random(3)
    data = [("g", i, rnd.choice([5, 40, 1700, 900, 1600, 3000])) for i in range(200)]
    want, used = [], 0
    for _, i, s in data:
        if s <= 1600 and used + s <= 12000 and len(want) < 12:
            want.append(i)
            used += s
    df = spark.createDataFrame(data, "g string, i int, s int").repartition(8)
    got = search.budgeted_pick(df, ["g"], ["i"], "i", "s").first()
    assert (got["picked"], got["used"], got["n_omitted"]) == (want, used, 200 - len(want))


def test_pack_equals_sequential_fold(spark):
    rnd = random.Random(5)
    sizes = [rnd.choice([1, 3, 5, 9, 12, 40]) for _ in range(300)]
    packet, n, used, want = 0, 0, 0, []
    for s in sizes:
        if n and (n == 4 or used + s > 20):
            packet, n, used = packet + 1, 0, 0
        if s > 20:
            want.append(None)
            continue
        want.append(packet)
        n, used = n + 1, used + s
    df = spark.createDataFrame([("g", i, s) for i, s in enumerate(sizes)], "g string, i int, s int")
    out = search.pack(df.repartition(5), ["g"], ["i"], "i", "s", 4, 20, F.floor(F.col("i") / 50), chunk=16)
    got = [r["packet"] for r in out.orderBy("i").collect()]
    # Packets are numbered without holes.
    order = {p: k for k, p in enumerate(sorted({p for p in want if p is not None}))}
    assert got == [None if p is None else order[p] for p in want]


def test_bm25_tie_and_zero_scores(spark):
    blocks = spark.createDataFrame(
        [("d", "b", "energy use"), ("d", "a", "energy use"), ("d", "c", "water"), ("e", "z", "energy")],
        "doc string, source_id string, text string",
    )
    queries = spark.createDataFrame([("d", "q", "Energy energy")], "doc string, query_id string, text string")
    got = search.bm25(queries, blocks, scope=["doc"]).orderBy("rank").collect()
    assert [(r["source_id"], r["rank"]) for r in got] == [("a", 1), ("b", 2)]


def test_rrf_counts_ranks_after_duplicates(spark):
    hits = spark.createDataFrame(
        [("q", "lexical", "x", 1), ("q", "lexical", "x", 2), ("q", "lexical", "y", 3), ("q", "index", "y", 1)],
        "query_id string, route string, source_id string, position long",
    )
    got = dict(rows(search.rrf(hits, ["index", "lexical"]).select("source_id", "rrf"), "source_id"))
    assert abs(got["y"] - (1 / 61 + 1 / 62)) < 1e-12 and abs(got["x"] - 1 / 61) < 1e-12


def test_literal_hits_short_and_long_quotes(spark):
    texts = spark.createDataFrame(
        [(1, "the quick brown fox jumps over"), (2, "quick, brown"), (3, "xx 12% yy")], "t int, text string"
    )
    quotes = ["quick brown fox jumps", "ick, bro", "12%", "%", "absent words in here", "brown"]
    needles = spark.createDataFrame(list(enumerate(quotes)), "n int, quote string")
    got = set(rows(claims.literal_hits(needles, texts, [], "n", "t").select("n", "t"), "n", "t"))
    want = {(n, r["t"]) for n, q in enumerate(quotes) for r in texts.collect() if q in r["text"]}
    assert got == want


def test_extraction_span_rules(spark):
    source = "배출량 12.5% 감축, “계획 수립"
    spans = [
        (0, 3, "claim"), (4, 6, "claim"), (4, 9, "claim"), (14, 16, "claim"), (2, 5, "excluded"),
    ]
    df = spark.createDataFrame(
        [("s", a, b, source[a:b], k, None if k == "claim" else "r", ["t"]) for a, b, k in spans],
        "source_id string, char_start int, char_end int, quote string, kind string, reason string, topic_ids array<string>",
    )
    texts = spark.createDataFrame([("s", source)], "source_id string, text string")
    got = {(r["char_start"], r["char_end"]): r["violations"] for r in claims.validate_spans(df, texts).collect()}
    assert got[(0, 3)] == []
    assert "cuts_token" in got[(4, 6)]
    assert "overlap" in got[(2, 5)]
    assert "unclosed_quotation" in got[(14, 16)]


def test_group_lines_uses_first_word_of_line(spark):
    ys = [10.0, 11.5, 12.4, 13.0, 15.0, 40.0]
    df = spark.createDataFrame([("d", i, y, float(i)) for i, y in enumerate(ys)], "p string, word_id int, y0 double, x0 double")
    got = [r["line_no"] for r in layout.group_lines(df, ["p"]).orderBy("word_id").collect()]
    assert got == [1, 1, 1, 2, 2, 3]


def test_word_runs_cut_at_wide_gaps(spark):
    words = [("p", 0, "a", 0.0, 0.0, 5.0, 10.0), ("p", 1, "b", 8.0, 1.0, 12.0, 11.0), ("p", 2, "c", 40.0, 0.0, 44.0, 10.0)]
    df = spark.createDataFrame(words, "p string, word_id int, text string, x0 double, y0 double, x1 double, y1 double")
    assert [r["text"] for r in layout.word_runs(df, ["p"]).orderBy("x0").collect()] == ["a b", "c"]


def test_iou_pairs_equal_brute_force(spark):
    rnd = random.Random(11)
    boxes = []
    for i in range(150):
        x, y = rnd.randint(0, 12), rnd.randint(0, 12)
        boxes.append((i, float(x), float(y), float(x + rnd.randint(8, 11)), float(y + rnd.randint(8, 11))))
    df = spark.createDataFrame(boxes, "candidate_id int, x0 double, y0 double, x1 double, y1 double").select(
        F.lit("p").alias("p"), "candidate_id", F.struct("x0", "y0", "x1", "y1").alias("bbox")
    )
    distinct = {}
    for i, *b in boxes:
        distinct.setdefault(tuple(b), []).append(i)

    def iou(a, b):
        w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
        inter = max(0, w) * max(0, h)
        return inter / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - inter)

    want = {
        tuple(sorted((min(distinct[a]), min(distinct[b]))))
        for a, b in itertools.combinations(distinct, 2)
        if iou(a, b) >= 0.8
    }
    got = {(r["left_id"], r["right_id"]) for r in layout.iou_pairs(df, ["p"]).collect()}
    assert got == want


def test_fusion_conflict_and_unlocated(spark):
    box = lambda x: {"x0": x, "y0": 0.0, "x1": x + 10, "y1": 10.0}
    data = [
        ("t", "v", 1, "paragraph", "p1", "r1", "n1", "f1", "same", box(0.0), None, []),
        ("t", "v", 1, "paragraph", "p2", "r2", "m1", "f2", "same", box(0.2), None, []),
        ("t", "v", 1, "paragraph", "p1", "r1", "n2", "f1", "left", box(50.0), None, []),
        ("t", "v", 1, "paragraph", "p2", "r2", "m2", "f2", "right", box(50.1), None, []),
        ("t", "v", 1, "paragraph", "p1", "r1", "n3", "f1", "lost", None, None, []),
    ]
    schema = (
        "tenant_id string, document_version_id string, page_num int, kind string, parser_name string, parser_run_id string, "
        "source_native_id string, parser_family string, raw_text string, bbox struct<x0:double,y0:double,x1:double,y1:double>, "
        "table_native_id string, context array<string>"
    )
    edges = spark.createDataFrame(
        [("t", "v", "r1", "n1", "n2", "section_parent"), ("t", "v", "r1", "n1", "gone", "section_parent")],
        "tenant_id string, document_version_id string, parser_run_id string, source_native_id string, target_native_id string, relation string",
    )
    blocks, mapped, issues = fusion.fuse(spark.createDataFrame(data, schema), edges)
    assert sorted((r["quality"], len(r["members"]), r["winner"]) for r in blocks.collect()) == [
        ("conflicted", 2, None), ("unlocated", 1, 0), ("unverified", 2, 0),
    ]
    assert mapped.count() == 1
    assert sorted(r["kind"] for r in issues.collect()) == ["dangling_edge", "parse_conflict", "source_unlocated"]


def test_note_holds(spark):
    blocks = spark.createDataFrame(
        [("t", "v", s, k, p) for s, k, p in [("T", "table", 1), ("c", "table_cell", 1), ("n1", "footnote", 1), ("n2", "footnote", 1), ("n3", "footnote", 2)]],
        "tenant_id string, document_version_id string, source_id string, kind string, page_num int",
    )
    edges = spark.createDataFrame(
        [("t", "v", "c", "T", "table_parent"), ("t", "v", "n1", "c", "footnote_of")],
        "tenant_id string, document_version_id string, source_id string, target_id string, relation string",
    )
    closure = lineage.ancestors_within(edges)
    got = {(r["source_id"], r["note_id"]) for r in lineage.note_holds(blocks, edges, closure).collect()}
    assert got == {("n2", "n2"), ("n3", "n3"), ("T", "n2"), ("c", "n2")}
    cyclic = spark.createDataFrame(
        [("t", "v", "a", "b", "table_parent"), ("t", "v", "b", "a", "table_parent")],
        "tenant_id string, document_version_id string, source_id string, target_id string, relation string",
    )
    assert lineage.ancestors(cyclic).filter("is_cycle").count() == 2


def _claims(spark, facts, **extra):
    base = {"superlative_quote": None, "superlative_cited": None, "safe_harbor_category": None, "product_variant": False}
    base |= extra
    data = [("c", base.pop("track", "goal"), facts, *base.values())]
    return spark.createDataFrame(
        data,
        "claim_id string, track string, facts map<string,string>, superlative_quote string, superlative_cited boolean, "
        "safe_harbor_category string, product_variant boolean",
    )


def test_grade_exceptions_and_gaps(spark):
    present = {n: "present" for ns in ELEMENTS["goal"].values() for n in ns}
    full = present | {"offset_or_carbon_neutral_claim": "absent", "science_based_claim": "absent"}
    decide = lambda facts, **kw: grading.grade(grading.exceptions(_claims(spark, facts, **kw))).first()
    got = decide(full)
    assert (got["decision_status"], got["evidence_grade"], got["review_status"]) == ("decided", "E3", "auto_confirmed")
    got = decide(full | {"transition_plan": "unknown"})
    assert (got["decision_status"], got["grade_floor"], got["grade_ceiling"]) == ("blocked_evidence", "E2", "E3")
    sup = {"has_superlative": "present", "comparison_basis": "absent", "external_verification": "absent"}
    got = decide(full | sup, superlative_quote="best", superlative_cited=True)
    assert (got["evidence_grade"], got["rule_ids"][-1]) == ("E0", "SUPERLATIVE_E0")
    got = decide(full, safe_harbor_category="forward_looking")
    assert (got["decision_status"], got["gap_ids"]) == ("blocked_rule_gap", ["GAP-001"])
    got = decide({"named_means_or_concrete_state": "present", "org_boundary": "present", "external_verification": "present",
                  "willingness_only": "absent", "direct_product_material_ratio_or_target": "absent"}, track="management", product_variant=True)
    assert (got["evidence_grade"], got["decision_status"]) == ("E1", "decided")


def test_rescore_needs_every_fact(spark):
    definitions = lambda m: spark.createDataFrame([("G1", m, ["local_claim"])], "element_id string, meaning string, source_scopes array<string>")
    none = grading.definition_changes(definitions("a"), definitions("a"))
    row = _claims(spark, {"target_year": "present"})
    got = grading.rescore(grading.exceptions(row), none).first()
    assert got["outcome"] == "RETAG_REQUIRED" and "MISSING_FACT:scope" in got["reasons"]
    changed = grading.definition_changes(definitions("a"), definitions("b"))
    got = grading.rescore(grading.exceptions(row), changed).first()
    assert got["reasons"] == ["ELEMENT_MEANING_CHANGED:G1"]


def test_shared_footnote_growth_case(spark):
    dims = dict(metric_raw="m", scope=None, subject="s", scope2_basis=None, organizational_boundary=None, denominator=None)
    obs = [
        ("t", "v", o, "m", None, "s", None, None, None, "t", y, v, "value", o, False, notes)
        for (o, y, v), notes in itertools.product([("a", "2023", "598,846"), ("b", "2024", "644,685")], [False])
    ]
    schema = (
        "tenant_id string, document_version_id string, observation_id string, metric_raw string, scope string, subject string, "
        "scope2_basis string, organizational_boundary string, denominator string, unit_canonical string, reporting_period string, "
        "value_raw string, value_state string, value_source_id string, issue_open boolean, notes_open boolean"
    )
    o = spark.createDataFrame(obs, schema)
    b = spark.createDataFrame(
        [("t", "v", "c", "growth", ["a", "b"], "8", *dims.values(), "t", "2024", "2023", "absolute", True, False, False, None)],
        "tenant_id string, document_version_id string, claim_id string, kind string, observation_ids array<string>, reported_value string, "
        "metric_raw string, scope string, subject string, scope2_basis string, organizational_boundary string, denominator string, unit string, "
        "reporting_period string, baseline_period string, quantity_kind string, claim_verified boolean, product_accepted boolean, "
        "aggregation_accepted boolean, baseline_subject string",
    )
    got = numeric.check_numeric(b, o).first()
    assert (got["status"], got["reason"]) == ("consistent", "non_terminating_decimal")
    held = numeric.check_numeric(b, o.withColumn("notes_open", F.lit(True))).first()
    assert (held["status"], held["reason"]) == ("not_computable", "footnote_conditions_unresolved")


def test_unit_footnote_and_merged_title(spark):
    cells = [("T", "t", 0, 0, 1, 3, "Emissions"), ("T", "h0", 1, 0, 1, 1, "지표"), ("T", "h1", 1, 1, 1, 1, "2025"), ("T", "h2", 1, 2, 1, 1, "2024"),
             ("T", "m", 2, 0, 1, 1, "배출량"), ("T", "v1", 2, 1, 1, 1, "1,200"), ("T", "v2", 2, 2, 1, 1, "N/A")]
    df = spark.createDataFrame(cells, "table_id string, source_id string, row_number int, column_number int, row_span int, column_span int, text string").withColumns(
        {"quality": F.lit("verified"), "winner": F.lit(0)}
    )
    notes = spark.createDataFrame([("T", "__table", "n", "단위: 천 tCO2e")], "table_id string, target_id string, note_id string, text string")
    grid, _ = tables.expand_grid(df, ["table_id"])
    columns, shape, issues = tables.detect_headers(grid, ["table_id"])
    got = {r["reporting_period"]: r for r in tables.unpivot_table(grid, columns, shape, notes, ["table_id"]).collect()}
    assert issues.count() == 0
    assert (got["2025"]["value_decimal"], got["2025"]["unit_canonical"], got["2025"]["metric_raw"]) == ("1200000", "tCO2e", "배출량")
    assert (got["2024"]["value_decimal"], got["2024"]["value_state"]) == (None, "missing")


def test_filing_nodes(spark):
    good = "<table><tr><th rowspan=2>A</th><th>B</th></tr><tr><td>1<br>2</td></tr></table>"
    df = spark.createDataFrame([(1, good)], "id int, html string")
    nodes = filing_text_nodes(df.filter("id = 1"), ["id"]).orderBy("position").collect()
    assert [(n["text"], n["row_group"], n["element_path"]) for n in nodes][:2] == [("A", 1, "/table[1]/tr[1]/th[1]"), ("B", 1, "/table[1]/tr[1]/th[2]")]
    assert nodes[2]["row_group"] == 1


def test_filing_row_span_is_taken_as_declared(spark):
    rows = "".join(f"<tr><td>r{i}</td></tr>" for i in range(2, 602))
    page = f"<table><tr><th rowspan=600>A</th></tr>{rows}</table>"
    df = spark.createDataFrame([(1, page)], "id int, html string")
    groups = [n["row_group"] for n in filing_text_nodes(df, ["id"]).orderBy("position").collect()]
    assert groups == [1] * 600 + [2]


def test_assurance_fields(spark):
    refs = spark.createDataFrame(
        [("t", "v", "s", "r1", "provider", "b", 0, 4, "KPMG", True), ("t", "v", "s", "r2", "level", "b", 5, 12, "limited", True),
         ("t", "v", "s", "r3", "provider", "b", 0, 4, "EY", True), ("t", "v", "s", "r4", "covered_metrics", "b", 90, 95, "CO2", True)],
        "tenant_id string, document_version_id string, statement_id string, ref_id string, field string, source_id string, char_start int, char_end int, quote string, verified boolean",
    )
    span = spark.createDataFrame([("t", "v", "s", "b", 0, 50)], "tenant_id string, document_version_id string, statement_id string, source_id string, char_start int, char_end int")
    got = assurance.assurance_fields(refs, span).first()
    assert (got["provider"], got["level"], got["unresolved_fields"]) == (None, "limited", ["covered_metrics", "provider"])


def test_competing_conditions_are_order_free(spark):
    own = spark.createDataFrame([("o1", "accepted"), ("o2", "accepted")], "ownership_id string, state string")
    targets = spark.createDataFrame([("o1", "x"), ("o2", "x")], "ownership_id string, source_id string")
    conditions = spark.createDataFrame(
        [("c1", "f1", "o1", "unit_literal", "tagged", "단위: 톤", True), ("c2", "f2", "o2", "unit_literal", "tagged", "단위: kg", True)],
        "condition_id string, fragment_id string, ownership_id string, kind string, state string, text string, literal_verified boolean",
    )
    assert {r["state"] for r in attribution.assess_conditions(conditions, own, targets).collect()} == {"conflict"}
    one = attribution.assess_conditions(conditions.filter("condition_id = 'c1'"), own, targets).first()
    assert (one["state"], one["value"]) == ("accepted", "톤")
