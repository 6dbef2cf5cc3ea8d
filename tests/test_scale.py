"""Steps whose time or memory once grew beyond the limits: their plans, and results on awkward rows."""

from pyspark.sql import functions as F

from claimgrove.functions import text
from claimgrove.operators import claims, grading, layout, search


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_patterns_are_not_compiled_per_row(spark):
    """a pattern given to split is compiled for every row; only texts with the mark may need it."""
    source = "약 3 MWh\x01 and 5-6 톤, Scope 1"
    df = spark.createDataFrame([(source,), (source.replace("\x01", ""),)], "s string")
    metric = plan(df.select(text.split_metric(F.col("s"))))
    # Once for the values, once for the units, and each again for texts with the mark.
    assert metric.count("Wh|TJ|%)(?![A-Za-z0-9]") < 40, metric.count("Wh|TJ|%)(?![A-Za-z0-9]")
    for row in df.select("s", text.quantity_spans(F.col("s")).alias("q"), text.quantity_quotes(F.col("s")).alias("k")).collect():
        assert all(row["s"][x["start"] : x["end"]] == x["quote"] for x in row["q"])
        assert [x["quote"] for x in row["q"]] == ["Scope 1", "약 3 MWh", "MWh", "톤"]
        assert row["k"].asDict() == {"value": ["약 3 MWh"], "unit": ["MWh", "톤"], "scope": ["Scope 1"]}


def test_page_list_reads_each_part_once(spark):
    """the list ends of one part were extracted anew at every mention."""
    rows = ["Energy GRI 305-1 p. 3 – 5; 9/12", "GRI 305-1", "x 305-1 7-2, 4쪽", "no code 5", None]
    df = spark.createDataFrame([(r,) for r in rows], "s string")
    pages = df.select(text.page_list(F.col("s")).alias("p"))
    assert plan(pages).count(r"\s*[-–—]\s*(\d+)$") <= 2
    assert [r["p"] for r in pages.collect()] == [["3", "4", "5", "9", "12"], [], ["7-2", "4"], [], []]


def test_offsets_move_as_one_struct(spark):
    """a map of all places went back to Spark for every row."""
    df = spark.createDataFrame([("éx", 0, 1), ("éx", 1, 2), ("éx", 0, 3), (None, 0, 1)], "s string, a int, b int")
    moved = df.select(text.nfc_to_raw(F.col("s"), F.col("a"), F.col("b")).alias("m"))
    assert "map<" not in str(text._raw_span.returnType.simpleString())
    assert [tuple(r["m"]) for r in moved.collect()] == [(0, 2), (2, 3), (None, None), (None, None)]


def test_iou_probes_are_never_broadcast(spark):
    """the exploded probes were broadcast by the size of the boxes, through the driver."""
    boxes = spark.range(400).select(
        F.col("id").alias("candidate_id"),
        F.lit(1).alias("p"),
        F.struct(*[(F.col("id") % k + x).cast("double").alias(n) for n, k, x in (("x0", 7, 0), ("y0", 5, 0), ("x1", 3, 30), ("y1", 2, 20))]).alias("bbox"),
    )
    joined = layout.iou_pairs(boxes, ["p"])
    physical = joined._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastExchange" not in physical and "SortMergeJoin" in physical
    seen = {tuple(r["bbox"]): 0 for r in boxes.collect()}
    side = lambda a, b, k: min(a[k + 2], b[k + 2]) - max(a[k], b[k])
    area = lambda a: (a[2] - a[0]) * (a[3] - a[1])
    both = [(a, b, side(a, b, 0) * side(a, b, 1)) for a in seen for b in seen if a < b and side(a, b, 0) > 0 and side(a, b, 1) > 0]
    assert joined.count() == sum(1 for a, b, i in both if i / (area(a) + area(b) - i) >= 0.8)


def test_bm25_tasks_follow_the_meetings(spark, monkeypatch):
    """tasks were sized by postings, however many queries each of them meets."""
    words = "alpha beta gamma delta epsilon".split()
    blocks = spark.createDataFrame([(i, " ".join(words[: 1 + i % 5])) for i in range(40)], "source_id long, text string")
    queries = spark.createDataFrame([(i, " ".join(words[i % 3 :])) for i in range(30)], "query_id long, text string")
    cut = lambda n: monkeypatch.setattr(search, "MEETING", n, raising=False)
    cut(1_000_000)
    whole = {(r["query_id"], r["source_id"], r["units"]) for r in search.bm25_scores(queries, blocks).collect()}
    cut(50)
    split = search.bm25_scores(queries, blocks)
    assert {(r["query_id"], r["source_id"], r["units"]) for r in split.collect()} == whole
    assert split.rdd.getNumPartitions() > 20


def test_facts_fold_without_sorting_texts(spark):
    """minima and maxima of state texts were sorted, row by row."""
    states = ["present", "absent", "unknown", "conflict", None]
    names = ["target_year", "scope", "has_superlative", "no such fact"]
    rows = [(i % 17, names[i % 4], states[(i * i) % (1 + i % 5)]) for i in range(400)] + [(99, "scope", None)]
    facts = spark.createDataFrame(rows, "claim_id long, name string, state string")
    expected = {}
    for claim, name, state in rows:
        if name in names[:3]:
            expected.setdefault(claim, {}).setdefault(name, set()).add(state)
    fold = lambda s: next(iter(s - {None})) if len(s - {None}) == 1 else "conflict"
    expected = {c: {n: fold(s) for n, s in f.items()} for c, f in expected.items()}
    got = grading.fact_map(facts)
    assert "SortAggregate" not in got._jdf.queryExecution().executedPlan().toString()
    assert {r["claim_id"]: r["facts"] for r in got.collect()} == expected
    other = facts.unionByName(spark.createDataFrame([(1, "scope", "odd"), (77, "scope", "odd")], facts.schema))
    found = {r["claim_id"]: r["facts"] for r in grading.fact_map(other).collect()}
    assert found == {**expected, 77: {"scope": "odd"}, 1: {**expected[1], "scope": "conflict"}}


def test_spans_fold_before_a_semi_join(spark):
    """every span of a source was compared with every reference near it."""
    spans = [(i % 3, (i * 37) % 3000, (i * 37) % 3000 + (i * i) % 1500 - 2) for i in range(900)] * 3 + [(1, None, 5), (None, 1, 9)]
    refs = [(i, i % 4, (i * 53) % 3100, (i * 53) % 3100 + i % 900) for i in range(1500)] + [(-1, 0, None, 4), (-2, None, 2, 3)]
    outer = spark.createDataFrame(spans, "source_id int, outer_start int, outer_end int")
    inner = spark.createDataFrame(refs, "ref_id int, source_id int, char_start int, char_end int")
    got = [r["ref_id"] for r in claims.contained_in(inner, outer, ["source_id"], "left_semi").collect()]
    inside = lambda s, a, b: any(o == s and None not in (x, y) and x <= a and b <= y for o, x, y in spans)
    expected = [i for i, s, a, b in refs if None not in (s, a, b) and a < b and inside(s, a, b)]
    assert sorted(got) == sorted(expected) and 0 < len(expected) < len(refs)
    folded = claims._farthest_ends(outer, ["source_id"], 1024)
    assert folded.groupBy("source_id", F.floor(F.col("outer_start") / 32)).count().agg(F.max("count")).first()[0] <= 32


def test_pack_calls_python_for_many_groups(spark):
    """F8: every short conversation was a call of its own, twice."""
    rows = [(c, t, (c * 7 + t * 31) % 23) for c in range(60) for t in range(1 + c % 9)]
    df = spark.createDataFrame(rows, "c long, t long, s long")
    packed = search.pack(df, ["c"], ["t"], "t", "s", 3, 20, chunk=4)
    assert "FlatMapGroups" not in plan(packed)
    expected = {}
    for c in range(60):
        number, n, used = 0, 0, 0
        for _, t, s in sorted(r for r in rows if r[0] == c):
            if s > 20:
                number, n, used = number + (n > 0), 0, 0
                expected[c, t] = None
                continue
            if n and (n == 3 or used + s > 20):
                number, n, used = number + 1, 0, 0
            n, used = n + 1, used + s
            expected[c, t] = number
    assert {(r["c"], r["t"]): r["packet"] for r in packed.collect()} == expected


def test_numeric_verdicts_do_not_double_their_rows(spark):
    """a distinct count beside other aggregates expanded every operand to two rows."""
    from workload import QUERIES

    assert "Expand" not in plan(QUERIES["numeric_kinds"](spark, "/root/testdata/sf0.001"))


def test_numeric_verdicts_move_lines_once(spark):
    """lines, bindings, operands and observations were exchanged seven times, as wide rows."""
    from workload import QUERIES

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        physical = QUERIES["numeric_kinds"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    moved = [line.split("Exchange", 1)[1] for line in physical.splitlines() if "Exchange" in line]
    assert moved and all(line.startswith(" hashpartitioning(l_orderkey#") and "REPARTITION_BY_NUM" in line for line in moved), moved


def test_numeric_verdicts_of_small_documents_are_the_same(spark):
    """the join by document alone gives what the join by observation gives, for odd bindings too."""
    from claimgrove.operators import numeric
    from tests.test_rounds import numeric_rows

    bindings = [
        ("c", "comparison", ["a"], "0.10"),
        ("c", "comparison", ["a"], "0.10"),
        ("c", "comparison", ["a"], "0.1"),
        ("c", "sum", ["a", "b", "n"], "-10.15"),
        ("c", "sum", ["a", "a"], "0.2"),
        ("d", "sum", [], "1"),
        ("d", "comparison", None, "1"),
        ("d", "comparison", [None], "1"),
        ("e", "comparison", ["missing"], "1"),
        ("e", "comparison", ["text"], "1"),
        ("e", "comparison", ["twin"], "7"),
        ("f", "product_reduction", ["b", "a"], "98.9"),
        ("f", "product_reduction", ["z", "a"], "1"),
        ("g", "comparison", ["z"], "0.00"),
    ]
    values = [("a", "0.10"), ("b", "9"), ("n", "-19.25"), ("text", "x"), ("twin", "7"), ("twin", "7"), ("z", "0.00"), (None, "1")]
    b, o = numeric_rows(spark, bindings, values)
    shop = F.when(F.col("kind") == "product_reduction", "old")
    b = b.withColumns({"baseline_subject": shop, "baseline_period": F.when(shop.isNotNull(), "2024")})
    o = o.withColumn("subject", F.when(F.col("observation_id").isin("b", "z"), "old").otherwise("s"))
    b = b.withColumn("subject", F.when((F.col("kind") != "product_reduction") & F.array_contains("observation_ids", "z"), "old").otherwise("s"))
    rows = lambda small: sorted(map(str, numeric.check_numeric(b, o, small_docs=small).collect()))
    assert rows(True) == rows(False) and len(rows(True)) == len(bindings) - 1
    verdicts = {(r["claim_id"], r["reported_value"]): r for r in numeric.check_numeric(b, o, small_docs=True).collect()}
    assert verdicts["c", "0.10"]["computed"] == "0.1" and verdicts["g", "0.00"]["computed"] == "0"
    assert verdicts["c", "0.2"]["reason"] == "aggregation_relation_unresolved"
    assert verdicts["e", "7"]["status"] == "consistent"
    assert (verdicts["f", "98.9"]["numerator"], verdicts["f", "98.9"]["denominator_exact"]) == ("890", "9")
    assert verdicts["f", "1"]["reason"] == "zero_baseline_interval"


def test_fractions_of_any_length_are_reduced(spark):
    """fractions are reduced many at a time where 64 bits hold them."""
    from fractions import Fraction

    from claimgrove.functions import numbers

    pairs = [(0, 7), (-17, 2), (17, -2), (6, 4), (20, 6), (1, 0), (10**20, 3 * 10**19), (-(2**63), 6), (2**62, -(2**62) + 1), (7, 10**30), (None, 2), (3, None)]
    texts = [tuple(None if x is None else str(x) for x in p) for p in pairs]
    df = spark.createDataFrame(texts, "n string, d string")
    got = df.select("n", "d", numbers.reduce_fraction(F.col("n").cast("decimal(38,0)"), F.col("d").cast("decimal(38,0)")).alias("r")).collect()
    for row in got:
        n, d, r = row["n"], row["d"], row["r"]
        if n is None or d is None or int(d) == 0:
            assert tuple(r) == (None, None, None)
        elif r["decimal"] is not None:
            assert Fraction(r["decimal"]) == Fraction(int(n), int(d)) and r["numerator"] is None
        else:
            whole = Fraction(int(n), int(d))
            assert (r["numerator"], r["denominator"]) == (str(whole.numerator), str(whole.denominator))
    assert sum(r["r"]["decimal"] is not None for r in got) == 5
