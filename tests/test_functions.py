"""Column functions on literal values."""

import unicodedata

from pyspark.sql import functions as F

from claimgrove.functions import arrays, canonical, geometry, numbers, periods, text
from claimgrove.sources.sinks import guard_formula


def one(spark, value, fn):
    return spark.createDataFrame([(value,)], "v string").select(fn(F.col("v")).alias("r")).first()["r"]


def test_search_terms_bigrams_words_numbers(spark):
    assert one(spark, "온실가스 Scope 1 배출 1,234.5 Straße 물", text.search_terms) == [
        "온실", "실가", "가스", "scope", "1", "배출", "1,234.5", "strasse",
    ]


def test_nfc_and_offsets(spark):
    decomposed = unicodedata.normalize("NFD", "가나 é")
    row = spark.createDataFrame([(decomposed,)], "v string").select(
        text.nfc(F.col("v")).alias("n"), text.nfc_to_raw(F.col("v"), F.lit(1), F.lit(2)).alias("s")
    ).first()
    assert row["n"] == "가나 é"
    assert decomposed[row["s"]["start"] : row["s"]["end"]] == unicodedata.normalize("NFD", "나")


def test_fold_text_ligature_and_space(spark):
    assert one(spark, " eﬃcient   use ", text.fold_text) == "efficient use"


def test_sentence_spans(spark):
    source = "Cut 3.5% now. Next!\n\nLast line"
    got = one(spark, source, text.sentence_spans)
    assert [source[s["start"] : s["end"]] for s in got] == ["Cut 3.5% now.", "Next!", "Last line"]


def test_quantity_ranges_are_left_out(spark):
    got = one(spark, "약 3만 톤 감축, 10-20 MWh, Scope 1·2", text.quantity_spans)
    assert [(s["kind"], s["quote"]) for s in got] == [
        ("scope", "Scope 1·2"), ("value", "약 3만 톤"), ("unit", "톤"), ("unit", "MWh"),
    ]


def test_split_metric_and_clause(spark):
    got = one(spark, "5 톤의 배출량", text.split_metric)
    assert (got["quantity"], got["unit"], got["metric"]) == ("5", "톤", "배출량")
    clauses = one(spark, "전력 5 MWh 절감, 이를 통해 3 톤 감축", text.split_clause)
    assert [c["quote"] for c in clauses] == ["전력 5 MWh 절감,", "이를 통해 3 톤 감축"]
    assert one(spark, "전력 절감, 이를 통해 3 톤 감축", text.split_clause) is None


def test_notes_and_cues(spark):
    assert one(spark, "단위: 천 tCO2e", text.unit_note) == "천 tCO2e"
    assert one(spark, "단위는 톤", text.unit_note) is None
    assert one(spark, "Scope: Scope 2", text.scope_note) == "Scope 2"
    assert one(spark, "연결 기준 Scope 1 & 2", lambda c: text.axis_cues(c, "boundary")) == ["연결"]
    assert one(spark, "연결 기준 Scope 1 & 2", lambda c: text.axis_cues(c, "scope")) == ["scope1&2"]


def test_page_list_and_codes(spark):
    assert one(spark, "GRI 302-1 Energy p. 12-14, 20", text.page_list) == ["12", "13", "14", "20"]
    assert one(spark, "GRI 302-1 Energy", text.page_list) == []
    inside = lambda c: text.code_in_ranges(F.lit("302-3"), c)
    assert one(spark, "302-1 ~ 302-5", inside) is True
    assert one(spark, "302-1, 302-5", inside) is False


def test_periods(spark):
    for value, want in [
        ("FY2024", True), ("2024년", True), ("2024 Q3", True), ("2025-2024", False),
        ("2024-02-30", False), ("2024-01-01 ~ 2024-12-31", True), ("last year", False),
    ]:
        assert one(spark, value, periods.is_supported_period) is want, value
    got = one(spark, "2024년 1월 1일 부터 2024-12-31", periods.period_from_literal)
    assert (str(got["start"]), str(got["end"])) == ("2024-01-01", "2024-12-31")
    assert one(spark, "2024 년도", periods.single_year) == "2024"
    assert one(spark, "FY2024", periods.single_year) is None


def test_amounts_keep_every_digit(spark):
    value = "123456789012345678901234567890123456789"
    got = one(spark, value, lambda c: numbers.normalize_amount(c, F.lit("KRW"), F.lit("억")))
    assert got["normalized"] == value + "0" * 8
    got = one(spark, "(1,234.50)", lambda c: numbers.normalize_amount(c, F.lit("KRW"), F.lit("천원")))
    assert got["normalized"] == "-1234500.00"
    assert one(spark, "5", lambda c: numbers.normalize_amount(c, F.lit("KRW"), F.lit("달러")))["state"] == "unit_unknown"
    assert one(spark, "N/A", lambda c: numbers.normalize_amount(c, F.lit("KRW"), F.lit("")))["normalized"] is None


def test_value_states(spark):
    state = lambda v, u: one(spark, v, lambda c: numbers.normalize_value(c, F.lit(u)))
    assert state("-", "t")["state"] == "missing" and state("-", "t")["value"] is None
    assert state("12 kg", "t")["state"] == "conflict"
    assert state("1,234", "천 톤")["value"] == "1234000"
    assert state("1,234", "천 톤")["unit"] == "톤"
    assert state("about 5", "t")["state"] == "unreadable"


def test_display_interval_and_fraction(spark):
    got = one(spark, "8", numbers.display_interval)
    assert (float(got["lo"]), float(got["hi"])) == (7.5, 8.5)
    got = one(spark, "-0.10", numbers.display_interval)
    assert (float(got["lo"]), float(got["hi"])) == (-0.105, -0.095)
    frac = lambda a, b: spark.range(1).select(numbers.reduce_fraction(F.lit(a), F.lit(b)).alias("r")).first()["r"]
    assert frac(-17, 2)["decimal"] == "-8.5"
    assert frac(10, 1)["decimal"] == "10"
    assert (frac(20, 6)["numerator"], frac(20, 6)["denominator"]) == ("10", "3")


def test_canonical_hash_matches_plain_json(spark):
    import hashlib
    import json

    want = hashlib.sha256(
        json.dumps({"a": 1, "b": None, "c": "값\t"}, sort_keys=True, separators=(",", ":")).encode()
    ).hexdigest()
    got = spark.range(1).select(
        canonical.canonical_hash(c=F.lit("값\t"), b=F.lit(None).cast("string"), a=F.lit(1)).alias("h")
    ).first()["h"]
    assert got == want


def test_hmac(spark):
    import hashlib
    import hmac

    got = one(spark, "tenant", lambda c: canonical.hmac_sha256(b"key", c))
    assert got == hmac.new(b"key", b"tenant", hashlib.sha256).hexdigest()


def test_geometry_rotations(spark):
    def project(rotation, width, height):
        page = F.struct(
            F.lit(width).alias("width"), F.lit(height).alias("height"), F.lit(rotation).alias("rotation"),
            F.struct(F.lit(0.0).alias("left"), F.lit(0.0).alias("bottom"), F.lit(100.0).alias("right"), F.lit(200.0).alias("top")).alias("crop"),
        )
        box = geometry.box(F.lit(10.0), F.lit(20.0), F.lit(30.0), F.lit(50.0))
        return spark.range(1).select(geometry.canonical_box(box, page).alias("r")).first()["r"]

    assert tuple(project(0, 100.0, 200.0)["bbox"]) == (10.0, 150.0, 30.0, 180.0)
    assert tuple(project(90, 200.0, 100.0)["bbox"]) == (20.0, 10.0, 50.0, 30.0)
    assert tuple(project(180, 100.0, 200.0)["bbox"]) == (70.0, 20.0, 90.0, 50.0)
    assert tuple(project(270, 200.0, 100.0)["bbox"]) == (150.0, 70.0, 180.0, 90.0)
    assert project(90, 100.0, 200.0)["reason"] == "page_geometry_inconsistent"


def test_entity_set_and_scoped_roles(spark):
    row = spark.createDataFrame([([" b", "a ", "b"], ["a", " "])], "x array<string>, y array<string>").select(
        arrays.entity_set(F.col("x")).alias("x"), arrays.entity_set(F.col("y")).alias("y")
    ).first()
    assert row["x"] == ["a", "b"] and row["y"] is None
    schema = "r map<string,map<string,struct<source_id:string,char_start:int,char_end:int>>>"
    roles = {"s:0:10": {"metric": ("s", 2, 4)}, "s:20:30": {"metric": ("s", 21, 22)}}
    df = spark.createDataFrame([(roles,)], schema)
    pick = lambda a, b: df.select(arrays.scoped_roles(F.lit("s"), F.lit(a), F.lit(b), F.col("r")).alias("r")).first()["r"]
    assert pick(1, 5)["metric"]["char_start"] == 2
    assert pick(8, 25) is None


def test_formula_guard(spark):
    assert one(spark, " =SUM(A1)", guard_formula) == "' =SUM(A1)"
    assert one(spark, "a=1", guard_formula) == "a=1"


def test_running_ends(spark):
    lengths = [list(range(n)) for n in (0, 1, 2, 3, 8, 9, 1000)]
    rows = spark.createDataFrame([(x,) for x in lengths], "v array<int>").select(text.running_ends(F.col("v"))).collect()
    assert [r[0] for r in rows] == [[sum(x[:i]) for i in range(len(x) + 1)] for x in lengths]


def test_matches_give_places_and_neighbours(spark):
    source = "ab12--3 45x"
    got = one(spark, source, lambda c: text.matches(c, r"\d+"))
    assert [(m["quote"], m["start"], m["end"]) for m in got] == [("12", 2, 4), ("3", 6, 7), ("45", 8, 10)]
    assert [m["before"] for m in got] == ["ab", "12--", "3 "]
    assert [m["after"] for m in got] == ["--3", " 45", "x"]
    assert one(spark, "", lambda c: text.matches(c, r"\d+")) == []


def test_offsets_of_a_long_text_in_linear_time(spark):
    import time

    unit = "used 10-20 MWh, then 7 MWh. "
    frame = spark.createDataFrame([(n, unit * n) for n in (1, 40_000)], "n int, v string").repartition(1).cache()
    frame.count()
    for fn, each in ((text.quantity_spans, 3), (text.sentence_spans, 1)):
        seconds = {}
        for n in (1, 40_000):
            started = time.perf_counter()
            found = frame.where(F.col("n") == n).select(fn(F.col("v")).alias("s")).selectExpr("size(s)", "s[size(s) - 1]")
            size, last = found.first()
            seconds[n] = time.perf_counter() - started
            assert size == each * n
            assert (unit * n)[last["start"] : last["end"]] == ("MWh" if each == 3 else unit.strip())
        # More than a megabyte; planning takes as long for either.
        assert seconds[40_000] - seconds[1] < 8, seconds


def test_range_ends_on_either_side(spark):
    for source, values in {
        "10-20 MWh": [],
        "10 MWh - 20 MWh": [],
        "3 MWh~4 MWh, 5 MWh": ["5 MWh"],
        "5 MWh and -7 MWh": ["5 MWh", "-7 MWh"],
        "8 천 MWh – 약 9 MWh": [],
        "1 MWh. 2 MWh-": ["1 MWh", "2 MWh"],
    }.items():
        got = one(spark, source, text.quantity_spans)
        assert [s["quote"] for s in got if s["kind"] == "value"] == values, source
