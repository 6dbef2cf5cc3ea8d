"""Literals, codes, page lists, roles and quotients, derived from order lines and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimgrove.functions import arrays, numbers, periods, text
from claimgrove.operators import assurance, claims, reconcile, summary
from workload.common import query, read

# Small numbers of an order line.
_LINES = """SELECT l_orderkey, l_linenumber, l_orderkey % 10007 AS k, l_partkey % 997 AS p, l_suppkey % 101 AS s,
           CAST(l_quantity AS BIGINT) AS q FROM lineitem"""


def _lines(spark, folder):
    return read(spark, folder, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        (F.col("l_orderkey") % 10007).alias("k"),
        (F.col("l_partkey") % 997).alias("p"),
        (F.col("l_suppkey") % 101).alias("s"),
        F.col("l_quantity").cast("bigint").alias("q"),
    )


KEYS = ("l_orderkey", "l_linenumber")


def _small():
    return (F.col(c) for c in "kpsq")


def joined(c):
    return F.array_join(c, ",")


@query(
    "page_lists",
    f"""WITH t AS ({_LINES}), n AS (SELECT *, 1 + k % 50 AS a, k % 5 AS d, 1 + p % 60 AS b FROM t)
    SELECT l_orderkey, l_linenumber, CASE WHEN k % 11 > 0 THEN (100 + k % 300) || '-' || (1 + s % 9) END AS code,
           CASE WHEN k % 11 = 0 THEN '' ELSE array_to_string(list_concat(range(a, a + d + 1),
             CASE WHEN b BETWEEN a AND a + d THEN [] ELSE [b] END), ',') END AS labels FROM n""",
)
def page_lists(spark, folder):
    """Disclosure code and printed pages of index rows."""
    k, p, s, q = _small()
    a = 1 + k % 50
    code = F.when(k % 11 > 0, F.concat(F.lit(" GRI "), 100 + k % 300, F.lit("-"), 1 + s % 9)).otherwise("")
    row = F.concat(F.lit("Energy use"), code, F.lit(" p. "), a, F.lit(" – "), a + k % 5, F.lit(", "), 1 + p % 60)
    return _lines(spark, folder).select(
        *KEYS, text.index_code(row).alias("code"), joined(text.page_list(row)).alias("labels")
    )


@query(
    "code_ranges",
    f"""WITH t AS ({_LINES})
    SELECT l_orderkey, l_linenumber,
           (k % 3 = p % 3 AND 1 + k % 20 BETWEEN 1 + p % 10 AND 1 + p % 10 + s % 8)
           OR (k % 3 = s % 3 AND 1 + k % 20 = 1 + s % 15) AS listed FROM t""",
)
def code_ranges(spark, folder):
    """Whether a text lists a code, alone or in a range of its topic."""
    k, p, s, q = _small()
    code = lambda topic, item: F.concat(100 + topic % 3, F.lit("-"), 1 + item)
    listing = F.concat(
        code(p, p % 10), F.lit(" ~ "), code(p, p % 10 + s % 8), F.lit(", "), code(s, s % 15)
    )
    return _lines(spark, folder).select(*KEYS, text.code_in_ranges(code(k, k % 20), listing).alias("listed"))


@query(
    "note_literals",
    f"""WITH t AS ({_LINES})
    SELECT l_orderkey, l_linenumber,
           CASE k % 5 WHEN 0 THEN '천 tCO2e' WHEN 1 THEN 'MWh' WHEN 2 THEN '톤' END AS unit,
           CASE WHEN p % 4 > 0 AND s % 3 < 2 THEN 'Scope ' || (p % 4) END AS scope FROM t""",
)
def note_literals(spark, folder):
    """Units and scopes of complete notes; other texts give null."""
    k, p, s, q = _small()
    unit = F.element_at(
        F.array(*(F.lit(x) for x in (" 단위: 천 tCO2e", "Unit : MWh ", "UNIT:톤", "단위는 톤", "단위: 톤 외"))), (k % 5 + 1).cast("int")
    )
    scope = F.concat(F.element_at(F.array(F.lit("Scope: Scope "), F.lit("Scope "), F.lit("Scopes ")), (s % 3 + 1).cast("int")), p % 4)
    return _lines(spark, folder).select(
        *KEYS, text.unit_note(unit).alias("unit"), text.scope_note(scope).alias("scope")
    )


@query(
    "axis_cue_sets",
    f"""WITH t AS ({_LINES})
    SELECT l_orderkey, l_linenumber, CASE k % 4 WHEN 0 THEN '연결' WHEN 1 THEN 'standalone' WHEN 2 THEN '별도' ELSE '' END AS boundary,
           CASE WHEN s % 2 = 0 THEN 'scope' || (1 + p % 3) ELSE 'scope' || (1 + p % 3) || 'and' || (1 + q % 3) END AS scopes FROM t""",
)
def axis_cue_sets(spark, folder):
    """Literal boundary and scope cues."""
    k, p, s, q = _small()
    base = F.element_at(
        F.array(*(F.lit(x) for x in ("연결 기준", "Standalone  basis", "별도 재무", "연결고리"))), (k % 4 + 1).cast("int")
    )
    more = F.when(s % 2 == 0, F.lit("")).otherwise(F.concat(F.lit(" and "), 1 + q % 3))
    cell = F.concat(base, F.lit(", SCOPE "), 1 + p % 3, more, F.lit(" tonnes"))
    return _lines(spark, folder).select(
        *KEYS,
        joined(text.axis_cues(cell, "boundary")).alias("boundary"),
        joined(text.axis_cues(cell, "scope")).alias("scopes"),
    )


@query(
    "clause_splits",
    f"""WITH t AS ({_LINES}), c AS (SELECT *, '전력 ' || q || ' MWh 절감,' AS a,
                 '이를 통해 ' || CASE WHEN k % 3 > 0 THEN (1 + p) || ' 톤 ' ELSE '' END || '감축' AS b FROM t)
    SELECT l_orderkey, l_linenumber, CASE WHEN k % 3 > 0 THEN a END AS first_clause,
           CASE WHEN k % 3 > 0 THEN b END AS second_clause,
           CASE WHEN k % 3 > 0 THEN length(a) + 1 END AS second_start FROM c""",
)
def clause_splits(spark, folder):
    """Sentences of two valued clauses around one link."""
    k, p, s, q = _small()
    value = F.when(k % 3 > 0, F.concat(1 + p, F.lit(" 톤 "))).otherwise("")
    sentence = F.concat(F.lit("전력 "), q, F.lit(" MWh 절감, 이를 통해 "), value, F.lit("감축"))
    parts = _lines(spark, folder).withColumn("parts", text.split_clause(sentence))
    return parts.select(
        *KEYS,
        F.get("parts", F.lit(0))["quote"].alias("first_clause"),
        F.get("parts", F.lit(1))["quote"].alias("second_clause"),
        F.get("parts", F.lit(1))["start"].cast("bigint").alias("second_start"),
    )


@query(
    "metric_splits",
    f"""WITH t AS ({_LINES})
    SELECT l_orderkey, l_linenumber, CASE WHEN k % 4 < 2 THEN q || CASE WHEN p % 2 = 0 THEN ',000' ELSE '' END END AS quantity,
           CASE k % 4 WHEN 0 THEN '톤' WHEN 1 THEN 'MWh' END AS unit, CASE WHEN k % 4 < 2 THEN '사용량 ' || s END AS metric FROM t""",
)
def metric_splits(spark, folder):
    """Phrases `<quantity><unit>의 <metric>`; other shapes give null."""
    k, p, s, q = _small()
    unit = F.element_at(F.array(*(F.lit(x) for x in ("톤의 ", " MWh의 ", " MWh ", "개의 "))), (k % 4 + 1).cast("int"))
    phrase = F.concat(q, F.when(p % 2 == 0, F.lit(",000")).otherwise(""), unit, F.lit("사용량 "), s)
    return _lines(spark, folder).withColumn("m", text.split_metric(phrase)).select(
        *KEYS, "m.quantity", "m.unit", "m.metric"
    )


@query(
    "normal_periods",
    """WITH t AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS a, CAST(o_orderdate AS DATE) + CAST(o_custkey % 40 - 5 AS INTEGER) AS b FROM orders)
    SELECT o_orderkey, CASE WHEN ok THEN strftime(a, '%Y-%m-%d') END AS first_day, CASE WHEN ok THEN strftime(b, '%Y-%m-%d') END AS last_day
    FROM (SELECT *, a <= b AND o_orderkey % 13 > 0 AND o_orderkey % 17 > 0 AS ok FROM t)""",
)
def normal_periods(spark, folder):
    """Periods from compact or dashed days; impossible, incomplete or reversed ones give null."""
    day = F.col("o_orderdate").cast("date")
    last = F.date_add(day, (F.col("o_custkey") % 40 - 5).cast("int"))
    key = F.col("o_orderkey")
    start = F.when(key % 13 == 0, F.lit("20241301")).otherwise(F.date_format(day, "yyyyMMdd"))
    end = F.when(key % 17 == 0, F.lit("2024-12")).otherwise(F.date_format(last, "yyyy-MM-dd"))
    rows = read(spark, folder, "orders").select("o_orderkey", periods.normalize_period(start, end).alias("p"))
    return rows.select(
        "o_orderkey", F.col("p.start").cast("string").alias("first_day"), F.col("p.end").cast("string").alias("last_day")
    )


@query(
    "union_refs",
    f"""WITH t AS ({_LINES}), l AS (SELECT *, list_filter(list_concat([k % 7, p % 7, CASE WHEN s % 3 > 0 THEN s % 7 END],
             CASE WHEN q % 4 > 0 THEN [q % 7, k % 7] ELSE [] END), lambda x: x IS NOT NULL) AS all_refs FROM t)
    SELECT l_orderkey, l_linenumber, array_to_string(list_filter(all_refs, lambda x, i: list_position(all_refs, x) = i), ',') AS refs FROM l""",
)
def union_refs(spark, folder):
    """References of several lists, each kept once at its first place."""
    k, p, s, q = _small()
    ref = lambda c: (c % 7).cast("string")
    one = F.array(ref(k), ref(p), F.when(s % 3 > 0, ref(s)))
    two = F.when(q % 4 > 0, F.array(ref(q), ref(k)))
    return _lines(spark, folder).select(*KEYS, joined(arrays.ordered_distinct(one, two)).alias("refs"))


@query(
    "scoped_role_lookup",
    f"""WITH t AS ({_LINES}), n AS (SELECT *, k % 20 AS a, k % 20 + 1 + q % 8 AS b FROM t),
    m AS (SELECT *, b <= 12 AS in_low, p % 2 = 0 AND a >= 10 AND b <= 20 AS in_high, s % 5 = 0 AS leaves FROM n)
    SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 7 THEN 'whole' WHEN in_low AND in_high THEN NULL
             WHEN in_low THEN 'low' WHEN in_high AND NOT leaves THEN 'high' END AS roles FROM m""",
)
def scoped_role_lookup(spark, folder):
    """Roles of the one scope that holds a span; several, none or a leaving role stay unresolved."""
    k, p, s, q = _small()
    at = lambda lo, hi: F.struct(
        F.lit("s").alias("source_id"), F.lit(lo).alias("char_start"), F.lit(hi).cast("int").alias("char_end")
    )
    role = lambda name, span: F.create_map(F.lit(name), span)
    high = F.when(s % 5 == 0, at(11, 25)).otherwise(at(11, 19))
    whole = F.create_map(F.lit("s"), role("whole", at(0, 99)))
    low = F.create_map(F.lit("s:0:12"), role("low", at(2, 8)))
    both = F.map_concat(whole, low, F.create_map(F.lit("s:10:20"), role("high", high)))
    table = F.when(F.col("l_linenumber") == 7, whole).when(p % 2 == 0, both).otherwise(F.map_concat(whole, low))
    start = (k % 20).cast("int")
    found = arrays.scoped_roles(F.lit("s"), start, (start + 1 + q % 8).cast("int"), table)
    return _lines(spark, folder).select(*KEYS, F.get(F.map_keys(found), F.lit(0)).alias("roles"))


@query(
    "exact_quotients",
    f"""WITH t AS ({_LINES}), g AS (SELECT *, k // gcd(k, q) AS n, q // gcd(k, q) AS d FROM t),
    e AS (SELECT *, 100000 % d = 0 AS ends, n * 100000 // d AS w FROM g)
    SELECT l_orderkey, l_linenumber, CASE WHEN ends THEN rtrim(rtrim(printf('%d.%05d', w // 100000, w % 100000), '0'), '.') END AS value,
           CASE WHEN NOT ends THEN CAST(n AS VARCHAR) END AS numerator, CASE WHEN NOT ends THEN CAST(d AS VARCHAR) END AS denominator FROM e""",
)
def exact_quotients(spark, folder):
    """Quotients as exact decimals where they end, as reduced pairs where not."""
    k, p, s, q = _small()
    rows = _lines(spark, folder).withColumn("r", numbers.reduce_fraction(k, q))
    return rows.select(*KEYS, F.col("r.decimal").alias("value"), "r.numerator", "r.denominator")


@query(
    "page_quality",
    """WITH b AS (SELECT l_suppkey AS document, l_linenumber AS page_num, count(*) AS n_blocks,
        count(*) FILTER (l_partkey % 5 = 0) AS n_verified, count(*) FILTER (l_partkey % 5 = 1) AS n_unverified,
        count(*) FILTER (l_partkey % 5 = 2) AS n_conflicted, count(*) FILTER (l_partkey % 5 = 3) AS n_unreadable,
        count(*) FILTER (l_partkey % 5 = 4) AS n_unlocated FROM lineitem GROUP BY ALL),
    i AS (SELECT o_custkey % 150 AS document, CAST(o_orderkey % 9 AS INTEGER) AS page_num, count(*) FILTER (o_orderstatus = 'O') AS open_issues,
        count(*) FILTER (o_orderstatus = 'P') AS unreadable_issues FROM orders GROUP BY ALL)
    SELECT document, page_num, coalesce(n_blocks, 0) AS n_blocks, coalesce(n_verified, 0) AS n_verified, coalesce(n_unverified, 0) AS n_unverified,
           coalesce(n_conflicted, 0) AS n_conflicted, coalesce(n_unreadable, 0) AS n_unreadable, coalesce(n_unlocated, 0) AS n_unlocated,
           coalesce(open_issues, 0) AS open_issues, coalesce(unreadable_issues, 0) AS unreadable_issues
    FROM b FULL JOIN i USING (document, page_num)""",
)
def page_quality(spark, folder):
    """Blocks by quality and open issues of every page that has either."""
    states = F.array(*(F.lit(x) for x in ("verified", "unverified", "conflicted", "unreadable", "unlocated")))
    blocks = read(spark, folder, "lineitem").select(
        F.col("l_suppkey").alias("document"),
        F.col("l_linenumber").cast("int").alias("page_num"),
        F.get(states, (F.col("l_partkey") % 5).cast("int")).alias("quality"),
    )
    state = F.when(F.col("o_orderstatus") == "O", "open").when(F.col("o_orderstatus") == "P", "unreadable")
    issues = read(spark, folder, "orders").select(
        (F.col("o_custkey") % 150).alias("document"),
        (F.col("o_orderkey") % 9).cast("int").alias("page_num"),
        state.alias("state"),
    )
    return summary.quality_rollup(blocks, issues, ["document", "page_num"])


@query(
    "issue_rollup",
    """SELECT o_orderstatus AS state, o_orderpriority AS kind, CAST(grouping(o_orderstatus, o_orderpriority) AS BIGINT) AS grouping_id, count(*) AS n_issues
    FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)""",
)
def issue_rollup(spark, folder):
    """Issues by state and kind with subtotals."""
    issues = read(spark, folder, "orders").select(
        F.col("o_orderstatus").alias("state"), F.col("o_orderpriority").alias("kind")
    )
    return summary.issue_counts(issues, ["state", "kind"])


@query(
    "quotations_open",
    """WITH t AS (SELECT conv_id, turn, conv_id % 5 AS form, length(regexp_replace(text, '[‘’“”]', '', 'g')) AS n FROM conversations)
    SELECT conv_id, turn, CAST(CASE form WHEN 1 THEN n + 1 WHEN 4 THEN 2 ELSE 0 END AS BIGINT) AS closed_until,
           CAST(CASE form WHEN 2 THEN 0 WHEN 3 THEN n + 4 WHEN 4 THEN n + 3 END AS BIGINT) AS open_from FROM t""",
)
def quotations_open(spark, folder):
    """Quotation marks without a partner around every turn of a conversation."""
    plain = F.regexp_replace("text", "[‘’“”]", "")
    form = F.col("conv_id") % 5
    marked = (
        F.when(form == 0, F.concat(F.lit("“"), plain, F.lit("”")))
        .when(form == 1, F.concat(plain, F.lit("” and")))
        .when(form == 2, F.concat(F.lit("“"), plain))
        .when(form == 3, F.concat(F.lit("‘a’ "), plain, F.lit("“")))
        .otherwise(F.concat(F.lit("x’ "), plain, F.lit("‘y")))
    )
    rows = read(spark, folder, "conversations").withColumn("q", claims.unclosed_quotation(marked))
    return rows.select(
        "conv_id",
        "turn",
        F.col("q.closed_until").cast("bigint").alias("closed_until"),
        F.col("q.open_from").cast("bigint").alias("open_from"),
    )


@query(
    "text_offsets",
    f"""WITH t AS ({_LINES}), n AS (SELECT *, k % 7 AS a, p % 9 AS b, s % 10 AS i, s % 10 + q % 6 AS j FROM t)
    SELECT l_orderkey, l_linenumber, CAST(CASE WHEN j <= a + b THEN i + least(i, a) END AS BIGINT) AS raw_start,
           CAST(CASE WHEN j <= a + b THEN j + least(j, a) END AS BIGINT) AS raw_end FROM n""",
)
def text_offsets(spark, folder):
    """Offsets in composed text moved back to the raw text with combining marks."""
    k, p, s, q = _small()
    raw = F.concat(F.repeat(F.lit("é"), (k % 7).cast("int")), F.repeat(F.lit("x"), (p % 9).cast("int")))
    start = (s % 10).cast("int")
    moved = text.nfc_to_raw(raw, start, (start + q % 6).cast("int"))
    return _lines(spark, folder).select(
        *KEYS, moved["start"].cast("bigint").alias("raw_start"), moved["end"].cast("bigint").alias("raw_end")
    )


@query(
    "refs_in_opinions",
    f"""WITH t AS ({_LINES}), o AS (SELECT o_custkey % 101 AS s, o_orderkey % 400 AS a, o_orderkey % 400 + 5 + o_custkey % 60 AS b FROM orders)
    SELECT l_orderkey, l_linenumber, k % 500 AS char_start FROM t
    WHERE EXISTS (SELECT 1 FROM o WHERE o.s = t.s AND o.a <= k % 500 AND k % 500 + 1 + q <= o.b)""",
)
def refs_in_opinions(spark, folder):
    """References that lie inside a span of their opinion."""
    k, p, s, q = _small()
    refs = _lines(spark, folder).select(*KEYS, "s", (k % 500).alias("char_start"), (k % 500 + 1 + q).alias("char_end"))
    start = F.col("o_orderkey") % 400
    spans = read(spark, folder, "orders").select(
        (F.col("o_custkey") % 101).alias("s"),
        start.alias("char_start"),
        (start + 5 + F.col("o_custkey") % 60).alias("char_end"),
    )
    return assurance.within_boundary(refs, spans, ["s"]).select(*KEYS, "char_start")


@query(
    "coverage_receipts",
    """WITH r AS (SELECT c_custkey AS c, CASE c_custkey % 4 WHEN 0 THEN 'complete' WHEN 1 THEN 'incomplete' WHEN 2 THEN 'complete' ELSE 'bogus' END AS state,
        c_custkey % 7 = 0 AS unknown, c_custkey % 11 = 0 AS none, c_custkey % 3 = 0 AS failed FROM customer),
    p AS (SELECT o_orderkey, o_orderkey % 3 = 0 AS claims, o_orderkey % 6 = 0 AS foreign_tenant, o_orderkey % 8 = 0 AS other_version, r.*
          FROM orders LEFT JOIN r ON c = o_custkey AND o_orderkey % 5 > 0),
    v AS (SELECT *, CASE WHEN c IS NULL THEN claims ELSE foreign_tenant OR state = 'bogus' OR (unknown AND NOT none)
          OR (state = 'complete' AND (none OR failed OR other_version)) END AS bad FROM p)
    SELECT o_orderkey, CASE WHEN bad THEN 'coverage_unverified' END AS coverage_reason,
           CASE WHEN bad THEN NULL WHEN c IS NULL THEN 'not_run' ELSE state END AS search_state FROM v""",
)
def coverage_receipts(spark, folder):
    """Search state of every packet as its receipt proves it."""
    c, key = F.col("c_custkey"), F.col("o_orderkey")
    named = lambda letter, of: F.concat(F.lit(letter), of)
    customers = read(spark, folder, "customer")
    texts = F.array().cast("array<string>")
    required = F.array(named("s", c), named("f", c))
    required = F.when(c % 11 == 0, texts).when(c % 7 == 0, F.array_append(required, named("x", c))).otherwise(required)
    receipts = customers.select(
        c.alias("receipt_id"),
        F.lit("t").alias("tenant_id"),
        F.lit("c").alias("company_id"),
        F.lit("k").alias("package_id"),
        F.lit("p").alias("coverage_policy_id"),
        F.get(F.array(*(F.lit(x) for x in ("complete", "incomplete", "complete", "bogus"))), (c % 4).cast("int")).alias("state"),
        required.alias("required_document_ids"),
        F.when(c % 3 == 0, F.array(named("s", c))).otherwise(texts).alias("failed_document_ids"),
    )
    documents = customers.select(F.explode(F.array(named("s", c), named("f", c))).alias("document_id"))
    customer = F.col("o_custkey")
    packets = read(spark, folder, "orders").select(
        key.alias("packet_id"),
        F.when(key % 5 > 0, customer).alias("receipt_id"),
        F.when(key % 3 == 0, "complete").otherwise("partial").alias("claimed_state"),
        F.when(key % 6 == 0, "u").otherwise("t").alias("tenant_id"),
        F.lit("c").alias("company_id"),
        F.lit("k").alias("package_id"),
        F.lit("p").alias("coverage_policy_id"),
        named("s", customer).alias("sustainability_version"),
        F.when(key % 8 == 0, F.lit("zzz")).otherwise(named("f", customer)).alias("financial_version"),
    )
    out = reconcile.apply_coverage(packets, receipts, documents)
    return out.select(F.col("packet_id").alias("o_orderkey"), "coverage_reason", "search_state")
