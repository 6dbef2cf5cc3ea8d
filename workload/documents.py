"""Text, span, citation and layout queries over documents, turns and parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimgrove.functions import arrays, geometry, numbers, periods, text
from claimgrove.functions.canonical import canonical_hash
from claimgrove.operators import claims, layout, lineage
from workload.common import cents, query, read

# ---------------------------------------------------------------- sentences, quantities


@query(
    "sentence_spans",
    r"""WITH m AS (
      -- a mark after every newline run and after [.!?] followed by whitespace
      SELECT doc_id, regexp_replace(regexp_replace(text, '(\n+)', '\1' || chr(1), 'g'), '([^' || chr(1) || '][.!?])(\s|$)', '\1' || chr(1) || '\2', 'g') AS t FROM documents
    ), s AS (SELECT doc_id, string_split(t, chr(1)) AS p FROM m),
    u AS (SELECT doc_id, unnest(p) AS piece, generate_subscripts(p, 1) AS i FROM s),
    o AS (SELECT doc_id, piece, coalesce(sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM u)
    SELECT doc_id, count(*) AS n_sentences,
           CAST(sum(off + length(piece) - length(ltrim(piece, E' \t\n\r'))) AS BIGINT) AS starts,
           CAST(sum(off + length(rtrim(piece, E' \t\n\r'))) AS BIGINT) AS ends
    FROM o WHERE trim(piece, E' \t\n\r') <> '' GROUP BY doc_id""",
)
def sentence_spans(spark, folder):
    """Sentence count and offset sums of every document."""
    spans = read(spark, folder, "documents").select(
        "doc_id", F.explode(text.sentence_spans(F.col("text"))).alias("s")
    )
    return spans.groupBy("doc_id").agg(
        F.count("*").alias("n_sentences"),
        F.sum("s.start").alias("starts"),
        F.sum("s.end").alias("ends"),
    )


@query(
    "quantities",
    """WITH t AS (SELECT l_orderkey, l_linenumber, l_orderkey % 10000 AS k, CAST(l_quantity AS BIGINT) AS q FROM lineitem)
    SELECT l_orderkey, l_linenumber, CAST(k AS VARCHAR) AS lot, q || ' MWh' AS value, 'MWh,kWh' AS units, 'Scope ' || (k % 3 + 1) AS scope,
           CAST(1995 + k % 30 AS VARCHAR) AS years FROM t""",
)
def quantities(spark, folder):
    """Values, units, scopes and years of a sentence about every order line."""
    rows = read(spark, folder, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        (F.col("l_orderkey") % 10000).alias("k"),
        F.col("l_quantity").cast("bigint").alias("q"),
    )
    k, q = F.col("k"), F.col("q")
    sentence = F.concat(
        F.lit("Lot "), k + 10000, F.lit(" used "), q, F.lit(" MWh and "), k % 7, F.lit("-"), q,
        F.lit(" kWh, Scope "), k % 3 + 1, F.lit(" in "), 1995 + k % 30, F.lit(", ref "), k, F.lit("2020"),
    )
    found = text.quantity_quotes(F.col("sentence"))
    quotes = lambda kind: F.array_join(found[kind], ",")
    rows = rows.withColumn("sentence", sentence)
    return rows.select(
        "l_orderkey",
        "l_linenumber",
        k.cast("string").alias("lot"),
        quotes("value").alias("value"),
        quotes("unit").alias("units"),
        quotes("scope").alias("scope"),
        F.array_join(text.year_quotes(F.col("sentence")), ",").alias("years"),
    )


@query(
    "year_mentions",
    r"""WITH m AS (SELECT doc_id, regexp_replace(text, '(\d)', '\1', 'g') AS t FROM documents),
    y AS (SELECT doc_id, list_filter(regexp_extract_all(t, '\d+'), lambda d: length(d) = 4 AND (d LIKE '19%' OR d LIKE '20%')) AS ys FROM m)
    SELECT doc_id, CAST(len(ys) AS BIGINT) AS n_years, array_to_string(list_sort(list_distinct(ys)), ',') AS years FROM y""",
)
def year_mentions(spark, folder):
    """Year literals of every document."""
    found = text.year_quotes(F.col("text"))
    return (
        read(spark, folder, "documents")
        .select("doc_id", found.alias("ys"))
        .select(
            "doc_id",
            F.size("ys").cast("bigint").alias("n_years"),
            F.array_join(F.array_sort(F.array_distinct("ys")), ",").alias("years"),
        )
    )


@query(
    "supported_periods",
    r"""WITH t AS (SELECT o_orderkey, year(o_orderdate) AS y, strftime(o_orderdate, '%Y-%m-%d') AS d, o_orderkey % 8 AS k FROM orders),
    p AS (SELECT o_orderkey, k, CASE k WHEN 0 THEN '' || y WHEN 1 THEN 'FY ' || y WHEN 2 THEN y || ' Q' || (1 + o_orderkey % 5)
             WHEN 3 THEN y || ' - ' || (y + o_orderkey % 3 - 1) WHEN 4 THEN d || ' ~ ' || y || '-06-30'
             WHEN 5 THEN y || '-02-30' WHEN 6 THEN 'year ' || y ELSE d END AS period, y, d FROM t)
    SELECT o_orderkey, period, CASE k WHEN 2 THEN o_orderkey % 5 < 4 WHEN 3 THEN o_orderkey % 3 >= 1
           WHEN 4 THEN d <= y || '-06-30' WHEN 5 THEN false WHEN 6 THEN false ELSE true END AS supported,
           CASE WHEN k = 0 THEN '' || y END AS single_year FROM p""",
)
def supported_periods(spark, folder):
    """Period literals of many shapes built from order dates."""
    o = read(spark, folder, "orders")
    y, key = F.year("o_orderdate"), F.col("o_orderkey")
    d = F.date_format("o_orderdate", "yyyy-MM-dd")
    k = key % 8
    literal = (
        F.when(k == 0, y.cast("string"))
        .when(k == 1, F.concat(F.lit("FY "), y))
        .when(k == 2, F.concat(y, F.lit(" Q"), 1 + key % 5))
        .when(k == 3, F.concat(y, F.lit(" - "), y + key % 3 - 1))
        .when(k == 4, F.concat(d, F.lit(" ~ "), y, F.lit("-06-30")))
        .when(k == 5, F.concat(y, F.lit("-02-30")))
        .when(k == 6, F.concat(F.lit("year "), y))
        .otherwise(d)
    )
    rows = o.select("o_orderkey", literal.alias("period"))
    return rows.select(
        "o_orderkey",
        "period",
        periods.is_supported_period(F.col("period")).alias("supported"),
        periods.single_year(F.col("period")).alias("single_year"),
    )


@query(
    "literal_periods",
    """WITH t AS (SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS d, year(o_orderdate) AS y, month(o_orderdate) AS m, o_orderkey % 4 AS k FROM orders)
    SELECT o_orderkey, CASE WHEN k = 0 AND d <= y || '-09-15' THEN d WHEN k = 1 AND d <= y || '-09-15' THEN d END AS start_on,
           CASE WHEN k IN (0, 1) AND d <= y || '-09-15' THEN y || '-09-15' END AS end_on FROM t""",
)
def literal_periods(spark, folder):
    """Ranges of exactly two dates; other texts stay unresolved."""
    o = read(spark, folder, "orders")
    y, key = F.year("o_orderdate"), F.col("o_orderkey")
    d, k = F.date_format("o_orderdate", "yyyy-MM-dd"), key % 4
    korean = F.concat(y, F.lit("년 "), F.month("o_orderdate"), F.lit("월 "), F.dayofmonth("o_orderdate"), F.lit("일"))
    end = F.concat(y, F.lit("-09-15"))
    literal = (
        F.when(k == 0, F.concat(d, F.lit(" ~ "), end))
        .when(k == 1, F.concat(korean, F.lit(" 부터 "), end, F.lit(" 까지")))
        .when(k == 2, F.concat(d, F.lit(" and "), end))
        .otherwise(d)
    )
    found = o.select("o_orderkey", periods.period_from_literal(literal).alias("p"))
    return found.select(
        "o_orderkey",
        F.col("p.start").cast("string").alias("start_on"),
        F.col("p.end").cast("string").alias("end_on"),
    )


# ---------------------------------------------------------------- numbers, arrays, geometry


@query(
    "amounts",
    """WITH t AS (SELECT o_orderkey, CAST(round(o_totalprice * 100) AS BIGINT) AS c, o_orderkey % 5 AS k FROM orders),
    s AS (SELECT o_orderkey, k, (c // 100) || '.' || lpad(CAST(c % 100 AS VARCHAR), 2, '0') AS plain, format('{:,}', c // 100) AS grouped FROM t)
    SELECT o_orderkey, CASE k WHEN 0 THEN replace(grouped, ',', '') WHEN 1 THEN '-' || plain
             WHEN 2 THEN replace(replace(plain, '.', ''), '.', '') || '0' || '.00' WHEN 3 THEN NULL ELSE NULL END AS normalized,
           CASE k WHEN 3 THEN 'missing' WHEN 4 THEN 'unit_unknown' ELSE 'value' END AS state FROM s""",
)
def amounts(spark, folder):
    """Grouped, parenthesised, scaled, missing and unknown-unit amounts."""
    c, k = cents("o_totalprice"), F.col("o_orderkey") % 5
    plain = F.concat(F.floor(c / 100), F.lit("."), F.lpad((c % 100).cast("string"), 2, "0"))
    grouped = F.format_number(F.floor(c / 100), 0)
    raw = (
        F.when(k == 0, grouped)
        .when(k == 1, F.concat(F.lit("("), plain, F.lit(")")))
        .when(k == 3, F.lit("-"))
        .otherwise(plain)
    )
    unit = F.when(k == 2, F.lit("천원")).when(k == 4, F.lit("달러")).otherwise(F.lit("원"))
    out = read(spark, folder, "orders").select(
        "o_orderkey", numbers.normalize_amount(raw, F.lit("KRW"), unit).alias("a")
    )
    return out.select("o_orderkey", "a.normalized", "a.state")


@query(
    "display_intervals",
    """WITH t AS (SELECT p_partkey, CAST(round(p_retailprice * 100) AS BIGINT) AS c, p_partkey % 3 AS d FROM part)
    SELECT p_partkey, round(CASE d WHEN 0 THEN c // 100 - 0.5 WHEN 1 THEN (c // 10) / 10.0 - 0.05 ELSE c / 100.0 - 0.005 END, 6) AS lo,
           round(CASE d WHEN 0 THEN c // 100 + 0.5 WHEN 1 THEN (c // 10) / 10.0 + 0.05 ELSE c / 100.0 + 0.005 END, 6) AS hi FROM t""",
)
def display_intervals(spark, folder):
    """Interval behind a price displayed with 0, 1 or 2 decimals."""
    c, d = cents("p_retailprice"), F.col("p_partkey") % 3
    tenth = F.floor(c / 10)
    shown = (
        F.when(d == 0, F.floor(c / 100).cast("string"))
        .when(d == 1, F.concat(F.floor(tenth / 10), F.lit("."), tenth % 10))
        .otherwise(F.concat(F.floor(c / 100), F.lit("."), F.lpad((c % 100).cast("string"), 2, "0")))
    )
    rows = read(spark, folder, "part").select("p_partkey", numbers.display_interval(shown).alias("i"))
    return rows.select(
        "p_partkey",
        F.round(F.col("i.lo").cast("double"), 6).alias("lo"),
        F.round(F.col("i.hi").cast("double"), 6).alias("hi"),
    )


@query(
    "set_relations",
    """WITH t AS (SELECT p_partkey, list_distinct([p_size % 4, p_size % 6, p_partkey % 3]) AS a,
                  list_distinct([p_partkey % 4, p_size % 3]) AS b FROM part)
    SELECT p_partkey, CASE WHEN list_has_all(b, a) AND list_has_all(a, b) THEN 'equal' WHEN list_has_all(b, a) THEN 'subset'
           WHEN list_has_all(a, b) THEN 'superset' WHEN list_has_any(a, b) THEN 'overlap' ELSE 'disjoint' END AS relation,
           array_to_string(list_sort(list_distinct(list_transform(a, lambda x: 'e' || x))), ',') AS entities FROM t""",
)
def set_relations(spark, folder):
    """Set relation of two small entity lists per part, and the clean entity set."""
    a = F.array(*[(c).cast("int") for c in (F.col("p_size") % 4, F.col("p_size") % 6, F.col("p_partkey") % 3)])
    b = F.array(*[(c).cast("int") for c in (F.col("p_partkey") % 4, F.col("p_size") % 3)])
    names = F.transform(a, lambda x: F.concat(F.lit(" e"), x, F.lit(" ")))
    return read(spark, folder, "part").select(
        "p_partkey",
        arrays.set_relation(a, b).alias("relation"),
        F.array_join(arrays.entity_set(names), ",").alias("entities"),
    )


@query(
    "canonical_hashes",
    """SELECT c_custkey, sha256('{"c_custkey":' || c_custkey || ',"name":"' || c_name || '","nation":' ||
              CASE WHEN c_nationkey = 3 THEN 'null' ELSE CAST(c_nationkey AS VARCHAR) END || '}') AS h FROM customer""",
)
def canonical_hashes(spark, folder):
    """Content identity of customers, nulls kept."""
    return read(spark, folder, "customer").select(
        "c_custkey",
        canonical_hash(
            nation=F.when(F.col("c_nationkey") != 3, F.col("c_nationkey")),
            c_custkey=F.col("c_custkey"),
            name=F.col("c_name"),
        ).alias("h"),
    )


@query(
    "projected_boxes",
    """WITH b AS (SELECT p_partkey, p_partkey % 500 AS x, (p_partkey * 7) % 700 AS y, 5 + p_size AS w, 3 + p_size AS h, (p_partkey % 4) * 90 AS rot FROM part),
    t AS (SELECT *, x - 10 AS l, y - 20 AS bt, x - 10 + w AS r, y - 20 + h AS tp, 600 AS cw, 800 AS ch FROM b),
    q AS (SELECT p_partkey, rot, CASE rot WHEN 0 THEN l WHEN 90 THEN bt WHEN 180 THEN cw - r ELSE ch - tp END AS x0,
           CASE rot WHEN 0 THEN ch - tp WHEN 90 THEN cw - (cw - l) WHEN 180 THEN ch - (ch - bt) ELSE cw - r END AS y0, w, h,
           CASE WHEN rot IN (0, 180) THEN cw ELSE ch END AS pw, CASE WHEN rot IN (0, 180) THEN ch ELSE cw END AS ph FROM t),
    z AS (SELECT *, x0 + CASE WHEN rot IN (0, 180) THEN w ELSE h END AS x1, y0 + CASE WHEN rot IN (0, 180) THEN h ELSE w END AS y1 FROM q)
    SELECT p_partkey, CASE WHEN x0 < 0 OR y0 < 0 OR x1 > pw OR y1 > ph THEN 'box_outside_page' END AS reason,
           CASE WHEN NOT (x0 < 0 OR y0 < 0 OR x1 > pw OR y1 > ph) THEN CAST(x0 AS DOUBLE) END AS x0,
           CASE WHEN NOT (x0 < 0 OR y0 < 0 OR x1 > pw OR y1 > ph) THEN CAST(y0 AS DOUBLE) END AS y0 FROM z""",
)
def projected_boxes(spark, folder):
    """Native boxes of parts on rotated, cropped pages."""
    key, size = F.col("p_partkey"), F.col("p_size")
    d = lambda c: c.cast("double")
    x, y = d(key % 500), d((key * 7) % 700)
    rotation = ((key % 4) * 90).cast("int")
    upright = rotation.isin(0, 180)
    crop = F.struct(
        F.lit(10.0).alias("left"), F.lit(20.0).alias("bottom"), F.lit(610.0).alias("right"), F.lit(820.0).alias("top")
    )
    page = F.struct(
        F.when(upright, 600.0).otherwise(800.0).alias("width"),
        F.when(upright, 800.0).otherwise(600.0).alias("height"),
        rotation.alias("rotation"),
        crop.alias("crop"),
    )
    rows = read(spark, folder, "part").select(
        "p_partkey", geometry.box(x, y, x + 5 + size, y + 3 + size).alias("native"), page.alias("page")
    )
    out = rows.select("p_partkey", geometry.canonical_box(F.col("native"), F.col("page")).alias("c"))
    return out.select("p_partkey", "c.reason", "c.bbox.x0", "c.bbox.y0")


# ---------------------------------------------------------------- scope, prefilter, citations


@query(
    "prefilter",
    f"""SELECT doc_id, CASE WHEN lang = 'de' THEN 'conflicted' WHEN trim(text, E' \\t\\n\\r') = '' THEN 'empty_text'
           WHEN NOT (regexp_matches(text, '(?i){text.CLAIM_SIGNAL}') OR (regexp_matches(text, '\\d') AND regexp_matches(text, '[가-힣a-zA-Z]{{2}}')))
           THEN 'no_lexical_signal' END AS reason,
           CASE WHEN lang = 'de' THEN 'conflict' WHEN trim(text, E' \\t\\n\\r') = '' THEN 'unknown'
           WHEN NOT (regexp_matches(text, '(?i){text.CLAIM_SIGNAL}') OR (regexp_matches(text, '\\d') AND regexp_matches(text, '[가-힣a-zA-Z]{{2}}')))
           THEN 'unknown' END AS state FROM documents""",
)
def prefilter(spark, folder):
    """Claim prefilter over every document."""
    quality = F.when(F.col("lang") == "de", F.lit("conflicted")).otherwise(F.lit("verified"))
    blocks = read(spark, folder, "documents").select(
        "doc_id",
        quality.alias("quality"),
        F.lit(0).alias("winner"),
        F.lit("paragraph").alias("kind"),
        F.col("text").alias("normalized_text"),
    )
    return claims.prefilter(blocks).select("doc_id", "reason", "state")


@query(
    "claim_scope",
    """SELECT conv_id, turn, CASE WHEN conv_id % 2 = 0 AND turn NOT IN (0, 2, 3) THEN 'outside_declared_subset'
           WHEN role = 'system' THEN 'unreadable' WHEN trim(text, E' \\t\\n\\r') = '' THEN 'empty_source' END AS reason,
           CASE WHEN conv_id % 2 = 0 AND turn NOT IN (0, 2, 3) THEN 'excluded' WHEN role = 'system' THEN 'unreadable'
           WHEN trim(text, E' \\t\\n\\r') = '' THEN 'unknown' END AS state FROM conversations""",
)
def claim_scope(spark, folder):
    """Turns as pages, even conversations restricted to a declared subset."""
    c = read(spark, folder, "conversations")
    blocks = c.select(
        "conv_id",
        "turn",
        F.col("turn").alias("page_num"),
        F.when(F.col("role") == "system", F.lit("unreadable")).otherwise(F.lit("verified")).alias("quality"),
        F.lit(0).alias("winner"),
        F.col("text").alias("normalized_text"),
    )
    even = F.col("conv_id") % 2 == 0
    scope = c.groupBy("conv_id").agg(F.count("*").alias("n")).select(
        "conv_id",
        F.when(even, F.lit("declared_subset")).otherwise(F.lit("full")).alias("mode"),
        F.when(even, F.array(*[F.lit(i).cast("bigint") for i in (0, 2, 3)])).alias("claim_pages"),
    )
    return claims.apply_scope(blocks, scope, ["conv_id"]).select("conv_id", "turn", "reason", "state")


_REFS = """
r AS (SELECT doc_id, text, 1 + (n_chars // 3) AS s, least(40, length(text) - n_chars // 3) AS n, doc_id % 6 AS k FROM documents WHERE n_chars > 3)
"""


def _refs(spark, folder):
    """One quote per document, some with a planted fault; and the documents as blocks."""
    docs = read(spark, folder, "documents")
    ids = [F.lit("t").alias("tenant_id"), F.lit("v").alias("document_version_id")]
    shared = [
        F.lit("m").alias("parse_manifest_id"),
        (F.col("doc_id") % 50).alias("page_num"),
        F.lit(None).cast("string").alias("printed_page_label"),
        geometry.box(F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(1.0)).alias("bbox"),
    ]
    blocks = docs.select(
        *ids,
        F.col("doc_id").alias("source_id"),
        *shared,
        F.col("text").alias("raw_text"),
        F.when(F.col("source") == "src3", F.lit("unverified")).otherwise(F.lit("verified")).alias("quality"),
        F.lit(0).alias("winner"),
        F.lit("paragraph").alias("kind"),
    )
    k, start = F.col("doc_id") % 6, F.floor(F.col("n_chars") / 3).cast("int")
    size = F.least(F.lit(40), F.length("text") - start)
    raw = F.substring(F.col("text"), start + 1, size)
    quote = F.when(k == 1, F.regexp_replace(raw, " ", "  ")).when(k == 2, F.concat(raw, F.lit("~"))).otherwise(raw)
    refs = docs.filter("n_chars > 3").select(
        F.col("doc_id").alias("ref_id"),
        *ids,
        F.col("doc_id").alias("source_id"),
        *shared[:1],
        (F.col("doc_id") % 50 + F.when(k == 3, 1).otherwise(0)).alias("page_num"),
        *shared[2:],
        F.when(k == 4, F.lit("0")).otherwise(F.sha2("text", 256)).alias("raw_text_sha256"),
        quote.alias("quote"),
        start.alias("char_start"),
        (start + size).alias("char_end"),
        F.when(k == 5, F.lit("unlocated")).otherwise(F.lit("located")).alias("location_quality"),
    )
    return refs, blocks


@query(
    "verify_refs",
    f"""WITH {_REFS},
    q AS (SELECT r.doc_id, k, d.source, trim(regexp_replace(substr(r.text, s, n), '\\s+', ' ', 'g')) = '' AS blank FROM r JOIN documents d USING (doc_id))
    SELECT doc_id AS ref_id, CASE WHEN k = 5 THEN 'not_located' WHEN source = 'src3' THEN 'source_quality' WHEN k = 3 THEN 'page_mismatch'
           WHEN k = 4 THEN 'text_hash_mismatch' WHEN k = 2 OR blank THEN 'quote_mismatch' END AS reason,
           CASE WHEN k IN (2, 3, 4, 5) OR source = 'src3' OR blank THEN 'rejected' ELSE 'verified' END AS verification_state FROM q""",
)
def verify_refs(spark, folder):
    """Quotes checked against their document; blanks may differ, text may not."""
    refs, blocks = _refs(spark, folder)
    return claims.verify_refs(refs, blocks).select("ref_id", "reason", "verification_state")


@query(
    "verify_spans",
    f"""WITH {_REFS},
    q AS (SELECT r.doc_id, k, d.source, n, trim(regexp_replace(substr(r.text, s, n), '\\s+', ' ', 'g')) = '' AS blank FROM r JOIN documents d USING (doc_id))
    SELECT doc_id AS ref_id, CASE WHEN k IN (2, 3, 4, 5) OR blank THEN NULL WHEN source <> 'src3' THEN 'block'
           WHEN n >= 40 THEN 'span' END AS verified_by FROM q""",
)
def verify_spans(spark, folder):
    """Quotes of unverified documents admitted only inside an attested span."""
    refs, blocks = _refs(spark, folder)
    docs = read(spark, folder, "documents").filter("source = 'src3'")
    start = F.greatest(F.lit(0), F.floor(F.col("n_chars") / 3).cast("int") - 10)
    end = F.floor(F.col("n_chars") / 3).cast("int") + 40
    spans = docs.filter(F.length("text") >= end).select(
        F.lit("t").alias("tenant_id"),
        F.lit("v").alias("document_version_id"),
        F.col("doc_id").alias("source_id"),
        F.lit("m").alias("parse_manifest_id"),
        (F.col("doc_id") % 50).alias("page_num"),
        F.lit(None).cast("string").alias("printed_page_label"),
        geometry.box(F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(1.0)).alias("bbox"),
        F.sha2("text", 256).alias("raw_text_sha256"),
        F.substring(F.col("text"), start + 1, end - start).alias("quote"),
        start.alias("char_start"),
        end.alias("char_end"),
        F.lit("located").alias("location_quality"),
        F.lit("verified").alias("verification_state"),
    )
    return claims.verify_spans(refs, blocks, spans).select("ref_id", "verified_by")


@query(
    "external_match",
    """WITH d AS (SELECT doc_id, text FROM documents),
    h AS (SELECT b.item_id, d.doc_id FROM benchmark b JOIN d ON contains(d.text, b.text)),
    r AS (SELECT item_id, count(*) AS n, min(doc_id) AS doc_id FROM h GROUP BY 1),
    c AS (SELECT doc_id, count(*) AS n FROM h GROUP BY 1)
    SELECT b.item_id, coalesce(r.n, 0) AS n_claims, CASE WHEN r.n = 1 AND c.n = 1 THEN r.doc_id END AS doc_id,
           CASE WHEN r.n IS NULL THEN 'no_match' WHEN r.n > 1 THEN 'several_claims' WHEN c.n > 1 THEN 'several_rows' ELSE 'matched' END AS status
    FROM benchmark b LEFT JOIN r USING (item_id) LEFT JOIN c ON c.doc_id = r.doc_id""",
)
def external_match(spark, folder):
    """Benchmark passages found verbatim in exactly one document."""
    rows = read(spark, folder, "benchmark").select("item_id", F.col("text").alias("quote"))
    docs = read(spark, folder, "documents").select("doc_id", "text")
    return claims.match_external(rows, docs, [], "item_id", "doc_id").select(
        "item_id", "n_claims", "doc_id", "status"
    )


@query(
    "unique_quotes",
    """WITH q AS (SELECT conv_id, turn, text, substr(text, 1 + turn, 6) AS quote FROM conversations),
    f AS (SELECT *, instr(text, quote) AS a FROM q)
    SELECT conv_id, turn, quote, CASE WHEN trim(quote, E' \\t\\n\\r') <> '' AND a > 0 AND instr(substr(text, a + 1), quote) = 0 THEN a - 1 END AS char_start FROM f""",
)
def unique_quotes(spark, folder):
    """Location of a short quote where it occurs exactly once."""
    c = read(spark, folder, "conversations").withColumn(
        "quote", F.substring(F.col("text"), (F.col("turn") + 1).cast("int"), F.lit(6))
    )
    return c.select(
        "conv_id", "turn", "quote", text.locate_unique(F.col("text"), F.col("quote")).cast("bigint").alias("char_start")
    )


# ---------------------------------------------------------------- spans

_SPANS = """
s AS (SELECT conv_id, turn, text, unnest(generate_series(0, length(text) - 8, 10)) AS a FROM conversations WHERE length(text) >= 8),
p AS (SELECT conv_id, turn, text, a, a + 4 + (a // 10 * 7 + turn) % 9 AS e0 FROM s),
k AS (SELECT conv_id, turn, text, a, least(e0, length(text)) AS e FROM p)
"""


def _spans(spark, folder):
    c = read(spark, folder, "conversations")
    starts = c.filter(F.length("text") >= 8).select(
        "conv_id", "turn", "text", F.explode(F.sequence(F.lit(0), F.length("text") - 8, F.lit(10))).alias("char_start")
    )
    size = 4 + (F.floor(F.col("char_start") / 10) * 7 + F.col("turn")) % 9
    return c, starts.select(
        "conv_id",
        "turn",
        "char_start",
        F.least(F.col("char_start") + size, F.length("text")).cast("int").alias("char_end"),
    )


@query(
    "span_overlap",
    f"""WITH {_SPANS} SELECT conv_id, turn, a AS char_start, coalesce(max(e) OVER (PARTITION BY conv_id, turn ORDER BY a, e
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > a, false) AS overlaps FROM k""",
)
def span_overlap(spark, folder):
    _, spans = _spans(spark, folder)
    return (
        claims.flag_overlaps(spans, ["conv_id", "turn"])
        .select("conv_id", "turn", F.col("char_start").cast("bigint").alias("char_start"), "overlaps")
    )


@query(
    "span_gaps",
    f"""WITH {_SPANS}, g AS (
      SELECT conv_id, turn, text, coalesce(lag(e) OVER (PARTITION BY conv_id, turn ORDER BY a, e), 0) AS lo, a AS hi FROM k
      UNION ALL SELECT c.conv_id, c.turn, c.text, coalesce(max(k.e), 0), length(c.text) FROM conversations c LEFT JOIN k USING (conv_id, turn) GROUP BY ALL)
    SELECT conv_id, turn, lo AS char_start, hi AS char_end FROM g WHERE lo < hi AND trim(substr(text, lo + 1, hi - lo), E' \\t\\n\\r') <> ''""",
)
def span_gaps(spark, folder):
    """Text of every turn that no span covers."""
    texts, spans = _spans(spark, folder)
    out = claims.uncovered_spans(texts, spans, ["conv_id", "turn"])
    return out.select(
        "conv_id", "turn", F.col("char_start").cast("bigint").alias("char_start"), F.col("char_end").cast("bigint").alias("char_end")
    )


@query(
    "span_containment",
    f"""WITH {_SPANS}, o AS (SELECT conv_id, turn, unnest(generate_series(0, length(text) - 30, 25)) AS oa FROM conversations WHERE length(text) >= 30)
    SELECT k.conv_id, k.turn, k.a AS char_start, o.oa AS outer_start FROM k JOIN o ON k.conv_id = o.conv_id AND k.turn = o.turn
      AND o.oa <= k.a AND k.e <= o.oa + 30 AND k.a < k.e""",
)
def span_containment(spark, folder):
    """Spans inside sliding 30-character windows of the same turn."""
    texts, spans = _spans(spark, folder)
    outer = texts.filter(F.length("text") >= 30).select(
        "conv_id", "turn", F.explode(F.sequence(F.lit(0), F.length("text") - 30, F.lit(25))).alias("outer_start")
    ).withColumn("outer_end", F.col("outer_start") + 30)
    out = claims.contained_in(spans, outer, ["conv_id", "turn"])
    return out.select(
        "conv_id", "turn", F.col("char_start").cast("bigint").alias("char_start"), F.col("outer_start").cast("bigint").alias("outer_start")
    )


@query(
    "neighbour_context",
    """SELECT conv_id, turn, lag(turn) OVER w AS previous_id, lead(turn) OVER w AS next_id,
              last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS heading_id
       FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""",
)
def neighbour_context(spark, folder):
    """Previous, next and last user turn of every turn."""
    c = read(spark, folder, "conversations").select(
        "conv_id", "turn", F.when(F.col("role") == "user", F.lit("heading")).otherwise(F.lit("paragraph")).alias("kind")
    )
    out = claims.neighbour_context(c, ["conv_id"], ["turn"], "turn", bucket=F.floor(F.col("turn") / 2))
    return out.drop("kind")


@query(
    "islands",
    """WITH n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS pos,
                   row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS pos2 FROM events),
    r AS (SELECT user_id, event_type, min(event_id) AS first_position, max(event_id) AS last_position, count(*) AS n
          FROM n GROUP BY user_id, event_type, pos - pos2)
    SELECT user_id, event_type, first_position, last_position, n FROM r WHERE n = 2""",
)
def islands(spark, folder):
    """Runs of exactly two equal consecutive events of a user."""
    e = read(spark, folder, "events").select(
        "user_id",
        F.col("event_id").alias("position"),
        "event_type",
        F.lit(2).cast("bigint").alias("disclosed"),
        F.col("event_type").alias("text"),
    )
    out = layout.row_islands(e, ["user_id"], ["position"], "event_type", bucket=F.floor(F.col("position") / 1000))
    return out.select("user_id", "event_type", "first_position", "last_position", "n")


# ---------------------------------------------------------------- sections, lines

_TITLES = {
    "1-URGENT": "Environmental data",
    "2-HIGH": "Appendix",
    "3-MEDIUM": "Governance overview",
    "4-NOT SPECIFIED": "Miscellany",
    "5-LOW": "Climate action",
}
_TITLE_ROLES = {
    "1-URGENT": "e_narrative",
    "2-HIGH": "appendix",
    "3-MEDIUM": "other",
    "4-NOT SPECIFIED": "unknown",
    "5-LOW": "e_narrative",
}
_ROLE_SQL = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _TITLE_ROLES.items())
_SECTIONS = f"""
a AS (SELECT o_custkey, month(o_orderdate) AS page, CASE o_orderpriority {_ROLE_SQL} END AS role,
             CASE o_orderstatus WHEN 'O' THEN 'outline' WHEN 'F' THEN 'large_heading_fallback' ELSE 'toc_links' END AS method FROM orders),
x AS (SELECT o_custkey, page, bool_or(method <> 'large_heading_fallback' AND role <> 'unknown') AS explicit FROM a GROUP BY ALL),
r AS (SELECT a.o_custkey, a.page, count(DISTINCT role) AS n, min(role) AS role FROM a JOIN x USING (o_custkey, page)
      WHERE NOT (explicit AND method = 'large_heading_fallback' AND role = 'unknown') GROUP BY ALL),
s AS (SELECT o_custkey, page, CASE WHEN n = 1 THEN role ELSE 'conflict' END AS role FROM r
      UNION ALL SELECT DISTINCT o_custkey, 1, 'unknown' FROM a WHERE o_custkey NOT IN (SELECT o_custkey FROM a WHERE page = 1)),
t AS (SELECT o_custkey, page AS start_page, coalesce(lead(page) OVER (PARTITION BY o_custkey ORDER BY page) - 1, 12) AS end_page, role FROM s)
"""


def _sections(spark, folder):
    o = read(spark, folder, "orders")
    names = F.create_map(*[F.lit(x) for pair in _TITLES.items() for x in pair])
    status = F.col("o_orderstatus")
    method = (
        F.when(status == "O", F.lit("outline"))
        .when(status == "F", F.lit("large_heading_fallback"))
        .otherwise(F.lit("toc_links"))
    )
    anchors = o.select(
        "o_custkey",
        F.month("o_orderdate").alias("page"),
        F.array(names[F.col("o_orderpriority")]).alias("path"),
        method.alias("method"),
    )
    documents = o.select("o_custkey").distinct().withColumn("page_count", F.lit(12))
    return layout.section_ranges(anchors, documents, ["o_custkey"])


@query(
    "section_ranges",
    f"WITH {_SECTIONS} SELECT o_custkey, CAST(start_page AS BIGINT) AS start_page, CAST(end_page AS BIGINT) AS end_page, role FROM t",
)
def section_ranges(spark, folder):
    """Sections of twelve-page documents from titled anchors."""
    out = _sections(spark, folder)
    return out.select(
        "o_custkey", F.col("start_page").cast("bigint").alias("start_page"), F.col("end_page").cast("bigint").alias("end_page"), "role"
    )


@query(
    "section_pages",
    f"""WITH {_SECTIONS} SELECT o_custkey, CAST(unnest(generate_series(start_page, end_page)) AS BIGINT) AS page_num, role,
         role IN ('e_narrative', 'esg_data', 'appendix') AS evidence_candidate FROM t""",
)
def section_pages(spark, folder):
    out = layout.section_pages(_sections(spark, folder), ["o_custkey"])
    return out.select("o_custkey", F.col("page_num").cast("bigint").alias("page_num"), "role", "evidence_candidate")


@query(
    "boilerplate_lines",
    r"""WITH l AS (SELECT DISTINCT source, doc_id, regexp_replace(replace(lower(unnest(string_split(text, chr(10)))), 'ß', 'ss'), '[\s\d]+', '', 'g') AS line FROM documents)
    SELECT source, line, count(*) AS n_pages FROM l WHERE line <> '' GROUP BY ALL HAVING count(*) >= 2""",
)
def boilerplate_lines(spark, folder):
    """Lines repeated over several documents of one source."""
    lines = read(spark, folder, "documents").select(
        "source",
        F.col("doc_id").alias("page_num"),
        F.explode(F.split("text", "\n")).alias("text"),
        F.lit(0.0).alias("top"),
        F.lit(1.0).alias("bottom"),
        F.lit(100.0).alias("page_height"),
    )
    return layout.boilerplate_lines(lines, ["source"])


@query(
    "note_groups",
    r"""WITH l AS (SELECT conv_id, turn, regexp_matches(text, '^[A-E]') AS s FROM conversations)
    SELECT conv_id, turn, CAST(sum(CASE WHEN s THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS note_no FROM l""",
)
def note_groups(spark, folder):
    """Turns attached to the last turn that opens a note."""
    c = read(spark, folder, "conversations").select("conv_id", "turn", "text")
    out = layout.note_groups(c, ["conv_id"], ["turn"], "^[A-E]", bucket=F.floor(F.col("turn") / 3))
    return out.select("conv_id", "turn", F.col("note_no").cast("bigint").alias("note_no"))


@query(
    "interleave",
    """WITH r AS (SELECT o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice DESC, o_orderkey) AS rn,
                    CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS k FROM orders)
    SELECT o_orderkey, o_orderstatus FROM r ORDER BY rn, k LIMIT 100""",
)
def interleave(spark, folder):
    """Best orders of the three statuses in turn, one hundred in all."""
    o = read(spark, folder, "orders").select("o_orderkey", "o_orderstatus", (-F.col("o_totalprice")).alias("p"))
    return layout.interleave(o, "o_orderstatus", ["F", "O", "P"], ["p", "o_orderkey"], 100).drop("p")


@query(
    "claim_listing",
    """SELECT o_orderkey AS claim_id, o_custkey AS source_id, year(o_orderdate) AS page_num FROM orders
       WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'""",
)
def claim_listing(spark, folder):
    """Claims of one grade and review status in stable order."""
    rows = read(spark, folder, "orders").select(
        F.col("o_orderkey").alias("claim_id"),
        F.col("o_custkey").alias("source_id"),
        F.year("o_orderdate").cast("bigint").alias("page_num"),
        F.lit(0).alias("char_start"),
        F.col("o_orderstatus").alias("evidence_grade"),
        F.col("o_orderpriority").alias("review_status"),
    )
    listed = claims.list_claims(rows, grade="F", review_status="1-URGENT")
    return claims.order_claims(listed).select("claim_id", "source_id", "page_num")


@query(
    "claim_page",
    """SELECT o_custkey, o_orderkey FROM orders WHERE (o_custkey, o_orderkey) > (20, 1000) ORDER BY o_custkey, o_orderkey LIMIT 50""",
)
def claim_page(spark, folder):
    """Second page of a listing by keyset."""
    scope = dict(tenant_id="t", endpoint="claims", query_hash="h", epoch=1)
    rows = read(spark, folder, "orders").select("o_custkey", "o_orderkey")
    token = claims.page_token("t", "claims", "h", 1, [20, 1000])
    return claims.page(rows, ["o_custkey", "o_orderkey"], token, 50, **scope)


# ---------------------------------------------------------------- lineage, boxes, cells


@query(
    "lineage_closure",
    """WITH RECURSIVE e AS (SELECT p_partkey AS s, p_partkey // 10 AS t FROM part WHERE p_partkey > 0),
    c AS (SELECT s, t FROM e UNION SELECT c.s, e.t FROM c JOIN e ON e.s = c.t)
    SELECT s AS source_id, t AS ancestor_id FROM c""",
)
def lineage_closure(spark, folder):
    """All ancestors in the tree of part numbers (parent = number / 10)."""
    p = read(spark, folder, "part").filter("p_partkey > 0")
    edges = p.select(
        F.lit("d").alias("doc"),
        F.col("p_partkey").alias("source_id"),
        F.floor(F.col("p_partkey") / 10).alias("target_id"),
        F.lit("table_parent").alias("relation"),
    )
    return lineage.ancestors(edges, doc=["doc"]).select("source_id", "ancestor_id")


_BOXES = """
b AS (SELECT p_partkey, p_partkey // 50 AS page_num, CAST((p_partkey * 13) % 31 AS DOUBLE) AS x0, CAST((p_partkey * 29) % 23 AS DOUBLE) AS y0,
             CAST(20 + p_size % 5 AS DOUBLE) AS w, CAST(15 + p_size % 3 AS DOUBLE) AS h FROM part)
"""


def _boxes(spark, folder):
    key, size = F.col("p_partkey"), F.col("p_size")
    x0, y0 = ((key * 13) % 31).cast("double"), ((key * 29) % 23).cast("double")
    w, h = (20 + size % 5).cast("double"), (15 + size % 3).cast("double")
    return read(spark, folder, "part").select(
        F.col("p_partkey").alias("candidate_id"),
        F.floor(key / 50).alias("page_num"),
        geometry.box(x0, y0, x0 + w, y0 + h).alias("bbox"),
    )


@query(
    "iou_pairs",
    f"""WITH {_BOXES}, d AS (SELECT page_num, x0, y0, w, h, min(p_partkey) AS id, count(*) AS n FROM b GROUP BY ALL),
    p AS (SELECT a.page_num, a.id AS left_id, c.id AS right_id, a.n AS left_n, c.n AS right_n,
            greatest(0, least(a.x0 + a.w, c.x0 + c.w) - greatest(a.x0, c.x0)) * greatest(0, least(a.y0 + a.h, c.y0 + c.h) - greatest(a.y0, c.y0)) AS i,
            a.w * a.h + c.w * c.h AS s FROM d a JOIN d c ON a.page_num = c.page_num AND a.id < c.id)
    SELECT page_num, left_id, right_id, left_n, right_n, round(i / (s - i), 6) AS iou FROM p WHERE i / (s - i) >= 0.8""",
)
def iou_pairs(spark, folder):
    """Overlapping boxes of parts laid out fifty to a page."""
    out = layout.iou_pairs(_boxes(spark, folder), ["page_num"])
    return out.withColumn("iou", F.round("iou", 6))


@query(
    "nearest_blocks",
    f"""WITH {_BOXES}, q AS (SELECT p_partkey, page_num, x0, y0, x0 + w AS x1, y0 + h AS y1 FROM b),
    r AS (SELECT a.page_num, a.p_partkey AS query_id, c.p_partkey AS source_id,
            round(abs((a.x0 + a.x1) / 2 - (c.x0 + c.x1) / 2) + abs((a.y0 + a.y1) / 2 - (c.y0 + c.y1) / 2), 6) AS distance,
            c.x0, c.y0, c.x1, c.y1 FROM q a JOIN q c ON a.page_num = c.page_num AND a.p_partkey <> c.p_partkey),
    k AS (SELECT *, row_number() OVER (PARTITION BY page_num, query_id ORDER BY distance, x0, y0, x1, y1, source_id) AS rank FROM r)
    SELECT page_num, query_id, source_id, rank, distance FROM k WHERE rank <= 2""",
)
def nearest_blocks(spark, folder):
    """Two nearest boxes of every box on its page."""
    b = _boxes(spark, folder)
    blocks = b.select(
        "page_num",
        F.col("candidate_id").alias("source_id"),
        "bbox",
        F.lit("verified").alias("quality"),
        F.lit(0).alias("winner"),
        F.lit("paragraph").alias("kind"),
        F.lit("text").alias("raw_text"),
    )
    wanted = b.select("page_num", F.col("candidate_id").alias("query_id"), "bbox", F.array("candidate_id").alias("exclude"))
    out = layout.nearest_blocks(wanted, blocks, ["page_num"])
    return out.withColumns({"rank": F.col("rank").cast("bigint"), "distance": F.round("distance", 6)})


_CELLS = """
c AS (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS i FROM part),
k AS (SELECT p_brand, CAST(i // 6 AS BIGINT) AS r, CAST(i % 6 AS BIGINT) AS col, p_partkey AS id,
             CASE WHEN i = 0 THEN 2 ELSE 1 END AS rs, CASE WHEN i % 6 = 5 THEN 2 ELSE 1 END AS cs FROM c WHERE NOT i = 6)
"""


def _cells(spark, folder):
    """Parts of a brand laid out as a table of six columns with a two-row corner."""
    from claimgrove.operators.ordered import numbered

    p = numbered(read(spark, folder, "part").select("p_brand", "p_partkey"), ["p_brand"], ["p_partkey"], "i",
                 F.floor(F.col("p_partkey") / 500)).withColumn("i", F.col("i") - 1)
    i = F.col("i")
    return p.filter("i <> 6").select(
        "p_brand",
        F.col("p_partkey").alias("source_id"),
        F.floor(i / 6).cast("int").alias("row_number"),
        (i % 6).cast("int").alias("column_number"),
        F.when(i == 0, 2).otherwise(1).alias("row_span"),
        F.when(i % 6 == 5, 2).otherwise(1).alias("column_span"),
        F.col("p_partkey").cast("string").alias("text"),
    )


@query(
    "axis_roles",
    f"""WITH {_CELLS}, h AS (SELECT p_brand, min(r) AS fr, min(col) AS fc, arg_min(rs, (r, col)) AS depth FROM k GROUP BY 1),
    s AS (SELECT k.p_brand, col FROM k JOIN h USING (p_brand) WHERE r = fr AND rs = depth UNION SELECT p_brand, fc FROM h)
    SELECT f.p_brand, f.id AS source_id, o.id AS axis_id, CASE WHEN f.col >= o.col AND f.col + f.cs <= o.col + o.cs AND o.r + o.rs <= f.r AND o.r + o.rs <= fr + depth THEN 'column_header'
           WHEN o.col IN (SELECT col FROM s WHERE s.p_brand = o.p_brand) THEN 'row_header' ELSE 'row_qualifier' END AS role
    FROM k f JOIN k o ON o.p_brand = f.p_brand AND o.id <> f.id JOIN h ON h.p_brand = f.p_brand
    WHERE (f.col >= o.col AND f.col + f.cs <= o.col + o.cs AND o.r + o.rs <= f.r AND o.r + o.rs <= fr + depth)
       OR (o.r <= f.r AND f.r + f.rs <= o.r + o.rs AND o.col + o.cs <= f.col)""",
)
def axis_roles(spark, folder):
    """Row and column headers of every cell."""
    return layout.table_axes(_cells(spark, folder), ["p_brand"]).select("p_brand", "source_id", "axis_id", "role")


@query(
    "band_order",
    """WITH b AS (SELECT p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS band, CAST(p_size * 3 AS DOUBLE) AS lo, CAST(p_size * 3 + p_size % 4 AS DOUBLE) AS hi FROM part)
    SELECT p_brand, band, CASE WHEN hi <= lo THEN 'degenerate_band' WHEN lo + 0.001 < lag(hi) OVER (PARTITION BY p_brand ORDER BY band) THEN 'band_overlap_or_disorder' END AS reason FROM b""",
)
def band_order(spark, folder):
    """Order proof of bands built from part sizes."""
    from claimgrove.operators.ordered import numbered

    p = numbered(read(spark, folder, "part").select("p_brand", "p_partkey", "p_size"), ["p_brand"], ["p_partkey"], "band",
                 F.floor(F.col("p_partkey") / 500))
    bands = p.select(
        "p_brand",
        "band",
        (F.col("p_size") * 3).cast("double").alias("lo"),
        (F.col("p_size") * 3 + F.col("p_size") % 4).cast("double").alias("hi"),
    )
    return layout.check_bands(bands, ["p_brand"]).select("p_brand", "band", "reason")


@query(
    "cell_fragments",
    """WITH c AS (SELECT o_custkey, o_orderkey, o_orderpriority AS t FROM orders),
    f AS (SELECT o_custkey, o_orderpriority AS t, o_orderkey, o_orderstatus = 'P' AS clipped FROM orders WHERE o_orderstatus <> 'F'),
    cn AS (SELECT o_custkey, t, count(*) AS n FROM c GROUP BY ALL),
    fn AS (SELECT o_custkey, t, count(*) AS n, count(*) FILTER (NOT clipped) AS u, min(o_orderkey) FILTER (NOT clipped) AS id FROM f GROUP BY ALL)
    SELECT c.o_orderkey, CASE WHEN coalesce(u, 0) = 0 THEN 'not_found' WHEN u = 1 AND cn.n = 1 AND fn.n = 1 THEN 'unique_proposal' ELSE 'ambiguous' END AS status,
           CASE WHEN u = 1 AND cn.n = 1 AND fn.n = 1 THEN id END AS fragment_id
    FROM c JOIN cn USING (o_custkey, t) LEFT JOIN fn USING (o_custkey, t)""",
)
def cell_fragments(spark, folder):
    """Unique text matches between cells and layout fragments of a customer."""
    o = read(spark, folder, "orders")
    cells = o.select("o_custkey", "o_orderkey", F.col("o_orderpriority").alias("text"))
    fragments = o.filter("o_orderstatus <> 'F'").select(
        "o_custkey",
        F.col("o_orderkey").alias("fragment_id"),
        F.col("o_orderpriority").alias("text"),
        (F.col("o_orderstatus") == "P").alias("clipped"),
    )
    return layout.match_cells(cells, fragments, ["o_custkey"]).select("o_orderkey", "status", "fragment_id")


_GRIDS = """
e AS (SELECT DISTINCT o_custkey, o_orderpriority AS label, year(o_orderdate) AS y, CAST(o_orderkey % 3 AS VARCHAR) AS v FROM orders WHERE o_orderstatus <> 'P'),
c AS (SELECT DISTINCT o_custkey, o_orderpriority AS label, year(o_orderdate) AS y, CAST(o_orderkey % 2 AS VARCHAR) AS v FROM orders WHERE o_orderstatus <> 'F'),
eg AS (SELECT o_custkey, label, y, count(*) AS n, list_sort(list(v)) AS vs FROM e GROUP BY ALL),
cg AS (SELECT o_custkey, label, y, count(*) AS n, list_sort(list(v)) AS vs FROM c GROUP BY ALL)
"""


@query(
    "compare_grids",
    f"""WITH {_GRIDS} SELECT o_custkey, label, CAST(y AS VARCHAR) AS year, eg.n IS NOT NULL AND cg.n IS NOT NULL AS shared,
           coalesce(eg.vs = cg.vs AND eg.n = 1 AND cg.n = 1, false) AS equal, coalesce(eg.vs <> cg.vs, false) AS differing,
           coalesce(eg.n <> 1 OR cg.n <> 1, false) AND eg.n IS NOT NULL AND cg.n IS NOT NULL AS ambiguous
    FROM eg FULL JOIN cg USING (o_custkey, label, y)""",
)
def compare_grids(spark, folder):
    """Literal overlap of two reviewed readings per customer."""
    o = read(spark, folder, "orders")
    cell = lambda m: [
        "o_custkey",
        F.col("o_orderpriority").alias("label"),
        F.lit("").alias("unit"),
        F.year("o_orderdate").cast("string").alias("year"),
        (F.col("o_orderkey") % m).cast("string").alias("value"),
    ]
    out = layout.compare_grids(
        o.filter("o_orderstatus <> 'P'").select(*cell(3)), o.filter("o_orderstatus <> 'F'").select(*cell(2)), ["o_custkey"]
    )
    return out.drop("unit")
