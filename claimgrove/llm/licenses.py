"""Licence scan by canonical digests.

A text and every line of it are brought to one canonical form: A-Z lower-cased, copyright clauses (mark,
years and holder, up to the end of the line or to a notice on it) dropped, punctuation and white space reduced to single blanks, equivalent spellings
unified. The SHA-256 of the whole canonical text is hash-joined with the digests of known licences.
The digests of its lines are intersected with the same digests inside the row, so a
text is read once and no row needs a number. The table of known texts is a parameter; its size is that of a
list of licences (at most `MOST`), not of the corpus. `license_texts` holds the list.

Null text counts as empty and matches nothing. Repeated rows are ordinary rows; null ids
keep their row; an empty table gives an empty result; other columns are ignored. A very long text is one row
with an array of its lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimgrove.llm.common import LOWER, UPPER, text_or_empty
from claimgrove.llm.license_texts import KNOWN

# Spellings that count as one, each with the blank before it (fixed values).
EQUIVALENT = (
    (" licence", " license"),
    (" sub license", " sublicense"),
    (" sublicence", " sublicense"),
    (" organisation", " organization"),
    (" authoris", " authoriz"),
    (" recognis", " recogniz"),
    (" favour", " favor"),
    (" behaviour", " behavior"),
    (" non commercial", " noncommercial"),
    (" copyright owner", " copyright holder"),
)
# A mark at the start of a line, years and holder; where a notice follows, the clause ends before it.
NOTICE_STARTS = "all rights |licensed |released |distributed |permission |redistribution |this |used under "
CLAUSE = rf"^[ \t]*(?:copyright\b|\(c\)|©)[^\n]*?(?:[.,;]?[ \t]+((?:{NOTICE_STARTS})[^\n]*))?$"
# Known digests at most.
MOST = 20_000
PUNCTUATION = r"[ \t\x0B\x0C\r!-/:-@\[-`{-~‘-‟–—]+"


def canonical_lines(text: Column) -> Column:
    """Array of non-empty canonical lines."""
    # The blank before every line lets the spellings match at its start.
    plain = F.regexp_replace(F.translate(text, UPPER, LOWER), "(?m)" + CLAUSE, "$1")
    plain = F.concat(F.lit(" "), F.regexp_replace(plain, PUNCTUATION, " "))
    plain = F.replace(plain, F.lit("\n"), F.lit(" \n "))
    plain = F.replace(plain, F.lit("  "), F.lit(" "))
    for spelling, unified in EQUIVALENT:
        plain = F.replace(plain, F.lit(spelling), F.lit(unified))
    return F.array_remove(F.split(F.trim(plain), r"[ ]*\n[ \n]*"), "")


def known_digests(spark: SparkSession, known: tuple[tuple[str, str], ...] = KNOWN) -> DataFrame:
    """license_id and the digest of its canonical form; equal forms share the first id."""
    rows = spark.createDataFrame(list(known), "license_id string, text string")
    return rows.groupBy(digest(canonical_lines(F.col("text"))).alias("digest")).agg(
        F.min("license_id").alias("license_id")
    )


def digest(lines: Column) -> Column:
    return F.sha2(F.array_join(lines, " ").cast("binary"), 256)


def scan_licenses(
    docs: DataFrame, known: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, canonical_sha256, license_id of the whole text (or null), n_notices, notices.

    `notices` names the licences found as whole lines, in order and joined by commas, or is null.
    """
    known = known_digests(docs.sparkSession) if known is None else known
    listed = known.select("digest", "license_id").take(MOST + 1)
    if len(listed) > MOST:
        raise ValueError(f"more than {MOST} known licences")
    names = F.create_map(*(F.lit(v) for r in listed for v in r)) if listed else F.expr("map('', '')")
    digests = F.array(*(F.lit(r["digest"]) for r in listed)).cast("array<string>")
    lines = docs.select(
        docs[id_col].alias("doc_id"), canonical_lines(text_or_empty(docs[text_col])).alias("lines")
    )
    hashed = lines.select(
        "doc_id",
        digest(F.col("lines")).alias("canonical_sha256"),
        F.transform("lines", lambda x: F.sha2(x.cast("binary"), 256)).alias("line_digests"),
    )
    found = hashed.withColumn("found", F.array_intersect("line_digests", digests))
    ids = F.array_distinct(F.transform("found", lambda d: F.element_at(names, d)))
    some = F.size("found") > 0
    hits = F.filter("line_digests", lambda d: F.array_contains(F.col("found"), d))
    return found.join(F.broadcast(known), F.col("canonical_sha256") == known["digest"], "left").select(
        "doc_id",
        "canonical_sha256",
        "license_id",
        F.when(some, F.size(hits)).otherwise(0).cast("bigint").alias("n_notices"),
        F.when(some, F.array_join(F.array_sort(ids), ",")).alias("notices"),
    )


def licenses_sql() -> str:
    def quoted(text: str) -> str:
        return "'" + text.replace("'", "''") + "'"

    replaced = "plain"
    for spelling, unified in EQUIVALENT:
        replaced = f"replace({replaced}, '{spelling}', '{unified}')"
    values = ", ".join(f"({quoted(i)}, {quoted(t)})" for i, t in KNOWN)
    return rf"""
    WITH known AS (SELECT * FROM (VALUES {values}) AS v(license_id, text)),
    raw AS (
      SELECT 'd' AS kind, doc_id, NULL AS license_id, coalesce(text, '') AS text, row_number() OVER () AS r
      FROM documents
      UNION ALL SELECT 'k', NULL, license_id, text, -row_number() OVER () FROM known),
    lined AS (
      SELECT kind, doc_id, license_id, r, unnest(string_split(
               translate(text, '{UPPER}', '{LOWER}'), chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i
      FROM raw),
    spaced AS (
      SELECT * EXCLUDE (line), ' ' || regexp_replace(regexp_replace(line, '{CLAUSE}', '\1'),
               '[ \t\x0B\x0C\r!-/:-@\[-`{{-~\x{{2018}}-\x{{201F}}\x{{2013}}\x{{2014}}]+', ' ', 'g') || ' ' AS plain
      FROM lined),
    lines AS (
      SELECT kind, doc_id, license_id, r, i, trim({replaced.replace("plain", "replace(plain, '  ', ' ')", 1)}, ' ') AS line
      FROM spaced),
    texts AS (
      SELECT kind, r, any_value(license_id) AS license_id,
             string_agg(line, ' ' ORDER BY i) AS whole FROM lines WHERE line <> '' GROUP BY kind, r),
    digests AS (
      SELECT sha256(whole) AS d, min(license_id) AS license_id FROM texts WHERE kind = 'k' GROUP BY 1),
    hits AS (
      SELECT r, count(*) AS n_notices, string_agg(DISTINCT digests.license_id, ',' ORDER BY digests.license_id) AS notices
      FROM lines JOIN digests ON sha256(line) = d WHERE kind = 'd' AND line <> '' GROUP BY r)
    SELECT raw.doc_id, sha256(coalesce(whole, '')) AS canonical_sha256, digests.license_id,
           coalesce(n_notices, 0) AS n_notices, notices
    FROM raw LEFT JOIN texts ON texts.r = raw.r
    LEFT JOIN digests ON d = sha256(coalesce(whole, '')) LEFT JOIN hits ON hits.r = raw.r
    WHERE raw.kind = 'd'
    """
