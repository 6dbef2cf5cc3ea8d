"""Quality rules whose cutoffs are certified on labelled holdouts.

Text statistics are column expressions. A rule rejects a document when its statistic exceeds a
cutoff. For every stratum (a band of word counts), rule and candidate cutoff, the labelled
good documents it would reject are counted; a cutoff is certified when the exact
binomial tail P(Bin(n, a) <= k) stays within d / m: `a` is the allowed false rejection
divided among the rules (so the union of rules keeps it), `d` the overall
error probability and `m` the number of all tests (Bonferroni). No
statistic or candidate is fitted, so all labelled rows are holdout, and as all candidates are
tested at once, any certified one may be chosen: the one that rejects most labelled bad documents, less
`PRICE` for each good one (on ties the mildest). A stratum without enough labels, or a rule
that catches nothing there, gets no cutoff and loses nothing.

Null text counts as empty (no words); a document with an empty text fails the base rule.
Documents labelled more than once count as good when every label says so. Null ids match
no label. Repeated rows are ordinary rows; an empty table gives an empty
result; other columns are ignored. Equal windows of three words are found by
their 64-bit hashes within one document. A very long text is one row with an array of its words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimgrove.llm.common import UPPER, stored, text_or_empty, words_of

ALLOWED = 0.05
ERROR = 0.05
# Bad documents that a cutoff must reject for each good one it rejects.
PRICE = 10
# Lower bounds of the word-count bands.
BANDS = (0, 100, 300, 1000)
# Rule, statistic and candidate cutoffs, strictest first.
RULES = (
    ("symbols", "n_symbols / greatest(word_chars, 1)", (0.05, 0.1, 0.2, 0.3)),
    ("lines", "n_dup_lines / greatest(n_lines, 1)", (0.2, 0.3, 0.5, 0.7)),
    ("repeats", "n_repeat_words / greatest(n_words, 1)", (0.1, 0.2, 0.3, 0.4)),
    ("capitals", "n_capitals / greatest(word_chars, 1)", (0.2, 0.3, 0.5, 0.7)),
    ("lengths", "word_chars / greatest(n_words, 1)", (8.0, 10.0, 12.0, 16.0)),
)
SYMBOLS = "#*$%&|<>"
MARKS = "!?"
SPACES = " \t\n\x0b\x0c\r"


def text_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_capitals,
    n_distinct (words) and n_marks per row."""
    text = text_or_empty("text")
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")).select(
        "doc_id",
        words_of(text).alias("words"),
        F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
        F.length(F.translate(text, SPACES, "")).cast("bigint").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
        (F.length(text) - F.length(F.translate(text, UPPER, ""))).cast("bigint").alias("n_capitals"),
        (F.length(text) - F.length(F.translate(text, MARKS, ""))).cast("bigint").alias("n_marks"),
    )
    window = F.transform(
        F.col("words"),
        lambda word, i: F.xxhash64(word, F.get("words", i + 1), F.get("words", i + 2)),
    )
    rows = rows.withColumn("windows", F.slice(window, 1, F.greatest(F.size("words") - 2, F.lit(0))))
    repeated = F.size(F.array_distinct("windows")) < F.size("windows")
    placed = F.array_sort(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
    rows = rows.withColumn("placed", F.when(repeated, placed))

    def twin(h: Column, at: Column) -> Column:
        return F.coalesce(F.get("placed", at)["h"] == h, F.lit(False))

    again = F.filter("placed", lambda s, i: twin(s["h"], i - 1) | twin(s["h"], i + 1))
    covered = F.transform(again, lambda s: F.array(s["p"], s["p"] + 1, s["p"] + 2))
    return rows.select(
        "doc_id",
        F.size("words").cast("bigint").alias("n_words"),
        "word_chars",
        "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        F.coalesce(F.size(F.array_distinct(F.flatten(covered))), F.lit(0))
        .cast("bigint")
        .alias("n_repeat_words"),
        F.size("lines").cast("bigint").alias("n_lines"),
        "n_capitals",
        F.size(F.array_distinct("words")).cast("bigint").alias("n_distinct"),
        "n_marks",
    ).withColumn("n_repeat_words", F.greatest("n_repeat_words", F.lit(0)))


def band(n_words: Column) -> Column:
    result = F.lit(0)
    for i, least in enumerate(BANDS):
        result = F.when(n_words >= least, i).otherwise(result)
    return result


def binomial_tail(n: Column, k: Column, p: float) -> Column:
    """ln P(Bin(n, p) <= k) for 0 <= k < n * p, summed term by term in logarithms."""
    import math

    odds = math.log(p) - math.log1p(-p)
    first = n * math.log1p(-p)

    def add(state: Column, i: Column) -> Column:
        term = state["term"] + F.log((n - i + 1) / i) + odds
        top, low = F.greatest(term, state["total"]), F.least(term, state["total"])
        return F.struct(term.alias("term"), (top + F.log1p(F.exp(low - top))).alias("total"))

    steps = F.when(k >= 1, F.sequence(F.lit(1).cast("bigint"), k)).otherwise(
        F.array().cast("array<bigint>")
    )
    begin = F.struct(first.alias("term"), first.alias("total"))
    return F.aggregate(steps, begin, add, lambda state: state["total"])


def certified_cutoffs(
    statistics: DataFrame, labels: DataFrame, allowed: float = ALLOWED, error: float = ERROR
) -> DataFrame:
    """One row per stratum with a certified rule: the chosen cutoff of each rule, or null."""
    import math

    marked = labels.groupBy("doc_id").agg(F.min("quality").alias("good")).where("good IS NOT NULL")
    sample = statistics.join(marked, "doc_id")
    counts, rows = [], []
    for name, statistic, cutoffs in RULES:
        for j, cutoff in enumerate(cutoffs):
            above = F.expr(statistic) > cutoff
            counts.append(F.count(F.when((F.col("good") == 1) & above, 1)).alias(f"{name}_{j}"))
            counts.append(F.count(F.when((F.col("good") != 1) & above, 1)).alias(f"{name}_{j}_bad"))
            rows.append(f"'{name}', {cutoff!r}D, {name}_{j}, {name}_{j}_bad")
    tests = len(rows) * len(BANDS)
    counted = (
        sample.groupBy(band(F.col("n_words")).alias("stratum"))
        .agg(F.count(F.when(F.col("good") == 1, 1)).alias("n"), *counts)
        .selectExpr("stratum", "n", f"stack({len(rows)}, {', '.join(rows)}) AS (rule, cutoff, k, bad)")
        .withColumn("gain", F.col("bad") - PRICE * F.col("k"))
    )
    share = allowed / len(RULES)
    few = F.col("k") < F.col("n") * share
    tail = F.when(few, binomial_tail(F.col("n"), F.col("k"), share))
    passed = counted.where((tail <= math.log(error / tests)) & (F.col("gain") > 0))

    def best(name: str) -> Column:
        own = F.when(F.col("rule") == name, F.struct("gain", "cutoff"))
        return F.max(own)["cutoff"].alias(f"cut_{name}")

    return passed.groupBy("stratum").agg(*(best(name) for name, _, _ in RULES))


def apply_rules(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **limits: float
) -> DataFrame:
    """Statistics, base_failed, the cutoffs in force and `kept` for every document."""
    statistics = stored(text_statistics(docs, id_col, text_col))
    cutoffs = certified_cutoffs(statistics, labels, **limits)  # at most len(BANDS) rows
    rejected = F.lit(False)
    for name, statistic, _ in RULES:
        rejected |= F.coalesce(F.expr(statistic) > F.col(f"cut_{name}"), F.lit(False))
    return (
        statistics.withColumn("stratum", band(F.col("n_words")))
        .join(F.broadcast(cutoffs), "stratum", "left")
        .withColumn(
            "base_failed",
            (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")),
        )
        .withColumn("kept", ~F.col("base_failed") & ~rejected)
    )


def rules_sql() -> str:
    """The same rows in SQL: lists instead of arrays, the tail from gamma functions."""
    import math

    bands = " ".join(f"WHEN n_words >= {least} THEN {i}" for i, least in reversed(list(enumerate(BANDS))))
    value = {n: s.replace(" / ", "::DOUBLE / ") for n, s, _ in RULES}
    grid = " UNION ALL ".join(
        f"SELECT '{n}' AS rule, {c!r}::DOUBLE AS cutoff, stratum, "
        f"count(*) FILTER (good = 1) AS n, count(*) FILTER (good = 1 AND {value[n]} > {c!r}) AS k, "
        f"count(*) FILTER (good <> 1 AND {value[n]} > {c!r}) AS bad FROM marked GROUP BY stratum"
        for n, _, cs in RULES
        for c in cs
    )
    tests = sum(len(c) for _, _, c in RULES) * len(BANDS)
    p = ALLOWED / len(RULES)
    verdict = " OR ".join(
        f"coalesce({value[n]} > (SELECT first(cutoff ORDER BY bad - {PRICE} * k DESC, cutoff DESC) "
        f"FROM passed WHERE rule = '{n}' AND passed.stratum = s.stratum), false)"
        for n, _, _ in RULES
    )
    return rf"""
    WITH base AS (
      SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS t,
             regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
             list_filter(string_split(coalesce(text, ''), chr(10)),
                         lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
      FROM documents),
    windows AS (
      SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
      FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM base WHERE len(w) > 2)),
    twice AS (SELECT r, i FROM windows QUALIFY count(*) OVER (PARTITION BY r, g) > 1),
    covered AS (
      SELECT r, count(DISTINCT i + d) AS n FROM twice, (SELECT unnest([0, 1, 2]) AS d) GROUP BY r),
    stats AS (
      SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
             length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
             len(lines) - len(list_distinct(lines)) AS n_dup_lines,
             coalesce(n, 0) AS n_repeat_words, len(lines) AS n_lines,
             length(regexp_replace(t, '[^A-Z]', '', 'g')) AS n_capitals
      FROM base LEFT JOIN covered USING (r)),
    s AS (SELECT *, CASE {bands} END AS stratum FROM stats),
    marked AS (
      SELECT s.*, good FROM s JOIN (SELECT doc_id, min(quality) AS good FROM labels GROUP BY doc_id)
      USING (doc_id) WHERE good IS NOT NULL),
    grid AS ({grid}),
    passed AS (
      SELECT * FROM grid WHERE bad > {PRICE} * k AND k < n * {p!r} AND
        list_sum(list_transform(range(0, k + 1), lambda i:
          exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1)
              + i * ln({p!r}) + (n - i) * ln(1 - {p!r})))) <= {ERROR / tests!r})
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
           n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
           NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND NOT ({verdict}) AS kept
    FROM s
    """
