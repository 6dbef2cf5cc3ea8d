"""Quality scores by a sparse rule ensemble.

Small randomised trees are grown over text statistics of a bounded labelled sample. Every path
from a root is a rule, a conjunction of threshold tests; a lasso logistic regression over
all rules keeps few of them. The kept rules are compiled into one Spark column
expression, so scoring runs as generated code with no Python and no shuffle.

Labels of held-out rows (crc32 of the id, modulo 5, is 0) are never read; labels, language,
source and id are never inputs. Null text counts as empty and gets the score of its
statistics. Without labels of both classes every score is the smoothed share of
class 1. Rows labelled more than once count once, with the least label; null labels and ids
are not learned from. An empty table gives an empty result; other columns are ignored; a very long text is one
row with an array of its words.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimgrove.llm.common import held_out, stored
from claimgrove.llm.logistic import lasso
from claimgrove.llm.quality_rules import text_statistics

# Labelled rows that the model is fitted on at most, chosen by the hash of their id.
SAMPLE = 20_000
TREES, DEPTH, BINS, LEAST_LEAF = 40, 3, 32, 5
PENALTY = 1e-3
SHARES = {
    "n_words": "cast(n_words as double)",
    "word_length": "word_chars / greatest(n_words, 1)",
    "symbol_share": "n_symbols / greatest(word_chars, 1)",
    "line_repeats": "n_dup_lines / greatest(n_lines, 1)",
    "window_repeats": "n_repeat_words / greatest(n_words, 1)",
    "capital_share": "n_capitals / greatest(word_chars, 1)",
    "distinct_share": "n_distinct / greatest(n_words, 1)",
    "mark_share": "n_marks / greatest(word_chars, 1)",
    "line_words": "n_words / greatest(n_lines, 1)",
}

Rule = tuple[tuple[int, bool, float], ...]  # (feature, above, threshold), ...


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    shares = [F.expr(e).cast("double").alias(name) for name, e in SHARES.items()]
    return text_statistics(docs, id_col, text_col).select("doc_id", *shares)


def grow_rules(x: np.ndarray, y: np.ndarray, seed: int = 7) -> list[Rule]:
    """Paths of all nodes of all trees, each once, in the order found."""
    random = np.random.default_rng(seed)
    cuts = [np.unique(np.quantile(column, np.linspace(0, 1, BINS + 1)[1:-1])) for column in x.T]
    rules: dict[Rule, None] = {}

    def split(rows: np.ndarray, path: Rule) -> None:
        if len(path) == DEPTH or len(rows) < 2 * LEAST_LEAF or y[rows].min() == y[rows].max():
            return
        best, chosen = 1e-9, None
        total, ones = len(rows), y[rows].sum()
        pure = ones * (total - ones) / total
        for f in random.permutation(x.shape[1])[: max(2, x.shape[1] // 2)]:
            place = np.searchsorted(cuts[f], x[rows, f], side="left")
            n = np.cumsum(np.bincount(place, minlength=len(cuts[f]) + 1))[:-1]
            k = np.cumsum(np.bincount(place, weights=y[rows], minlength=len(cuts[f]) + 1))[:-1]
            fits = (n >= LEAST_LEAF) & (total - n >= LEAST_LEAF)
            if not fits.any():
                continue
            n, k = np.where(fits, n, 1), np.where(fits, k, 0)
            rest, others = total - n, ones - k
            gain = np.where(fits, pure - k * (n - k) / n - others * (rest - others) / rest, 0)
            at = int(gain.argmax())
            if gain[at] > best:
                best, chosen = gain[at], (int(f), float(cuts[f][at]))
        if chosen is None:
            return
        f, cut = chosen
        above = x[rows, f] > cut
        for side, part in ((False, rows[~above]), (True, rows[above])):
            longer = (*path, (f, side, cut))
            rules[longer] = None
            split(part, longer)

    for _ in range(TREES):
        split(random.integers(0, len(x), len(x)), ())
    return list(rules)


def holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    return np.logical_and.reduce([(x[:, f] > cut) == above for f, above, cut in rule])


def fit(x: np.ndarray, y: np.ndarray) -> tuple[list[tuple[Rule, float]], float]:
    """Kept rules with their weights, and the intercept."""
    rules = grow_rules(x, y)
    w = lasso(np.column_stack([holds(r, x) for r in rules] or [np.zeros(len(x))]), y, PENALTY)
    return [(r, float(v)) for r, v in zip(rules, w) if v], float(w[-1])


def compiled(rules: list[tuple[Rule, float]], intercept: float) -> Column:
    """Score between 0 and 1 as a column expression over the features."""
    names = list(SHARES)
    z = F.lit(intercept)
    for rule, weight in rules:
        test = F.lit(True)
        for f, above, cut in rule:
            test &= F.col(names[f]) > cut if above else F.col(names[f]) <= cut
        z += F.when(test, F.lit(weight)).otherwise(F.lit(0.0))
    return 1 / (1 + F.exp(-z))


def quality_scores(
    docs: DataFrame,
    labels: DataFrame,
    threshold: float = 0.3,
    sample: int = SAMPLE,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """doc_id, held_out, score, predicted for every row."""
    rows = stored(features(docs, id_col, text_col))
    known = (
        labels.where("doc_id IS NOT NULL AND quality IS NOT NULL")
        .groupBy("doc_id")
        .agg(F.min("quality").cast("int").alias("label"))
        .where(~held_out("doc_id"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(sample)
    )
    learned = rows.join(F.broadcast(known), "doc_id").select("label", *SHARES).toPandas()
    x = learned[list(SHARES)].to_numpy(dtype=np.float64)
    y = learned["label"].to_numpy(dtype=np.float64)
    order = np.lexsort((*x.T, y))  # the same model whatever order the rows came in
    x, y = x[order], y[order]
    if 0 < y.sum() < len(y):
        score = compiled(*fit(x, y))
    else:
        score = F.lit(float((y.sum() + 1) / (len(y) + 2)))
    return rows.select(
        "doc_id", held_out("doc_id").alias("held_out"), score.alias("score")
    ).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
