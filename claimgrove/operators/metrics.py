"""Evaluation metrics as aggregations with fixed class lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimgrove.functions.canonical import content_hash

FACT_KEY = ("claim_id", "element_id")
FACT = (*FACT_KEY, "normalized_value", "valid_source_binding")


def _ratio(numerator, denominator):
    return F.when(denominator > 0, numerator / denominator)


def duplicate_assignments(facts: DataFrame, key: Sequence[str] = FACT_KEY) -> DataFrame:
    """(claim, element) keys assigned more than once; such input must be refused."""
    return facts.groupBy(*key).agg(F.count("*").alias("n")).filter("n > 1")


def element_metrics(pred: DataFrame, gold: DataFrame, fact: Sequence[str] = FACT) -> DataFrame:
    """Exact-match precision and recall, null on an empty denominator.

    One shuffle: both sides are tagged and counted per exact fact.
    """
    side = lambda df, p: df.select(*fact, F.lit(p).alias("p"), F.lit(1 - p).alias("g"))
    per_fact = (
        side(pred, 1)
        .unionByName(side(gold, 0))
        .groupBy(*fact)
        .agg(F.sum("p").alias("p"), F.sum("g").alias("g"))
    )
    total = per_fact.agg(
        F.count_if((F.col("p") > 0) & (F.col("g") > 0)).alias("matches"),
        F.coalesce(F.sum("p"), F.lit(0)).alias("n_pred"),
        F.coalesce(F.sum("g"), F.lit(0)).alias("n_gold"),
    )
    return total.select(
        F.inline(
            F.array(
                F.struct(
                    F.lit("element_precision").alias("metric"),
                    _ratio(F.col("matches"), F.col("n_pred")).alias("value"),
                    F.col("n_pred").alias("denominator"),
                ),
                F.struct(
                    F.lit("element_recall").alias("metric"),
                    _ratio(F.col("matches"), F.col("n_gold")).alias("value"),
                    F.col("n_gold").alias("denominator"),
                ),
            )
        )
    )


def pair_counts(pred: DataFrame, gold: DataFrame, key: Sequence[str] = ("claim_id",)) -> DataFrame:
    """(expected, predicted, n) over gold rows; at most (classes + 1)^2 rows."""
    p = pred.select(*key, F.col("value").alias("predicted"))
    g = gold.select(*key, F.col("value").alias("expected"))
    return g.join(p, list(key), "left").groupBy("expected", "predicted").agg(F.count("*").alias("n"))


def classification_metrics(
    pred: DataFrame,
    gold: DataFrame,
    classes: Sequence[str],
    prefix: str = "grade",
    key: Sequence[str] = ("claim_id",),
) -> DataFrame:
    """Accuracy and macro-F1, plain and selective (rows with a prediction only).

    Undecided gold rows leave the denominator; macro-F1 averages over all
    declared classes, an empty class scoring 0. Rows are joined and counted
    once; all metrics come from the small table of pair counts.
    """
    counts = pair_counts(pred, gold, key).filter(F.col("expected").isNotNull())
    hit = F.col("expected").eqNullSafe(F.col("predicted"))
    aggregates = []
    for name, keep in (("plain", F.lit(True)), ("selective", F.col("predicted").isNotNull())):
        weight = F.when(keep, F.col("n")).otherwise(0)
        aggregates.append(F.coalesce(F.sum(weight), F.lit(0)).alias(f"{name}_n"))
        aggregates.append(F.coalesce(F.sum(F.when(hit, weight)), F.lit(0)).alias(f"{name}_hit"))
        for i, c in enumerate(classes):
            is_p = F.coalesce(F.col("predicted") == c, F.lit(False))
            is_e = F.col("expected") == c
            aggregates.append(F.coalesce(F.sum(F.when(is_p & is_e, weight)), F.lit(0)).alias(f"{name}_tp{i}"))
            aggregates.append(F.coalesce(F.sum(F.when(is_p != is_e, weight)), F.lit(0)).alias(f"{name}_err{i}"))
    total = counts.agg(*aggregates)
    rows = []
    for name in ("plain", "selective"):
        n = F.col(f"{name}_n")
        infix = "" if name == "plain" else "_selective"
        f1 = F.lit(0.0)
        for i, _ in enumerate(classes):
            tp, err = F.col(f"{name}_tp{i}"), F.col(f"{name}_err{i}")
            f1 = f1 + F.when(2 * tp + err > 0, 2 * tp / (2 * tp + err)).otherwise(0.0)
        for metric, value in (
            ("accuracy", _ratio(F.col(f"{name}_hit"), n)),
            ("macro_f1", F.when(n > 0, f1 / len(classes))),
        ):
            rows.append(
                F.struct(
                    F.lit(f"{prefix}{infix}_{metric}").alias("metric"),
                    value.alias("value"),
                    n.alias("denominator"),
                )
            )
    return total.select(F.inline(F.array(*rows)))


def confusion(
    pred: DataFrame, gold: DataFrame, classes: Sequence[str], key: Sequence[str] = ("claim_id",)
) -> DataFrame:
    """Zero-filled matrix: one row per expected class, one column per predicted class."""
    counts = pair_counts(pred, gold, key).filter(
        F.col("expected").isin(*classes) & F.col("predicted").isin(*classes)
    )
    pivoted = counts.groupBy("expected").pivot("predicted", list(classes)).agg(F.sum("n"))
    every = pred.sparkSession.createDataFrame([(c,) for c in classes], "expected string")
    return every.join(F.broadcast(pivoted), "expected", "left").na.fill(0, list(classes))


def baseline(pred: DataFrame, gold: DataFrame, key: Sequence[str] = ("claim_id",)) -> DataFrame:
    """Majority-class baseline of the gold and coverage of the predictions."""
    counts = pair_counts(pred, gold, key)
    by_class = counts.groupBy("expected").agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("predicted").isNotNull(), F.col("n"))).alias("m")
    )
    decided = F.when(F.col("expected").isNotNull(), F.col("n"))
    total = by_class.agg(
        F.max(decided).alias("top"),
        F.coalesce(F.sum(decided), F.lit(0)).alias("decided"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("total"),
        F.coalesce(F.sum("m"), F.lit(0)).alias("predicted"),
    )
    return total.select(
        F.inline(
            F.array(
                F.struct(
                    F.lit("label_majority_baseline").alias("metric"),
                    _ratio(F.col("top"), F.col("decided")).alias("value"),
                    F.col("decided").alias("denominator"),
                ),
                F.struct(
                    F.lit("automatic_coverage").alias("metric"),
                    _ratio(F.col("predicted"), F.col("total")).alias("value"),
                    F.col("total").alias("denominator"),
                ),
            )
        )
    )


def review_scores(cases: DataFrame, by: Sequence[str] = ("company_id", "task")) -> DataFrame:
    """Agreement of predictions with review labels: overall and per grouping column.

    `cases` are (label, prediction, by...) with JSON texts; null label means
    unreviewed. One aggregation with grouping sets.
    """
    reviewed = F.col("label").isNotNull()
    match = reviewed & F.coalesce(
        content_hash(F.col("prediction")) == content_hash(F.col("label")), F.lit(False)
    )
    flags = cases.select(
        *by,
        reviewed.cast("int").alias("r"),
        match.cast("int").alias("m"),
        (reviewed & F.col("prediction").isNull()).cast("int").alias("u"),
    )
    sets = [[]] + [[F.col(b)] for b in by]
    grouped = flags.groupingSets(sets, *[F.col(b) for b in by]).agg(
        F.grouping_id(*by).alias("grouping_id"),
        F.count("*").alias("total_cases"),
        F.sum("r").alias("reviewed_cases"),
        F.sum("m").alias("exact_matches"),
        F.sum("u").alias("missing_predictions"),
    )
    return grouped.select(
        *by,
        "grouping_id",
        "total_cases",
        "reviewed_cases",
        (F.col("total_cases") - F.col("reviewed_cases")).alias("unreviewed_cases"),
        "exact_matches",
        "missing_predictions",
        _ratio(F.col("exact_matches"), F.col("reviewed_cases")).alias("agreement"),
        _ratio(F.col("reviewed_cases"), F.col("total_cases")).alias("review_coverage"),
    )


def verify_split(items: DataFrame) -> DataFrame:
    """Leakage rows: (problem, subject, n) for companies, duplicate ids and origins."""
    company = (
        items.groupBy("company_id", "split")
        .agg(F.lit(1).alias("one"))
        .groupBy("company_id")
        .agg(F.count("*").alias("n"))
        .filter("n > 1")
        .select(F.lit("company_in_several_splits").alias("problem"), F.col("company_id").alias("subject"), "n")
    )
    duplicate = (
        items.groupBy("item_id")
        .agg(F.count("*").alias("n"))
        .filter("n > 1")
        .select(F.lit("duplicate_item").alias("problem"), F.col("item_id").alias("subject"), "n")
    )
    origin = items.filter(
        (F.col("origin") == "review_confirmed") & (F.col("split") != "fewshot")
    ).select(
        F.lit("review_confirmed_outside_fewshot").alias("problem"),
        F.col("item_id").alias("subject"),
        F.lit(1).cast("bigint").alias("n"),
    )
    return company.unionByName(duplicate).unionByName(origin)


def split_counts(items: DataFrame) -> DataFrame:
    """Items and companies per split (two partial aggregations, no distinct set)."""
    per_company = items.groupBy("split", "company_id").agg(F.count("*").alias("n"))
    return per_company.groupBy("split").agg(
        F.sum("n").alias("n_items"), F.count("*").alias("n_companies")
    )


def compare_runs(
    left: DataFrame, right: DataFrame, sent: DataFrame, span: Sequence[str] = ("source_id", "char_start", "char_end")
) -> DataFrame:
    """Exact spans shared by two extraction runs, on one side only, and left claims
    in sources that were never sent."""
    span = list(span)
    side = lambda df, n: df.select(*span, F.lit(n).alias("side"))
    per_span = side(left, 1).unionByName(side(right, 2)).groupBy(*span).agg(
        F.max(F.when(F.col("side") == 1, 1).otherwise(0)).alias("l"),
        F.max(F.when(F.col("side") == 2, 1).otherwise(0)).alias("r"),
        F.count_if(F.col("side") == 1).alias("nl"),
    )
    known = sent.select("source_id").distinct().withColumn("__sent", F.lit(True))
    return per_span.join(known, "source_id", "left").agg(
        F.count_if((F.col("l") == 1) & (F.col("r") == 1)).alias("exact_span_matches"),
        F.count_if((F.col("l") == 1) & (F.col("r") == 0)).alias("baseline_only"),
        F.count_if((F.col("l") == 0) & (F.col("r") == 1)).alias("filtered_only"),
        F.coalesce(F.sum(F.when(F.col("__sent").isNull(), F.col("nl"))), F.lit(0)).alias(
            "baseline_in_deferred_sources"
        ),
    )


def span_intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b)


def span_except(a: DataFrame, b: DataFrame, keep_duplicates: bool = False) -> DataFrame:
    return a.exceptAll(b) if keep_duplicates else a.subtract(b)
