"""Ordered operators that survive a key holding a large share of all rows.

A plain `Window.partitionBy(key)` sorts all rows of one key in one task. Here
the caller names a `bucket`: any non-decreasing function of the order columns
(day of a timestamp, sequence // 10000, page number). Rows are windowed per
(key, bucket) and only one summary row per bucket travels along the key, so a
hot key is spread over as many tasks as it has buckets. `bucket=None` keeps the
plain window for keys that are bounded by nature (a page, one text).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

_BUCKET = "__bucket"


def _columns(names: Sequence[str | Column]) -> list[Column]:
    return [F.col(n) if isinstance(n, str) else n for n in names]


def _attach(df: DataFrame, summary: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Bring per-bucket carries back to the rows (null-safe on every key)."""
    names = [*keys, _BUCKET]
    renamed = summary.select(
        *[F.col(n).alias(f"__s{i}") for i, n in enumerate(names)],
        *[c for c in summary.columns if c not in names],
    )
    condition = None
    for i, n in enumerate(names):
        test = F.col(n).eqNullSafe(F.col(f"__s{i}"))
        condition = test if condition is None else condition & test
    return df.join(renamed, condition, "left").drop(*[f"__s{i}" for i in range(len(names))])


def neighbours(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str | Column],
    previous: Mapping[str, Column] | None = None,
    following: Mapping[str, Column] | None = None,
    bucket: Column | None = None,
) -> DataFrame:
    """Values of the row just before / after in the order of each key."""
    previous, following = dict(previous or {}), dict(following or {})
    cols = _columns(order)
    if bucket is None:
        w = W.partitionBy(*keys).orderBy(*cols)
        out = df
        new = {n: F.lag(c).over(w) for n, c in previous.items()}
        new |= {n: F.lead(c).over(w) for n, c in following.items()}
        return out.withColumns(new)
    rows = df.withColumn(_BUCKET, bucket)
    inner = W.partitionBy(*keys, _BUCKET).orderBy(*cols)
    position = F.struct(*cols)
    edges = []
    if previous:
        edges.append(
            F.max_by(F.struct(*[c.alias(n) for n, c in previous.items()]), position).alias("__last")
        )
    if following:
        edges.append(
            F.min_by(F.struct(*[c.alias(n) for n, c in following.items()]), position).alias("__first")
        )
    outer = W.partitionBy(*keys).orderBy(_BUCKET)
    summary = rows.groupBy(*keys, _BUCKET).agg(*edges)
    carries = []
    if previous:
        carries.append(F.lag("__last").over(outer).alias("__before"))
    if following:
        carries.append(F.lead("__first").over(outer).alias("__after"))
    summary = summary.select(*keys, _BUCKET, *carries)
    new = {}
    if previous:
        new |= {f"__p_{n}": F.lag(F.struct(c.alias("v"))).over(inner) for n, c in previous.items()}
    if following:
        new |= {f"__f_{n}": F.lead(F.struct(c.alias("v"))).over(inner) for n, c in following.items()}
    scanned = _attach(rows.withColumns(new), summary, keys)
    result = {}
    for n in previous:
        result[n] = F.when(F.col(f"__p_{n}").isNotNull(), F.col(f"__p_{n}.v")).otherwise(
            F.col(f"__before.{n}")
        )
    for n in following:
        result[n] = F.when(F.col(f"__f_{n}").isNotNull(), F.col(f"__f_{n}.v")).otherwise(
            F.col(f"__after.{n}")
        )
    return scanned.withColumns(result).select(*df.columns, *result)


def last_before(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str | Column],
    values: Mapping[str, Column],
    bucket: Column | None = None,
) -> DataFrame:
    """Last non-null value strictly before each row."""
    cols = _columns(order)
    if bucket is None:
        w = W.partitionBy(*keys).orderBy(*cols).rowsBetween(W.unboundedPreceding, -1)
        return df.withColumns({n: F.last(c, ignorenulls=True).over(w) for n, c in values.items()})
    rows = df.withColumn(_BUCKET, bucket)
    inner = W.partitionBy(*keys, _BUCKET).orderBy(*cols).rowsBetween(W.unboundedPreceding, -1)
    outer = W.partitionBy(*keys).orderBy(_BUCKET).rowsBetween(W.unboundedPreceding, -1)
    position = F.struct(*cols)
    summary = rows.groupBy(*keys, _BUCKET).agg(
        *[
            F.max_by(c, F.when(c.isNotNull(), position)).alias(f"__l_{n}")
            for n, c in values.items()
        ]
    )
    summary = summary.select(
        *keys,
        _BUCKET,
        *[F.last(f"__l_{n}", ignorenulls=True).over(outer).alias(f"__c_{n}") for n in values],
    )
    inside = {f"__i_{n}": F.last(c, ignorenulls=True).over(inner) for n, c in values.items()}
    scanned = _attach(rows.withColumns(inside), summary, keys)
    result = {n: F.coalesce(f"__i_{n}", f"__c_{n}") for n in values}
    return scanned.withColumns(result).select(*df.columns, *result)


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str | Column],
    sums: Mapping[str, Column] | None = None,
    maxima_before: Mapping[str, Column] | None = None,
    bucket: Column | None = None,
) -> DataFrame:
    """Inclusive running sums and running maxima of all earlier rows."""
    sums, maxima = dict(sums or {}), dict(maxima_before or {})
    cols = _columns(order)
    if bucket is None:
        upto = W.partitionBy(*keys).orderBy(*cols).rowsBetween(W.unboundedPreceding, 0)
        before = W.partitionBy(*keys).orderBy(*cols).rowsBetween(W.unboundedPreceding, -1)
        new = {n: F.sum(c).over(upto) for n, c in sums.items()}
        new |= {n: F.max(c).over(before) for n, c in maxima.items()}
        return df.withColumns(new)
    rows = df.withColumn(_BUCKET, bucket)
    upto = W.partitionBy(*keys, _BUCKET).orderBy(*cols).rowsBetween(W.unboundedPreceding, 0)
    before = W.partitionBy(*keys, _BUCKET).orderBy(*cols).rowsBetween(W.unboundedPreceding, -1)
    outer = W.partitionBy(*keys).orderBy(_BUCKET).rowsBetween(W.unboundedPreceding, -1)
    summary = rows.groupBy(*keys, _BUCKET).agg(
        *[F.sum(c).alias(f"__s_{n}") for n, c in sums.items()],
        *[F.max(c).alias(f"__m_{n}") for n, c in maxima.items()],
    )
    summary = summary.select(
        *keys,
        _BUCKET,
        *[F.sum(f"__s_{n}").over(outer).alias(f"__cs_{n}") for n in sums],
        *[F.max(f"__m_{n}").over(outer).alias(f"__cm_{n}") for n in maxima],
    )
    inside = {f"__is_{n}": F.sum(c).over(upto) for n, c in sums.items()}
    inside |= {f"__im_{n}": F.max(c).over(before) for n, c in maxima.items()}
    scanned = _attach(rows.withColumns(inside), summary, keys)
    result = {n: F.col(f"__is_{n}") + F.coalesce(F.col(f"__cs_{n}"), F.lit(0)) for n in sums}
    result |= {n: F.greatest(f"__im_{n}", f"__cm_{n}") for n in maxima}
    return scanned.withColumns(result).select(*df.columns, *result)


def numbered(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str | Column],
    name: str = "rn",
    bucket: Column | None = None,
) -> DataFrame:
    """1-based position of each row in the order of its key."""
    if bucket is None:
        return df.withColumn(name, F.row_number().over(W.partitionBy(*keys).orderBy(*_columns(order))))
    return running(df, keys, order, sums={name: F.lit(1)}, bucket=bucket)


def top_k(
    df: DataFrame, by: Sequence[str], order: Sequence[str | Column], k: int, rank: str = "rank"
) -> DataFrame:
    """First `k` rows of each group with their rank.

    The filter on row_number lets Spark keep only `k` rows per group and task
    before the shuffle (window group limit), so a hot group sends k rows per task.
    """
    w = W.partitionBy(*by).orderBy(*_columns(order))
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)


def latest(
    df: DataFrame, key: Sequence[str], revision: Sequence[str | Column]
) -> DataFrame:
    """Row with the highest revision of each key, by partial aggregation (no sort)."""
    rest = [c for c in df.columns if c not in key]
    best = F.max_by(F.struct(*rest), F.struct(*_columns(revision))).alias("__row")
    return df.groupBy(*key).agg(best).select(*key, "__row.*").select(*df.columns)


def first_by(
    df: DataFrame, key: Sequence[str], order: Sequence[str | Column]
) -> DataFrame:
    """Row with the lowest order value of each key, by partial aggregation."""
    rest = [c for c in df.columns if c not in key]
    best = F.min_by(F.struct(*rest), F.struct(*_columns(order))).alias("__row")
    return df.groupBy(*key).agg(best).select(*key, "__row.*").select(*df.columns)
