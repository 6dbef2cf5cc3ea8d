"""Evidence search: BM25, exact vector top-k, rank fusion and budgeted picks."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from claimgrove.functions.text import is_blank, search_terms
from claimgrove.operators.ordered import numbered, top_k
from claimgrove.session import cut_lineage, small_side

# --- fixed values: ranking constants -------------------------------------------
K1, B = 1.2, 0.75
TOP_HITS = 20
RRF_K = 60
MAX_ITEMS, MAX_ITEM_SIZE, MAX_TOTAL_SIZE = 12, 1600, 12000
# --- end of fixed values ---------------------------------------------------------

# Scores are summed as whole units of 1e-12, so the sum does not depend on the
# order in which partial aggregates meet and equal texts tie exactly.
SCORE_UNIT = 1e12
# Meetings of a posting and a query in one task.
MEETING = 1_000_000


def term_counts(terms: Column, sorted_terms: str = "__sorted") -> Column:
    """Array of struct<term, tf> of a column that holds *sorted* terms.

    Counts by run lengths inside the row, so no shuffle is needed for tf.
    """
    s = F.col(sorted_terms) if isinstance(sorted_terms, str) else sorted_terms
    n = F.size(s)
    positions = F.sequence(F.lit(1), n)
    starts = F.filter(
        positions, lambda i: (i == 1) | (F.try_element_at(s, i) != F.try_element_at(s, i - 1))
    )
    return F.when(
        n > 0,
        F.transform(
            F.arrays_zip(
                starts.alias("a"),
                F.concat(F.slice(starts, F.lit(2), F.size(starts)), F.array(n + 1)).alias("b"),
            ),
            lambda r: F.struct(
                F.element_at(s, r["a"]).alias("term"), (r["b"] - r["a"]).alias("tf")
            ),
        ),
    ).otherwise(F.array().cast("array<struct<term:string,tf:int>>"))


def block_terms(blocks: DataFrame, scope: Sequence[str], text: str = "text") -> DataFrame:
    """Non-blank blocks as (scope, source_id, len, counts ARRAY<struct<term, tf>>)."""
    words = blocks.filter(~is_blank(F.col(text))).select(
        *scope, "source_id", search_terms(F.col(text)).alias("__terms")
    )
    ordered = words.select(
        *scope, "source_id", F.size("__terms").alias("len"), F.array_sort("__terms").alias("__sorted")
    )
    return ordered.select(*scope, "source_id", "len", term_counts(F.col("__sorted")).alias("counts"))


def entries(terms: DataFrame, scope: Sequence[str]) -> DataFrame:
    """One row per posting, and one without a term per block, so that blocks without
    (wanted) terms still count: (scope, source_id, len, term, tf)."""
    none = F.array(F.struct(F.lit(None).cast("string").alias("term"), F.lit(0).alias("tf")))
    posting = F.explode(F.concat(none.cast(terms.schema["counts"].dataType), "counts"))
    return terms.select(*scope, "source_id", "len", posting.alias("p")).select(
        *scope, "source_id", "len", "p.term", "p.tf"
    )


def with_scope_stats(df: DataFrame, stats: DataFrame, scope: Sequence[str]) -> DataFrame:
    """Attach n_blocks and total_len: by scope, or as one scalar subquery."""
    if scope:
        return df.join(stats, list(scope))
    one = stats.select(F.struct("n_blocks", "total_len").alias("s")).scalar()
    return df.withColumn("__s", one).select(*df.columns, "__s.n_blocks", "__s.total_len")


def term_stats(blocks: DataFrame, scope: Sequence[str] = (), text: str = "text") -> DataFrame:
    """Per (scope, term): df, plus corpus size and average length of the scope.

    One pass: partial counts collapse before the shuffle, and only the counted terms are kept.
    """
    counted = cut_lineage(
        entries(block_terms(blocks, scope, text), scope)
        .groupBy(*scope, "term")
        .agg(F.count("*").alias("df"), F.sum("len").alias("total_len"))
    )
    stats = counted.filter(F.col("term").isNull()).select(
        *scope, F.col("df").alias("n_blocks"), "total_len"
    )
    found = counted.filter(F.col("term").isNotNull()).drop("total_len")
    return with_scope_stats(found, stats, scope).withColumn(
        "avg_len", F.col("total_len") / F.greatest(F.lit(1), F.col("n_blocks"))
    ).drop("total_len")


def bm25_scores(
    queries: DataFrame, blocks: DataFrame, scope: Sequence[str] = (), text: str = "text"
) -> DataFrame:
    """Score of every (query, block) that share a term: (scope, query_id, source_id, score).

    The text is tokenised once; only postings of query terms, and one row per block
    for the statistics, leave that pass. The query side is broadcast behind a size
    check, so the grouping by (query, block) needs no further shuffle.
    """
    scope = list(scope)
    wanted = queries.select(
        *scope, "query_id", F.explode(F.array_distinct(search_terms(F.col(text)))).alias("term")
    )
    vocabulary = small_side(wanted.select(*scope, "term").distinct().withColumn("__known", F.lit(True)))
    kept = cut_lineage(
        entries(block_terms(blocks, scope, text), scope)
        .join(vocabulary, [*scope, "term"], "left")
        .filter(F.col("__known") | F.col("term").isNull())
        .drop("__known")
    )
    whole, found = kept.filter(F.col("term").isNull()), kept.filter(F.col("term").isNotNull())
    stats = whole.groupBy(*scope).agg(
        F.count("*").alias("n_blocks"), F.sum("len").alias("total_len")
    )
    frequency = found.groupBy(*scope, "term").agg(F.count("*").alias("df"))
    idf = F.log1p((F.col("n_blocks") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weights = with_scope_stats(frequency, stats, scope).select(
        *scope,
        "term",
        idf.alias("idf"),
        "df",
        (F.col("total_len") / F.greatest(F.lit(1), F.col("n_blocks"))).alias("avg_len"),
    )
    weighted = cut_lineage(wanted.join(weights, [*scope, "term"]))
    # A posting meets all queries of its term, so tasks are sized by what meets and not by the postings.
    met = weighted.agg(F.sum("df")).first()[0] or 0
    tasks = max(-(-met // MEETING), queries.sparkSession.sparkContext.defaultParallelism)
    weighted = small_side(weighted.drop("df"))
    postings = found.repartition(tasks, *scope, "source_id")
    part = (
        F.col("idf")
        * F.col("tf")
        * (K1 + 1)
        / (F.col("tf") + K1 * ((1 - B) + B * F.col("len") / F.col("avg_len")))
    )
    return (
        postings.join(weighted, [*scope, "term"])
        .groupBy(*scope, "query_id", "source_id")
        .agg(F.sum(F.rint(part * SCORE_UNIT).cast("bigint")).alias("units"))
        .filter(F.col("units") > 0)
        .withColumn("score", F.col("units") / F.lit(SCORE_UNIT))
    )


def bm25(
    queries: DataFrame,
    blocks: DataFrame,
    k: int = TOP_HITS,
    scope: Sequence[str] = (),
    text: str = "text",
) -> DataFrame:
    """Top `k` blocks per query, ties by source id."""
    scores = bm25_scores(queries, blocks, scope, text)
    ranked = top_k(
        scores, [*scope, "query_id"], [F.col("units").desc(), F.col("source_id")], k
    )
    return ranked.drop("units")


CHUNK = 4096


def chunked_top(
    queries: DataFrame,
    targets: DataFrame,
    scope: Sequence[str],
    kernel,
    query_cols: Sequence[str],
    target_cols: Sequence[str],
    k: int,
    tie: Sequence[str] = ("source_id",),
    chunk: int = CHUNK,
) -> DataFrame:
    """Exact best `k` targets per query inside a scope, without emitting pairs.

    Both sides are cut into chunks of bounded size per scope and every pair of
    chunks is one group that evaluates `kernel(query rows, target rows)` as a
    matrix of scores (NaN = not eligible) and keeps only its local best `k`. A
    hot scope becomes many bounded groups. Scores are rounded so that equal
    inputs tie and `tie` columns decide.
    """
    scope, tie = list(scope), list(tie)
    spread = ["__qc", "__vc"]

    def chunked(df: DataFrame, id_col: str, name: str) -> tuple[DataFrame, DataFrame]:
        size = df.groupBy(*scope).agg(
            F.greatest(F.lit(1), F.ceil(F.count("*") / F.lit(chunk))).cast("int").alias(f"{name}_n")
        )
        keyed = df.join(size, scope).withColumn(
            name, F.pmod(F.xxhash64(id_col), F.col(f"{name}_n").cast("bigint")).cast("int")
        )
        return keyed, size

    # Fresh aliases keep the two sides apart when both come from one table.
    q, q_size = chunked(queries.select(*scope, "query_id", *query_cols), "query_id", "__qc")
    v, v_size = chunked(
        targets.select(*[F.col(c).alias(c) for c in [*scope, "source_id", *target_cols]]),
        "source_id",
        "__vc",
    )

    def replicate(df: DataFrame, other: DataFrame, name: str, cols: Sequence[str]) -> DataFrame:
        met = df.join(other, scope).withColumn(
            name, F.explode(F.sequence(F.lit(0), F.col(f"{name}_n") - 1))
        )
        return met.select(*[F.col(c).alias(c) for c in [*scope, *spread, *cols]])

    left = replicate(q, v_size, "__vc", ["query_id", *query_cols])
    right = replicate(v, q_size, "__qc", ["source_id", *target_cols])
    types = {f.name: f.dataType.simpleString() for f in [*left.schema, *right.schema]}
    carried = [c for c in tie if c != "source_id"]
    columns = [*scope, "query_id", "source_id", *carried, "score"]
    schema = ", ".join(f"`{c}` {types.get(c, 'double')}" for c in columns)

    def best(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        if a.empty or b.empty:
            return pd.DataFrame(columns=columns)
        b = b.sort_values(tie, kind="stable").reset_index(drop=True)
        parts = []
        for start in range(0, len(a), 512):  # bounds the score matrix
            block = a.iloc[start : start + 512]
            scores = np.round(kernel(block, b), 9)
            loss = np.where(np.isnan(scores), np.inf, -scores)
            if loss.shape[1] > 4 * k:
                # Only columns at or below the k-th loss of a row can be picked.
                cut = np.partition(loss, k - 1, axis=1)[:, k - 1 : k]
                rows, cols = np.nonzero(loss <= cut)
            else:
                rows, cols = np.nonzero(np.isfinite(loss))
            # Rows ascend; inside a row the columns are in tie order already.
            order = np.lexsort((cols, loss[rows, cols], rows))
            rows, cols = rows[order], cols[order]
            firsts = np.searchsorted(rows, rows, side="left")
            keep = (np.arange(len(rows)) - firsts < k) & np.isfinite(loss[rows, cols])
            rows, cols = rows[keep], cols[keep]
            picked = b.iloc[cols][["source_id", *carried]].reset_index(drop=True)
            picked["query_id"] = block["query_id"].to_numpy()[rows]
            picked["score"] = scores[rows, cols]
            parts.append(picked)
        out = pd.concat(parts, ignore_index=True)
        for name in scope:
            out[name] = a[name].iloc[0]
        return out[columns]

    local = (
        left.groupBy(*scope, *spread)
        .cogroup(right.groupBy(*scope, *spread))
        .applyInPandas(best, schema)
    )
    return top_k(local, [*scope, "query_id"], [F.col("score").desc(), *tie], k)


def vector_search(
    queries: DataFrame,
    vectors: DataFrame,
    scope: Sequence[str],
    k: int = TOP_HITS,
    exclude_self: bool = False,
    chunk: int = CHUNK,
) -> DataFrame:
    """Exact cosine top `k` inside a scope: (scope, query_id, source_id, rank, score)."""

    def cosine(a: pd.DataFrame, b: pd.DataFrame):
        import numpy as np

        def unit(rows):
            m = np.stack(rows.to_numpy()).astype("float64")
            norms = np.linalg.norm(m, axis=1, keepdims=True)
            return np.divide(m, norms, out=np.zeros_like(m), where=norms > 0)

        scores = unit(a["embedding"]) @ unit(b["embedding"]).T
        if exclude_self:
            same = a["query_id"].to_numpy()[:, None] == b["source_id"].to_numpy()[None, :]
            scores[same] = np.nan
        return scores

    return chunked_top(
        queries, vectors, scope, cosine, ["embedding"], ["embedding"], k, chunk=chunk
    )


def union_routes(*routes: DataFrame) -> DataFrame:
    """All hits of several routes under one schema."""
    merged = routes[0]
    for other in routes[1:]:
        merged = merged.unionByName(other)
    return merged


def rrf(
    hits: DataFrame,
    routes: Sequence[str],
    k: int = RRF_K,
    key: Sequence[str] = ("query_id",),
) -> DataFrame:
    """Reciprocal rank fusion of (key, route, source_id, position[, own_source]).

    Duplicates inside a route keep their first position and ranks are counted
    after that. Contributions are added in route order, so the float is stable.
    """
    key = list(key)
    once = hits.groupBy(*key, "route", "source_id").agg(F.min("position").alias("position"))
    order = W.partitionBy(*key, "route").orderBy("position", "source_id")
    ranked = once.withColumn("route_rank", F.row_number().over(order))
    per_route = [
        F.max(F.when(F.col("route") == r, 1.0 / (F.lit(k) + F.col("route_rank")))).alias(f"__{i}")
        for i, r in enumerate(routes)
    ]
    fused = ranked.groupBy(*key, "source_id").agg(*per_route)
    score = F.lit(0.0)
    for i in range(len(routes)):
        score = score + F.coalesce(F.col(f"__{i}"), F.lit(0.0))
    return fused.select(*key, "source_id", score.alias("rrf"))


def rejected_hits(
    hits: DataFrame, blocks: DataFrame, scope: Sequence[str]
) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) hits: a hit of a foreign scope or a stale text is rejected."""
    known = blocks.select(*scope, "source_id", F.sha2("raw_text", 256).alias("__sha"))
    checked = hits.join(known, [*scope, "source_id"], "left").withColumn(
        "__ok", F.coalesce(F.col("__sha") == F.col("raw_text_sha256"), F.lit(False))
    )
    plain = hits.columns
    return (
        checked.filter("__ok").select(*plain),
        checked.filter("not __ok").select(*plain),
    )


def budgeted_pick(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    item: str,
    size: str,
    max_items: int = MAX_ITEMS,
    max_item: int = MAX_ITEM_SIZE,
    max_total: int = MAX_TOTAL_SIZE,
) -> DataFrame:
    """Greedy pick per group: an item that does not fit is skipped, later ones may fit.

    Output: by, picked ARRAY (in order), used, n_items, n_omitted. The remaining
    budget only shrinks, so of all items of one size at most the first
    `max_items` can ever be picked. Keeping just those is exact and bounds the
    folded array by `max_item * max_items` entries however large the group is.
    """
    by = list(by)
    sized = df.withColumn("__size", F.col(size).cast("bigint"))
    totals = sized.groupBy(*by).agg(F.count("*").alias("n_items"))
    eligible = sized.filter(F.col("__size").between(0, max_item))
    kept = top_k(eligible, [*by, "__size"], order, max_items, "__rank")
    entry = F.struct(*order, F.col(item).alias("__item"), F.col("__size"))
    gathered = kept.groupBy(*by).agg(F.array_sort(F.collect_list(entry)).alias("__items"))
    item_type = df.schema[item].dataType.simpleString()
    start = F.struct(
        F.array().cast(f"array<{item_type}>").alias("picked"),
        F.lit(0).cast("bigint").alias("used"),
    )

    def step(acc: Column, e: Column) -> Column:
        fits = (acc["used"] + e["__size"] <= max_total) & (F.size(acc["picked"]) < max_items)
        return F.when(
            fits,
            F.struct(
                F.concat(acc["picked"], F.array(e["__item"])).alias("picked"),
                (acc["used"] + e["__size"]).alias("used"),
            ),
        ).otherwise(acc)

    picked = gathered.select(*by, F.aggregate("__items", start, step).alias("__f"))
    return totals.join(picked, by, "left").select(
        *by,
        F.coalesce("__f.picked", F.array().cast(f"array<{item_type}>")).alias("picked"),
        F.coalesce("__f.used", F.lit(0).cast("bigint")).alias("used"),
        "n_items",
        (F.col("n_items") - F.coalesce(F.size("__f.picked"), F.lit(0))).alias("n_omitted"),
    )


PACK_CHUNK = 8192


def _over_chunks(rows: DataFrame, by: Sequence[str], chunk: int, emit, schema: str) -> DataFrame:
    """What `emit(rows, bounds)` makes of whole chunks, each in order: many small groups in one call.

    Rows are numbered without gaps, so a chunk begins at its first number.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None  # the chunk that may go on in the next batch
        for batch in batches:
            if not len(batch):
                continue
            if rest is not None:
                batch = pa.Table.from_batches([rest, batch]).combine_chunks().to_batches()[0]
            first = batch.column("__rn").to_numpy() - 1 == batch.column("__chunk").to_numpy() * chunk
            begins = first.nonzero()[0].tolist()
            if len(begins) > 1:
                yield emit(batch, list(zip(begins[:-1], begins[1:])))
            rest = batch.slice(begins[-1])
        if rest is not None:
            yield emit(rest, [(0, len(rest))])

    groups = [*by, "__chunk"]
    return rows.repartition(*groups).sortWithinPartitions(*groups, "__rn").mapInArrow(run, schema)


def pack(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    item: str,
    size: str,
    max_items: int = 8,
    max_bytes: int = 11_000,
    bucket: Column | None = None,
    chunk: int = PACK_CHUNK,
) -> DataFrame:
    """Greedy packets in order: (by, item, packet, reason).

    A packet closes when the next item would exceed either limit; an item above
    the byte limit closes the open packet and gets no packet itself. A packet
    holds at most `max_items` items, so a chunk of rows maps the (at most
    `max_items`) places where a packet can enter it to the place where one
    enters the next chunk. Only these small maps are chained along a group, and
    each chunk then numbers its own packets, so no group is folded in one task.
    """
    by = list(by)
    numbered_rows = numbered(df, by, order, "__rn", bucket).select(
        *by,
        F.col(item).alias("__item"),
        F.col(size).cast("bigint").alias("__size"),
        "__rn",
        F.floor((F.col("__rn") - 1) / chunk).cast("bigint").alias("__chunk"),
    )
    # Each chunk also sees the first rows of its successor.
    ahead = numbered_rows.filter(
        (F.col("__chunk") > 0) & (F.col("__rn") - 1 - F.col("__chunk") * chunk < max_items)
    ).withColumn("__chunk", F.col("__chunk") - 1)
    seen = numbered_rows.unionByName(ahead)
    types = {f.name: f.dataType.simpleString() for f in numbered_rows.schema.fields}
    by_schema = "".join(f"`{c}` {types[c]}, " for c in by)

    def pointers(sizes):
        """Index of the next packet start for a packet starting at each row."""
        n = len(sizes)
        following = [0] * n
        for i in range(n):
            if sizes[i] > max_bytes:
                following[i] = i + 1
                continue
            used, j = 0, i
            while j < n and j - i < max_items and used + sizes[j] <= max_bytes:
                used += sizes[j]
                j += 1
            following[i] = j
        return following

    def transitions(rows: pa.RecordBatch, bounds: list[tuple[int, int]]) -> pa.RecordBatch:
        every, out = rows.column("__size").to_pylist(), []
        for first, last in bounds:
            own = min(last - first, chunk)
            if last - first == own:  # nothing enters a chunk after the last one
                out.append([0] * max_items)
                continue
            following, ends = pointers(every[first:last]), []
            for at in range(max_items):
                while at < own:
                    at = following[at]
                ends.append(at - own)
            out.append(ends)
        heads = rows.take(pa.array([first for first, _ in bounds], pa.int64())).select([*by, "__chunk"])
        return pa.RecordBatch.from_arrays(
            [*heads.columns, pa.array(out, pa.list_(pa.int32()))], names=[*by, "__chunk", "__map"]
        )

    maps = _over_chunks(seen, by, chunk, transitions, by_schema + "__chunk bigint, __map array<int>")
    start = F.struct(
        F.array().cast("array<int>").alias("entries"), F.lit(0).alias("at")
    )
    chained = (
        maps.groupBy(*by)
        .agg(F.array_sort(F.collect_list(F.struct("__chunk", "__map"))).alias("m"))
        .select(
            *by,
            "m",
            F.aggregate(
                "m",
                start,
                lambda acc, e: F.struct(
                    F.concat(acc["entries"], F.array(acc["at"])).alias("entries"),
                    F.element_at(e["__map"], acc["at"] + 1).alias("at"),
                ),
            )["entries"].alias("entries"),
        )
        .select(*by, F.explode(F.arrays_zip("m", "entries")).alias("z"))
        .select(*by, F.col("z.m.__chunk").alias("__chunk"), F.col("z.entries").alias("__entry"))
    )

    def assign(rows: pa.RecordBatch, bounds: list[tuple[int, int]]) -> pa.RecordBatch:
        every, entries = rows.column("__size").to_pylist(), rows.column("__entry").to_pylist()
        kept, numbers = [], []
        for first, last in bounds:
            sizes, own = every[first:last], min(last - first, chunk)
            following = pointers(sizes)
            # Rows before the entry belong to the packet still open in the previous
            # chunk, so local numbers start at 0 there and at 1 for new packets.
            local, at, number = [0] * own, entries[first], 0
            while at < own:
                if sizes[at] > max_bytes:
                    local[at] = None
                else:
                    number += 1
                    for j in range(at, min(following[at], own)):
                        local[j] = number
                at = following[at]
            kept.extend(range(first, first + own))
            numbers.extend(local)
        own_rows = rows.take(pa.array(kept, pa.int64())).select([*by, "__chunk", "__item"])
        return pa.RecordBatch.from_arrays(
            [*own_rows.columns, pa.array(numbers, pa.int64())], names=[*by, "__chunk", "__item", "__local"]
        )

    local = _over_chunks(
        seen.join(chained, [*by, "__chunk"]),
        by,
        chunk,
        assign,
        by_schema + f"__chunk bigint, __item {types['__item']}, __local bigint",
    )
    counts = local.groupBy(*by, "__chunk").agg(F.max("__local").alias("__n"))
    w = W.partitionBy(*by).orderBy("__chunk").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select(
        *by, "__chunk", F.coalesce(F.sum("__n").over(w), F.lit(0)).alias("__offset")
    )
    packet = F.col("__local") + F.col("__offset") - 1
    return local.join(offsets, [*by, "__chunk"]).select(
        *by,
        F.col("__item").alias(item),
        packet.alias("packet"),
        F.when(F.col("__local").isNull(), F.lit("packet_too_large")).alias("reason"),
    )
