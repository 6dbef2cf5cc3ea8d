"""Byte-balanced shards of indivisible groups by Karmarkar-Karp differencing.

Equal texts form one group and never part. Groups of at least 1/`ITEMS` of all
bytes are items of their own (there are at most `ITEMS` of them); smaller groups
are gathered by digest into `ITEMS` bundles. So the differencing works on at most
2 x `ITEMS` sizes whatever the corpus holds: a k-tuple of partial sums per item,
the two tuples with the largest spread are combined in opposite order until one
is left. With thousands of items the spread that remains is a few bytes, unless
one group alone exceeds its share.

Sizes are UTF-8 bytes plus one. A null text counts as empty and shares the group
of empty texts. Null and repeated ids are ordinary rows with slots of their own;
an empty table gives an empty result; other columns are ignored. Of very long texts only size and digest move.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimgrove.llm.common import stored, text_or_empty

ITEMS = 4096
# Rows that one window task numbers.
ROWS_PER_BUCKET = 20_000


def differencing(sizes: list[int], shards: int) -> list[int]:
    """Shard of each size. Ties are taken in input order, so the result is stable."""
    if not sizes:
        return []
    sums: list[list[int]] = [[size] + [0] * (shards - 1) for size in sizes]
    made_from: dict[int, list[tuple[int, int]]] = {}
    children: dict[int, tuple[int, int]] = {}
    heap = [(-size, i) for i, size in enumerate(sizes)] if shards > 1 else [(0, i) for i in range(len(sizes))]
    heapq.heapify(heap)
    while len(heap) > 1:
        (_, a), (_, b) = heapq.heappop(heap), heapq.heappop(heap)
        joined = [(sums[a][j] + sums[b][shards - 1 - j], j) for j in range(shards)]
        joined.sort(key=lambda x: (-x[0], x[1]))
        new = len(sums)
        sums.append([s for s, _ in joined])
        made_from[new] = [(j, shards - 1 - j) for _, j in joined]
        children[new] = (a, b)
        sums[a] = sums[b] = []
        heapq.heappush(heap, (sums[new][-1] - sums[new][0], new))
    result = [0] * len(sizes)
    stack = [(heap[0][1], list(range(shards)))]
    while stack:
        node, place = stack.pop()
        if node not in children:
            result[node] = place[0]
            continue
        left, right = [0] * shards, [0] * shards
        for slot, (i, j) in enumerate(made_from[node]):
            left[i] = right[j] = place[slot]
        stack += [(children[node][0], left), (children[node][1], right)]
    return result


def balanced_shards(
    docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot: shard 0..shards-1, slots gapless from 0."""
    spark = docs.sparkSession
    text = text_or_empty(docs[text_col])
    rows = stored(
        docs.select(
            docs[id_col].alias("doc_id"),
            (F.octet_length(text) + 1).cast("bigint").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.sha2(text.cast("binary"), 256).alias("digest"),
            F.monotonically_increasing_id().alias("row_no"),
        )
    ).withColumn("bundle", F.pmod(F.xxhash64("digest"), F.lit(ITEMS)))
    whole = rows.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("b"), F.count("*").alias("n")).first()
    groups = rows.groupBy("digest", "bundle").agg(F.sum("size").alias("size"))
    heavy = F.col("size") * ITEMS >= F.lit(whole["b"])
    items = (
        groups.withColumn("heavy", F.when(heavy, F.col("digest")))
        .withColumn("bundle", F.when(~heavy, F.col("bundle")))
        .groupBy("heavy", "bundle")
        .agg(F.sum("size").alias("size"))
        .collect()  # at most 2 * ITEMS rows
    )
    items.sort(key=lambda r: (-r["size"], r["heavy"] or "", r["bundle"] or 0))
    place = differencing([r["size"] for r in items], shards)
    single = [(r["heavy"], s) for r, s in zip(items, place) if r["heavy"] is not None]
    bundles = [(r["bundle"], s) for r, s in zip(items, place) if r["heavy"] is None]
    by_digest = spark.createDataFrame(single, "digest string, own_shard int")
    by_bundle = spark.createDataFrame(bundles, "bundle bigint, bundle_shard int")
    placed = (
        rows.join(F.broadcast(by_digest), "digest", "left")
        .join(F.broadcast(by_bundle), "bundle", "left")
        .withColumn("shard", F.coalesce("own_shard", "bundle_shard"))
        .withColumn("bucket", F.pmod(F.xxhash64("row_no"), F.lit(1 + whole["n"] // (shards * ROWS_PER_BUCKET))))
        .select("doc_id", "size", "text_crc32", "shard", "bucket", "row_no")
    )
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy("shard", "bucket")
        .agg(F.count("*").alias("n"))
        .withColumn("first_slot", F.coalesce(F.sum("n").over(before), F.lit(0)))
        .drop("n")
    )
    inside = Window.partitionBy("shard", "bucket").orderBy("doc_id", "row_no")
    numbered = placed.withColumn("rank", F.row_number().over(inside) - 1)
    return numbered.join(offsets, ["shard", "bucket"]).select(
        "doc_id", "size", "text_crc32", "shard", (F.col("first_slot") + F.col("rank")).alias("slot")
    )
