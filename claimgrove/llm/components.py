"""Connected components of an edge table: least label, hooked and shortcut.

An empty table gives an empty one; repeated edges count once, edges from a node to itself do not count.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimgrove.llm.common import stored
from claimgrove.llm.tokens import frugal

# Edges that a task joins at once; its memory follows from it.
CHUNK = 1 << 17


def stars(edges: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """a, b, chunk: within chunks of `edges` (a, b), every node and the least node that it reaches there.

    A task joins about `chunk` edges at a time. The stars join the same nodes as the edges; none has more rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held = TaskContext.get().partitionId() << 32, 0
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while root.setdefault(x, x) != x:
                root[x] = x = root[root[x]]
            return x

        def taken() -> pa.RecordBatch:
            ends = [(x, r) for x in list(root) if (r := find(x)) != x]
            columns = [pa.array([e[side] for e in ends], pa.int64()) for side in (0, 1)]
            return pa.RecordBatch.from_arrays(
                [*columns, pa.array([number] * len(ends), pa.int64())], names=["a", "b", "chunk"]
            )

        for batch in batches:
            for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                p, q = find(x), find(y)
                if p != q:
                    root[max(p, q)] = min(p, q)
            held += len(batch)
            if held >= chunk:
                yield taken()
                root.clear()
                number, held = number + 1, 0
        yield taken()

    several = edges.where("a <> b").select(F.col("a").cast("bigint"), F.col("b").cast("bigint"))
    return several.mapInArrow(frugal(run), "a bigint, b bigint, chunk bigint")


def components(edges: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """node, label of every node in `edges` (a, b): the least node that it reaches.

    Tasks first join the edges that they hold (`stars`). Then, each round, every tree hooks its root to the
    least root among its neighbours, and all nodes jump to their parent's parent. Minima are pre-aggregated
    per task, so a hub costs one row per task; both tables are checkpointed each
    round. Edges inside one tree are dropped and tasks join what they hold of the rest, so rounds shrink; it ends
    when one chunk holds all edges that are left, or none are, which a chain of n nodes reaches in O(log n) rounds.
    Few edges so take no round: every query of a round costs the driver threads and memory.
    """
    live = stored(stars(edges, chunk))
    least = live.select(F.col("b").alias("node")).distinct().withColumn("label", F.col("node"))
    if _in_one_chunk(live):
        return stored(live.select(F.col("a").alias("node"), F.col("b").alias("label")).unionAll(least))
    parents = stored(
        live.select(F.col("a").alias("node"))
        .unionAll(live.select("b"))
        .distinct()
        .withColumn("label", F.col("node"))
    )
    while not _in_one_chunk(live):
        # Larger roots hook to the least smaller root they touch.
        hooks = stored(live.groupBy(F.col("a").alias("root")).agg(F.min("b").alias("to")))
        # A hooked root may point to another hooked root: follow until all end in roots that stay.
        while True:
            step = hooks.alias("x").join(hooks.alias("y"), F.col("x.to") == F.col("y.root"), "left")
            step = stored(
                step.select(
                    F.col("x.root").alias("root"),
                    F.coalesce("y.to", "x.to").alias("to"),
                    F.col("y.to").isNotNull().alias("moved"),
                )
            )
            hooks = step.select("root", "to")
            if step.where("moved").isEmpty():
                break
        parents = stored(_hooked(parents, hooks))
        left = hooks.select(F.col("root").alias("a"), F.col("to").alias("ta"))
        right = hooks.select(F.col("root").alias("b"), F.col("to").alias("tb"))
        moved = (
            live.join(left, "a", "left")
            .join(right, "b", "left")
            .select(F.coalesce("ta", "a").alias("a"), F.coalesce("tb", "b").alias("b"))
            .where("a <> b")
            .distinct()
        )
        live = stored(stars(moved, chunk))
    return stored(_hooked(parents, live.select(F.col("a").alias("root"), F.col("b").alias("to"))))


def _in_one_chunk(live: DataFrame) -> bool:
    ends = live.agg(F.min("chunk").alias("first"), F.max("chunk").alias("last")).first()
    return ends["first"] == ends["last"]


def _hooked(parents: DataFrame, hooks: DataFrame) -> DataFrame:
    return parents.join(hooks, F.col("label") == F.col("root"), "left").select(
        "node", F.coalesce("to", "label").alias("label")
    )
