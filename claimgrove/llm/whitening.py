"""Whitening of embeddings with MLlib block matrices.

An entry c becomes the whole number floor(256 c). The fit list holds every distinct vector once; its
exact sums give the mean. Tasks cut their stretch of the fit list into blocks of centred rows, so
building the matrix moves nothing. `BlockMatrix` multiplies its transpose by it, the rows' dimension
split into bounded pieces whose products are added up (the scatter), the driver takes the
eigenvectors of that one small matrix, and a second multiplication by the whitening matrix
projects all rows. Copies share their vector's result: vectors with a 1/`HEAVY` of the rows or
more (at most `HEAVY`) are joined by broadcast, all others by one shuffle.

Defined edge cases: rows whose vector is null or holds null or non-finite entries are dropped.
All vectors need one dimension: that of most distinct vectors counts (of equally frequent ones the
longest), rows of other dimensions are dropped; so are empty vectors. A component without variance has a
null `whitened` and no part in the identity error; without any variance `explained` is null. Null or
repeated ids are ordinary rows; a `deviation` beyond a long is null; entries beyond a long over 256
saturate; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import Matrices, MatrixUDT
from pyspark.mllib.linalg.distributed import BlockMatrix
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from claimgrove.llm.common import stored

# A vector with at least this share of the rows is joined by broadcast.
HEAVY = 1024
# Entries of one block; a task holds a few blocks.
BLOCK_ENTRIES = 1 << 19
# Blocks whose products one task adds up.
BLOCKS_PER_TASK = 8

RESULT = (
    "vec_id bigint, component int, n bigint, deviation bigint, whitened double, "
    "explained double, identity_error double"
)
_BLOCKS = StructType(
    [
        StructField("_1", StructType([StructField("_1", LongType()), StructField("_2", LongType())])),
        StructField("_2", MatrixUDT()),
    ]
)
_BLOCKS_ARROW = pa.schema(
    [
        ("_1", pa.struct([("_1", pa.int64()), ("_2", pa.int64())])),
        (
            "_2",
            pa.struct(
                [
                    ("type", pa.int8()),
                    ("numRows", pa.int32()),
                    ("numCols", pa.int32()),
                    ("colPtrs", pa.list_(pa.int32())),
                    ("rowIndices", pa.list_(pa.int32())),
                    ("values", pa.list_(pa.float64())),
                    ("isTransposed", pa.bool_()),
                ]
            ),
        ),
    ]
)


def whole_vectors(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id and x (whole numbers) of all rows with a finite vector."""
    vector = rows[vector_col].cast("array<double>")
    finite = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    x = F.transform(vector, lambda c: F.floor(c * 256).cast("bigint"))
    return rows.where(vector.isNotNull() & finite & (F.size(vector) > 0)).select(
        rows[id_col].cast("bigint").alias("vec_id"), x.alias("x")
    )


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def exact_sums(fit: DataFrame, width: int) -> tuple[int, list[int]]:
    """Number of vectors and the exact sum of every dimension; one row per task reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, low, high = 0, np.zeros(width, dtype=object), np.zeros(width, dtype=object)
        for batch in batches:
            x = _matrix(batch.column(0), width)
            n += len(x)
            # Two halves of 32 bits, so that no sum of a batch overflows.
            low += (x & 0xFFFFFFFF).sum(0).astype(object)
            high += (x >> 32).sum(0).astype(object)
        sums = [str(int(b) * (1 << 32) + int(a)) for a, b in zip(low, high)]
        yield pa.RecordBatch.from_arrays(
            [pa.array([n]), pa.array([sums], pa.list_(pa.string()))], names=["n", "sums"]
        )

    parts = fit.select("x").mapInArrow(run, "n bigint, sums array<string>").collect()
    return sum(p["n"] for p in parts), [sum(int(p["sums"][i]) for p in parts) for i in range(width)]


def place_in_blocks(fit: DataFrame, per_block: int) -> tuple[DataFrame, int]:
    """`fit` with `index`, so that every partition fills blocks of its own; and the number of blocks.

    `place` holds the partition and the place in it. Only a count per partition reaches the driver.
    """
    number = F.shiftright("place", 33)
    counts = fit.groupBy(number.alias("part")).agg(F.max("place").alias("last")).collect()
    first, blocks = {}, 0
    for row in sorted(counts, key=lambda r: r["part"]):
        first[row["part"]] = blocks * per_block
        blocks += ((row["last"] & ((1 << 33) - 1)) // per_block) + 1
    if not first:
        return fit.withColumn("index", F.lit(0).cast("bigint")), 0
    offsets = fit.sparkSession.createDataFrame(list(first.items()), "part bigint, first bigint")
    inside = F.col("place").bitwiseAND(F.lit((1 << 33) - 1))
    return (
        fit.withColumn("part", number.cast("bigint"))
        .join(F.broadcast(offsets), "part")  # a row per partition
        .withColumn("index", F.col("first") + inside)
        .drop("part", "first"),
        blocks,
    )


def centred_blocks(fit: DataFrame, mean: np.ndarray, per_block: int, blocks: int) -> BlockMatrix:
    """The centred rows of `fit` (index, x) as blocks; places without a row hold zeros."""
    width = len(mean)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, values = -1, np.zeros(0)

        def taken() -> pa.RecordBatch:
            matrix = [1, per_block, width, None, None, values.ravel(), True]
            names = [f.name for f in _BLOCKS_ARROW.field("_2").type]
            columns = [[{"_1": block, "_2": 0}], [dict(zip(names, matrix))]]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(columns, _BLOCKS_ARROW)], schema=_BLOCKS_ARROW
            )

        for batch in batches:
            index = batch.column(0).to_numpy()
            x = _matrix(batch.column(1), width) - mean
            cuts = np.flatnonzero(np.diff(index // per_block)) + 1
            for part, rows in zip(np.split(index, cuts), np.split(x, cuts)):
                if not len(part):
                    continue
                if part[0] // per_block != block:
                    if block >= 0:
                        yield taken()
                    block, values = int(part[0] // per_block), np.zeros((per_block, width))
                values[part % per_block] = rows
        if block >= 0:
            yield taken()

    frame = fit.select("index", "x").mapInArrow(run, _BLOCKS)
    made = callMLlibFunc("createBlockMatrix", frame, per_block, width, blocks * per_block, width)
    return BlockMatrix(made, per_block, width)


def scatter(centred: BlockMatrix, blocks: int) -> np.ndarray:
    """Transpose times matrix: `BLOCKS_PER_TASK` blocks per task, then a sum of small products."""
    turned = centred.transpose()
    splits = -(-blocks // BLOCKS_PER_TASK)
    # The Python method does not pass on the number of pieces of the middle dimension.
    product = turned._java_matrix_wrapper.call("multiply", centred._java_matrix_wrapper._java_model, splits)
    local = BlockMatrix(product, centred.colsPerBlock, centred.colsPerBlock).toLocalMatrix().toArray()
    return (local + local.T) / 2


def leading(covariance: np.ndarray, components: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Whitening matrix, share of the trace and whether it has variance, of every leading component."""
    values, vectors = np.linalg.eigh(covariance)
    order = np.argsort(values)[::-1][:components]
    values, vectors = values[order], vectors[:, order]
    live = values > max(values[0], 0) * len(covariance) * np.finfo(float).eps
    scale = np.divide(1, np.sqrt(np.abs(values)), out=np.zeros(len(values)), where=live)
    trace = np.trace(covariance)
    return vectors * scale, values / trace if trace > 0 else np.full(len(values), np.nan), live


def projected(centred: BlockMatrix, whitening: np.ndarray, blocks: int) -> DataFrame:
    """index and w, the rows of `centred` times the whitening matrix."""
    context = centred.blocks.ctx
    width, k = whitening.shape
    # The result has a partition per square root of the partitions that go in.
    slices = min((1 + blocks // BLOCKS_PER_TASK) ** 2, 4096)
    matrix = Matrices.dense(width, k, whitening.ravel(order="F").tolist())
    right = BlockMatrix(context.parallelize([((0, 0), matrix)], slices), width, k, width, k)
    rows = centred.multiply(right).toIndexedRowMatrix()
    frame = callMLlibFunc("getIndexedRows", rows._java_matrix_wrapper._java_model)
    return frame.select("index", vector_to_array("vector").alias("w"))


def deviations(fit: DataFrame, n: int, sums: list[int]) -> DataFrame:
    """`fit` with `deviation`, the exact sum over the dimensions of (n x - S) squared."""
    width, most = len(sums), float(max(map(abs, sums)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1), width)
            bound = n * float(np.abs(x.astype(np.float64)).max(initial=0)) + most
            kind = np.int64 if width * bound * bound < 2.0**62 else object
            off = x.astype(kind) * n - np.array(sums, dtype=kind)
            found = [int(v) if v < 1 << 63 else None for v in (off * off).sum(1).tolist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(found, pa.int64())], names=["index", "x", "copies", "deviation"]
            )

    schema = "index bigint, x array<bigint>, copies bigint, deviation bigint"
    return fit.select("index", "x", "copies").mapInArrow(run, schema)


def identity_error(rows: DataFrame, n: int, live: np.ndarray) -> float | None:
    """Largest absolute entry of the covariance of `w` minus the identity."""
    at = [i for i, alive in enumerate(live) if alive]
    if not at:
        return None
    sums = rows.agg(*(F.sum(F.col("w")[i]).alias(f"s{i}") for i in at)).first()
    mean = {i: sums[f"s{i}"] / n for i in at}
    pairs = [(i, j) for i in at for j in at if i <= j]
    products = rows.agg(
        *(F.sum((F.col("w")[i] - mean[i]) * (F.col("w")[j] - mean[j])).alias(f"p{i}_{j}") for i, j in pairs)
    ).first()
    return max(abs(products[f"p{i}_{j}"] / n - (i == j)) for i, j in pairs)


def _numbers(values: np.ndarray) -> Column:
    return F.array(*(F.lit(None if np.isnan(v) else float(v)).cast("double") for v in values))


def whiten(
    embeddings: DataFrame, components: int = 4, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained and identity_error of every row."""
    rows = whole_vectors(embeddings, id_col, vector_col)
    distinct = rows.groupBy("x").agg(F.count("*").alias("copies"))
    distinct = stored(distinct.withColumn("place", F.monotonically_increasing_id()))
    sizes = distinct.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n"), F.sum("copies").alias("rows"))
    chosen = sizes.orderBy(F.desc("n"), F.desc("d")).first()
    if chosen is None:
        return embeddings.sparkSession.createDataFrame([], RESULT)
    width, total = chosen["d"], chosen["rows"]
    fit = distinct.where(F.size("x") == width)
    n, sums = exact_sums(fit, width)
    per_block = max(1, BLOCK_ENTRIES // width)
    fit, blocks = place_in_blocks(fit, per_block)
    centred = centred_blocks(fit, np.array([s / n for s in sums]), per_block, blocks)
    whitening, explained, live = leading(scatter(centred, blocks) / n, min(components, width))
    marked = deviations(fit, n, sums).join(projected(centred, whitening, blocks), "index")
    marked = stored(marked.select("x", "copies", "deviation", "w"))
    error = identity_error(marked, n, live)

    kept = rows.where(F.size("x") == width)
    heavy = stored(marked.where(F.col("copies") * HEAVY >= total))  # at most HEAVY rows
    both = kept.join(F.broadcast(heavy.select("x", F.col("w").alias("hot"), "deviation")), "x", "left")
    hot = both.where("hot IS NOT NULL").select("vec_id", F.col("hot").alias("w"), "deviation")
    rest = both.where("hot IS NULL").select("vec_id", "x")
    light = marked.where(F.col("copies") * HEAVY < total).select("x", "w", "deviation")
    joined = hot.unionByName(rest.join(light, "x").select("vec_id", "w", "deviation"))
    at = F.col("at")
    return joined.select("vec_id", "deviation", F.posexplode("w").alias("at", "w")).select(
        "vec_id",
        (at + 1).cast("int").alias("component"),
        F.lit(n).cast("bigint").alias("n"),
        "deviation",
        F.when(F.array(*(F.lit(bool(v)) for v in live))[at], F.col("w")).alias("whitened"),
        _numbers(explained)[at].alias("explained"),
        F.lit(error).cast("double").alias("identity_error"),
    )
