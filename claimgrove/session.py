"""Session set-up shared by jobs, tests and the benchmark.

Only settings a job may choose for itself live here; anything the cluster
already set (master, checkpoint folder, shuffle partitions) is left alone.
"""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Runtime SQL settings every plan of this library relies on.
RUNTIME = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Rows go to Python in small batches, so that long texts do not add up in a task.
    "spark.sql.execution.arrow.maxBytesPerBatch": "4m",
}

# Upper limits under which a side may be broadcast (see `small_side`).
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 * 1024 * 1024


def local_session(cores: int | str = 8, app: str = "claimgrove", **conf: str) -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
    )
    for key, value in {**RUNTIME, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session somebody else built."""
    for key, value in RUNTIME.items():
        spark.conf.set(key, value)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder of `spark.checkpoint.dir`, which driver and executors share.

    Where it is unset, a temporary folder serves local mode only: on a cluster
    each executor would write to a disk of its own, so that is refused.
    """
    context = spark.sparkContext
    configured = context.getConf().get("spark.checkpoint.dir", None) or spark.conf.get(
        "spark.checkpoint.dir", None
    )
    if configured is None:
        set_before = context.getCheckpointDir()
        if set_before is not None:
            return set_before
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="spark-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(configured)
    return configured


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise `df` in the shared checkpoint folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df: DataFrame) -> DataFrame:
    """Use all cores on an input that has fewer partitions than the cluster has cores.

    A large input already has more partitions than cores and passes unchanged,
    so at scale no shuffle is added; a single small file is spread once.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def small_side(
    df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """Mark `df` for broadcast only when its real size is within both bounds.

    Rows and bytes are counted by partial aggregation, so the check itself moves
    one row per task. Beyond the bound the frame is returned unmarked, so the
    join shuffles (and AQE splits skewed partitions).
    """
    sized = df.select(F.length(F.to_json(F.struct(*df.columns))).alias("b"))
    seen = sized.agg(F.count("*").alias("n"), F.coalesce(F.sum("b"), F.lit(0)).alias("b")).first()
    if seen["n"] <= max_rows and seen["b"] <= max_bytes:
        return F.broadcast(df)
    return df
