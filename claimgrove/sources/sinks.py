"""Report export, formula guard and shared-payload compaction."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimgrove.functions.text import SPACE


def guard_formula(c: Column) -> Column:
    """Prefix `'` when a text would be read as a formula (= + - @ after blanks)."""
    return F.when(c.rlike(f"^[{SPACE}]*[=+@-]"), F.concat(F.lit("'"), c)).otherwise(c)


def csv_ready(df: DataFrame) -> DataFrame:
    """Scalar text columns guarded, nested ones as guarded JSON text."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.StringType):
            c = guard_formula(c)
        elif isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            c = guard_formula(F.to_json(c))
        out.append(c.alias(f.name))
    return df.select(*out)


def write_report(
    df: DataFrame, path: str, kind: str, partition_by: Sequence[str] = ("run_id",), mode: str = "errorifexists"
) -> None:
    """Write report rows as JSON or guarded CSV, one folder per run."""
    if kind == "json":
        df.write.mode(mode).partitionBy(*partition_by).option("ignoreNullFields", "false").json(path)
    elif kind == "csv":
        csv_ready(df).write.mode(mode).partitionBy(*partition_by).option("header", True).option(
            "escape", '"'
        ).csv(path)
    else:
        raise ValueError("report kind must be json or csv")


def dedupe_payloads(df: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(compact, payloads): repeated payload texts replaced by `sha256:` references.

    `payloads` has one row per reference. The text of a hash is folded by min and
    max, so a collision shows as `collision` without gathering the copies.
    """
    ref = lambda c: F.when(
        F.col(c).isNotNull(), F.concat(F.lit("sha256:"), F.sha2(F.col(c), 256))
    )
    long = None
    for c in columns:
        part = df.filter(F.col(c).isNotNull()).select(ref(c).alias("payload_ref"), F.col(c).alias("payload"))
        long = part if long is None else long.unionByName(part)
    payloads = (
        long.groupBy("payload_ref")
        .agg(F.min("payload").alias("payload"), F.max("payload").alias("__hi"), F.count("*").alias("n_uses"))
        .select("payload_ref", "payload", "n_uses", (F.col("payload") != F.col("__hi")).alias("collision"))
    )
    return df.withColumns({c: ref(c) for c in columns}), payloads


def rehydrate(compact: DataFrame, payloads: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Inverse of `dedupe_payloads`; a reference whose text does not hash back stays null."""
    out = compact
    sound = payloads.filter(
        F.col("payload_ref") == F.concat(F.lit("sha256:"), F.sha2("payload", 256))
    ).select("payload_ref", "payload")
    for c in columns:
        side = sound.select(F.col("payload_ref").alias(c), F.col("payload").alias(f"__{c}"))
        out = out.join(side, c, "left").drop(c).withColumnRenamed(f"__{c}", c)
    return out.select(*compact.columns)
