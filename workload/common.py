"""Readers of the given tables and the registry the driver entry collects."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimgrove.session import prepare, spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query and, where SQL can state it, the equivalent text."""

    def register(fn: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return fn(prepare(spark), folder)

        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


LARGE = ("documents", "lineitem", "orders", "events", "pages", "part")


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    df = spark.read.parquet(f"{folder}/{table}.parquet")
    return spread(df) if table in LARGE else df


def cents(c: Column | str) -> Column:
    """Money column (two decimals, stored as double) as whole cents."""
    c = F.col(c) if isinstance(c, str) else c
    return F.rint(c * 100).cast("bigint")
