"""Where every query is registered: a Spark callable and, where SQL can say it, the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query under ``name``; ``sql`` is its oracle."""

    def add(fn):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def with_views(*views: str) -> str:
    """A WITH clause from view texts (each 'name AS (...)')."""
    return "WITH " + ",\n".join(views) + "\n"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of the given tables. Times carry no zone, so the session is read in UTC."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """A given table that is one file of one row group, which Spark cannot split, dealt to all cores by ``keys``.

    Only for the bindings of such files, ahead of heavy work per row; no operator does this, and a table
    of as many files as cores is read as it is. So is one whose row groups already spread over the cores: no task
    reads more than twice its share (told by the footers alone). ``keys`` should tell rows apart.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if len(df.inputFiles()) >= cores:
        return df
    parts = df.groupBy(F.spark_partition_id().alias("part")).agg(F.count(F.lit(1)).alias("n"))
    largest, rows = parts.agg(F.max("n"), F.sum("n")).first()
    return df if largest is not None and largest * cores <= 2 * rows else df.repartition(cores, *keys)
