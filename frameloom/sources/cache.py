"""Incremental analysis: payloads stay valid while size and whole-second mtime agree."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frameloom.operators.ordered import first_row

KEY = ["namespace", "path"]
SIGNATURE = ["size", "mtime_s"]


def with_validity(files: DataFrame, cache: DataFrame) -> DataFrame:
    """Files (namespace, path, size, mtime_s) with ``valid`` and the cached payload."""
    hit = cache.select(*KEY, *SIGNATURE, "payload", F.lit(True).alias("__hit"))
    return (
        files.join(hit, [*KEY, *SIGNATURE], "left")
        .withColumn("valid", F.coalesce("__hit", F.lit(False)))
        .drop("__hit")
    )


def to_recompute(files: DataFrame, cache: DataFrame) -> DataFrame:
    return files.join(cache, [*KEY, *SIGNATURE], "left_anti")


def all_valid(files: DataFrame, cache: DataFrame) -> DataFrame:
    """Per namespace: is every file valid?"""
    return with_validity(files, cache).groupBy("namespace").agg(
        F.bool_and("valid").alias("all_valid"), F.count_if(~F.col("valid")).alias("stale"), F.count(F.lit(1)).alias("files")
    )


def upsert_cache(cache: DataFrame, fresh: DataFrame, order: str | None = None) -> DataFrame:
    """Fresh entries replace those with the same key. A file without a signature is not stored.

    Where a key comes more than once the entry with the largest ``order`` is stored (without one: the
    latest signature).
    """
    new = fresh.filter(F.col("size").isNotNull() & F.col("mtime_s").isNotNull())
    rank = F.struct(*([order] if order else []), "mtime_s", "size", "payload")
    new = first_row(new, KEY, rank, largest=True)
    return cache.join(new.select(*KEY), KEY, "left_anti").unionByName(new.select(*cache.columns))
