"""Driving streams: file sources, sinks in the shared folder, incremental batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from hashlib import md5

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from frameloom.functions.scrub import scrub_json
from frameloom.operators.ordered import first_row
from frameloom.session import scratch_dir
from frameloom.sources.cache import KEY, SIGNATURE, to_recompute


def file_stream(spark: SparkSession, folder: str, pattern: str, schema, files_per_batch: int = 16) -> DataFrame:
    """Parquet files of a folder whose names match ``pattern``, as a stream."""
    return (
        spark.readStream.schema(schema).option("pathGlobFilter", pattern)
        .option("maxFilesPerTrigger", files_per_batch).parquet(folder)
    )


def table_stream(table: DataFrame, folder: str, name: str) -> DataFrame:
    """``table``, read from ``name`` in ``folder``, as a stream, be it one file or a folder of files; a stream reads folders only."""
    spark, folder = table.sparkSession, folder.rstrip("/")
    if any(file.endswith(f"/{name}") for file in table.inputFiles()):
        return file_stream(spark, folder, name, table.schema)
    return file_stream(spark, f"{folder}/{name}", "*", table.schema)


def drain(stream: DataFrame, label: str, mode: str = "append", folder: str | None = None) -> DataFrame:
    """Process everything available into a parquet table in the shared folder and read it back."""
    spark = stream.sparkSession
    place = folder or scratch_dir(spark, label)
    query = (
        stream.writeStream.outputMode(mode).format("parquet").option("checkpointLocation", f"{place}/_progress")
        .trigger(availableNow=True).start(f"{place}/rows")
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{place}/rows")


_STORE = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """Queries that start inside keep their state in RocksDB, which map states and timers need."""
    before = spark.conf.get(_STORE, None)
    spark.conf.set(_STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_STORE)
        else:
            spark.conf.set(_STORE, before)


def state_left(stream: DataFrame, label: str) -> int:
    """Process everything available; how many keys still have state after the last sweep."""
    place = scratch_dir(stream.sparkSession, label)
    query = (
        stream.writeStream.format("parquet").option("checkpointLocation", f"{place}/_progress")
        .trigger(availableNow=True).start(f"{place}/rows")
    )
    query.awaitTermination()
    return [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]][-1]


def drain_latest(stream: DataFrame, label: str, keys: list[str] | None) -> DataFrame:
    """Process everything available and return the last word on every row, open windows included.

    With ``keys`` each batch reports what has changed (state ends with the watermark) and the last report of a key
    counts. Without, for aggregates that cannot report changes, the last batch reports everything. A retried
    batch overwrites its own folder.
    """
    spark = stream.sparkSession
    place = scratch_dir(spark, label)

    def batch(df: DataFrame, number: int) -> None:
        df.withColumn("__batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{place}/rows/__part={number}")

    query = (
        stream.writeStream.outputMode("update" if keys else "complete").option("checkpointLocation", f"{place}/_progress")
        .trigger(availableNow=True).foreachBatch(batch).start()
    )
    query.awaitTermination()
    rows = spark.read.parquet(f"{place}/rows").drop("__part")
    if keys:
        return first_row(rows, keys, F.col("__batch"), largest=True).select(*stream.columns)
    last = rows.agg(F.max("__batch").alias("__batch"))
    return rows.join(last, "__batch", "left_semi").select(*stream.columns)


def append_audit(entries: DataFrame, metadata: str) -> DataFrame:
    """Audit entries with scrubbed metadata, ready for an append-only sink."""
    return entries.withColumn(metadata, scrub_json(metadata))


def known_results(spark: SparkSession, folder: str) -> DataFrame | None:
    """The cache so far, or None before its first batch."""
    try:
        return spark.read.option("basePath", folder).parquet(folder)
    except AnalysisException as missing:
        if missing.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


#: Parts of the cache; a batch reads those that its files fall into.
PARTS = 64


def _part() -> Column:
    return F.pmod(F.xxhash64(*KEY), F.lit(PARTS)).cast("int").alias("part")


def analyse_new_files(
    files: DataFrame, analyse: Callable[[DataFrame], DataFrame], cache_folder: str, progress: str,
) -> None:
    """Analyse new or changed files only, batch by batch; results go to an append-only cache.

    ``files`` streams (namespace, path, size, mtime_s). Each batch drops what the cache already has
    with the same signature, so a file that comes again unchanged is not analysed again, by this
    stream or another one. The cache is partitioned by a hash of the key, and a batch reads the parts of its own
    files only. A batch that is retried overwrites its own folder, so nothing is stored twice.
    """
    tag = md5(progress.encode()).hexdigest()[:12]

    def batch(df: DataFrame, number: int) -> None:
        spark = df.sparkSession
        fresh = df.dropDuplicates([*KEY, *SIGNATURE])
        known = known_results(spark, cache_folder)
        if known is not None:
            touched = [r[0] for r in df.select(_part()).distinct().collect()]  # at most PARTS numbers
            mine = (F.col("run") == tag) & (F.col("batch") >= number)
            fresh = to_recompute(fresh, known.filter(F.col("part").isin(touched) & ~mine).select(*KEY, *SIGNATURE))
        done = analyse(fresh)
        done.select("*", _part()).repartition("part").write.mode("overwrite").partitionBy("part").parquet(f"{cache_folder}/run={tag}/batch={number}")

    query = files.writeStream.option("checkpointLocation", progress).trigger(availableNow=True).foreachBatch(batch).start()
    query.awaitTermination()
