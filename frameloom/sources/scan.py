"""File listings as tables: media files, capture times, labelled folders, decode failures."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from frameloom.functions.scalar import col, suffix

# Default media suffixes.
MEDIA_SUFFIXES = (".jpg", ".jpeg", ".png", ".bmp", ".tif", ".tiff")
EXIF_TIME = "yyyy:MM:dd HH:mm:ss"


def is_media(path: Column | str, suffixes: Iterable[str] = MEDIA_SUFFIXES, exclude: Iterable[str] = (), root: str = "") -> Column:
    """Suffix in the list and no excluded folder below ``root``; both compared in lower case."""
    wanted = [s.lower() for s in suffixes]
    if not wanted or any(not s.startswith(".") for s in wanted):
        raise ValueError("suffixes must be non-empty and start with a dot")
    p = col(path)
    keep = suffix(p).isin(*wanted)
    barred = [e.lower() for e in exclude]
    if barred:
        below = F.substring(p, F.lit(len(root) + 1), F.length(p)) if root else p
        keep = keep & ~F.arrays_overlap(F.split(F.lower(below), "/"), F.lit(barred))
    return keep


def scan_media(spark: SparkSession, root: str, suffixes: Iterable[str] = MEDIA_SUFFIXES, exclude: Iterable[str] = ()) -> DataFrame:
    """(path, size, mtime) of the media files below ``root``, sorted by path.

    The file content is never read: only listing columns are selected. A missing root raises.
    """
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
        .select("path", F.col("length").alias("size"), F.col("modificationTime").alias("mtime"))
    )
    kept = files.withColumn("__rel", below_root("path", root)).filter(is_media("__rel", suffixes, exclude)).drop("__rel")
    return kept.orderBy("path")


def below_root(path: Column | str, root: str) -> Column:
    """The part of ``path`` below ``root``, which is taken literally; a path elsewhere is kept whole.

    A scheme and host before the root, as listings add them, do not count.
    """
    p, head = col(path), root.rstrip("/").split("://")[-1].removeprefix("file:") + "/"
    at = F.instr(p, head)
    return F.when(at > 0, F.substring(p, at + F.lit(len(head)), F.length(p))).otherwise(p)


def scan_with_limit(files: DataFrame, limit: int, path: str = "path") -> DataFrame:
    """The first ``limit`` files in path order; 0 keeps all."""
    ordered = files.orderBy(path)
    return ordered.limit(limit) if limit else ordered


def capture_time(exif: Column | str, mtime: Column | str) -> Column:
    """EXIF original time, else modification time, else the epoch; local and without a zone."""
    parsed = F.try_to_timestamp(F.trim(col(exif)), F.lit(EXIF_TIME)).cast("timestamp_ntz")
    return F.coalesce(parsed, col(mtime).cast("timestamp_ntz"), F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))


def folder_label(path: Column | str, flat: bool = False) -> Column:
    """Parent folder as label; a flat folder has none."""
    return F.lit("") if flat else F.coalesce(F.get(F.reverse(F.split(col(path), "/")), F.lit(1)), F.lit(""))


def quarantine_split(rows: DataFrame, failed: Column) -> tuple[DataFrame, DataFrame]:
    """(readable, failures): a bad row never stops a run."""
    bad = F.coalesce(failed, F.lit(True))
    return rows.filter(~bad), rows.filter(bad)


def run_flags(rows: DataFrame, unreadable: Column, faces_failed: Column) -> DataFrame:
    """One row: counts of failures and whether they hit every photo of a non-empty run."""
    n = F.count(F.lit(1))

    def every(test: Column) -> Column:
        return (n > 0) & (F.count_if(test) == n)

    return rows.agg(
        n.alias("scanned"), F.count_if(unreadable).alias("unreadable"), F.count_if(faces_failed).alias("face_failures"),
        every(unreadable).alias("all_unreadable"), every(faces_failed).alias("all_faces_failed"),
    )
