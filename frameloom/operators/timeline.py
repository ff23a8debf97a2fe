"""Events by time gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frameloom.operators.ordered import OrderedGroups

# Fixed value: a longer pause than this starts a new event.
EVENT_GAP_SECONDS = 45 * 60


def seconds(ts: Column | str) -> Column:
    ts = F.col(ts) if isinstance(ts, str) else ts
    return F.unix_micros(ts.cast("timestamp")) / F.lit(1_000_000.0)


def gap_segments(
    df: DataFrame, by: list[str], time: str, path: str,
    gap_seconds: float = EVENT_GAP_SECONDS, name: str = "segment", hot_rows: int | None = None,
) -> DataFrame:
    """Add the zero-based event number inside each group, in (time, path) order.

    A pause of exactly ``gap_seconds`` still belongs to the event.
    """
    if gap_seconds < 0:
        raise ValueError(f"gap_seconds must be >= 0, got {gap_seconds}")
    walk = OrderedGroups(df, by, [F.col(time), F.col(path)], hot_rows)
    walk.previous(time, "__before")
    pause = seconds(time) - seconds("__before")
    walk.running_sum(F.when(pause > gap_seconds, 1).otherwise(0), name)
    return walk.df.drop("__before")


def segment_bounds(segmented: DataFrame, by: list[str], time: str, path: str, name: str = "segment") -> DataFrame:
    """One row per event: first and last moment, first photo, number of photos."""
    return segmented.groupBy(*by, name).agg(
        F.min(time).alias("start_time"),
        F.max(time).alias("end_time"),
        F.min(F.struct(time, path))[path].alias("first_path"),
        F.count(F.lit(1)).alias("photos"),
    )
