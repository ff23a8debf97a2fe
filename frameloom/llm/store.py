"""Tables in the shared folder that cut lineage, and batch kernels over whole texts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from frameloom.session import stored


__all__ = ["per_batch", "stored"]


def per_batch(df: DataFrame, kernel: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """Apply a kernel to every Arrow batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and (out := kernel(batch)) is not None:
                yield out

    return df.mapInArrow(run, schema)
