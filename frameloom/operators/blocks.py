"""All-against-all work inside groups, cut into cells of bounded size.

Used only where a distance limit is too loose for an index to help. Rows of a group are
spread over blocks by hash; a cell holds two blocks and meets them tile by tile, so the kernel sees at
most ``block_rows`` rows a side. A group has at most ``MOST_BLOCKS`` blocks, which bounds the copies of a row, until
a block would exceed ``MOST_TILES`` tiles. Cells return reduced rows (nearest neighbour, histogram, pairs under a limit),
never every pair; where many pairs are under the limit their rows leave the task in parts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK_ROWS = 2_000
# A row is copied once for each block of its group: up to 32 blocks the copies grow, then the blocks do, to 64,000 rows.
MOST_BLOCKS, MOST_TILES = 32, 32
# Rows found in the tiles of a cell are handed on as soon as there are so many.
FOUND_ROWS = 1_000_000


def in_cells(rows: DataFrame, group: list[str], key: str, block_rows: int) -> DataFrame:
    """Every row once for each block of its group, with its own block and the two of the cell."""
    tiles = F.ceil(F.count(F.lit(1)) / F.lit(block_rows))
    blocks = F.least(tiles, F.greatest(F.lit(MOST_BLOCKS), F.ceil(tiles / F.lit(MOST_TILES))))
    sizes = rows.groupBy(*group).agg(blocks.cast("int").alias("__blocks"))
    own = F.pmod(F.xxhash64(key), F.col("__blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("__blocks") - 1))
    return (
        rows.join(sizes, group)
        .withColumn("__own", own)
        .withColumn("__other", other)
        .withColumn("__low", F.least("__own", "__other"))
        .withColumn("__high", F.greatest("__own", "__other"))
        .drop("__other", "__blocks")
    )


def per_cell(
    df: DataFrame,
    by: Sequence[str],
    key: str,
    columns: Sequence[str],
    kernel: Callable,
    schema: str,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Apply ``kernel(keys, left, right, diagonal)`` to every cell of every group.

    ``left`` and ``right`` are pandas frames of ``key`` and ``columns``; on the diagonal both
    are the same tile. The kernel returns a pandas frame with ``schema``.
    """
    by = list(by)
    group = by or ["__all"]
    rows = df.select(*by, key, *columns)
    if not by:
        rows = rows.withColumn("__all", F.lit(0))
    placed, most = in_cells(rows, group, key, block_rows), FOUND_ROWS
    cell = [*group, "__low", "__high"]

    def run(k: tuple, parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(parts, ignore_index=True)
        low, high = k[-2], k[-1]
        left = pdf[pdf["__own"] == low]
        if low == high:
            cuts = range(0, len(left), block_rows)
            pairs = [(left[i : i + block_rows], left[j : j + block_rows], i == j) for i in cuts for j in cuts if i <= j]
        else:
            right = pdf[pdf["__own"] == high]
            pairs = [
                (left[i : i + block_rows], right[j : j + block_rows], False)
                for i in range(0, len(left), block_rows) for j in range(0, len(right), block_rows)
            ]
        found, rows = [], 0
        for one, two, diagonal in pairs:
            found.append(kernel(k[: len(by)], one, two, diagonal))
            rows += len(found[-1])
            if rows >= most:
                yield pd.concat(found)
                found, rows = [], 0
        if found:
            yield pd.concat(found)

    return placed.groupBy(*cell).applyInPandas(run, schema)
