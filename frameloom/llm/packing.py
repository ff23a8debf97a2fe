"""Best-fit packing under conflicts: no bin holds two documents of one source or of one duplicate cluster.

Documents go in falling order of length. Open bins stand in order of what is left in them; each bin
carries a bitmap of its sources and clusters, and the search goes on from the tightest bin that is
large enough to the first that is also compatible; failing that, a new bin is opened. A document longer
than a bin is cut into full pieces, which fill bins of their own, and a rest, which is packed.

Packing is done in shards of bounded size, drawn by a hash of the row and, for repeated rows, the number of the copy,
so no source, cluster or group of equal rows, however large, meets in one task; the shards' bins are separate. Equal
rows travel as one row with a count up to there.

Defined cases: a null length counts as 0; a length of 0 takes no room but a place (its bin is bound by the
conflicts like any other); null sources or clusters conflict with nothing; repeated rows are packed as rows
of their own; ties in length go by id, then source and cluster; lengths of any size are cut, so a very long text gives as
many pieces as it fills bins; an empty table gives no bins; other columns are dropped (join the bins back by id).
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frameloom.llm.store import stored

#: Words in a bin.
CAPACITY = 2048
#: Documents in a shard, on average: bounds the memory and the time of a task whatever the skew.
SHARD_ROWS = 4096
#: Equal rows that are unfolded together.
COPIES = 4096
SCHEMA = "doc_id long, piece int, start long, length long, shard int, bin long, bin_left long"


def best_fit(items: list[tuple[int, int]], capacity: int) -> list[int]:
    """Bin number of each (length, conflict bitmap), given in the order of packing."""
    open_bins: list[tuple[int, int]] = []  # (room left, bin), ordered
    carried: list[int] = []
    out = []
    for length, bits in items:
        at = bisect_left(open_bins, (length, -1))
        while at < len(open_bins) and carried[open_bins[at][1]] & bits:
            at += 1
        if at < len(open_bins):
            left, number = open_bins.pop(at)
            carried[number] |= bits
        else:
            left, number = capacity, len(carried)
            carried.append(bits)
        insort(open_bins, (left - length, number))
        out.append(number)
    return out


def _bitmaps(columns: list[list]) -> list[int]:
    """One bit for every value that occurs at least twice; others conflict with nothing."""
    bits, used = [0] * len(columns[0]), 0
    for values in columns:
        count: dict = {}
        for v in values:
            count[v] = count.get(v, 0) + 1
        bit = {}
        for i, v in enumerate(values):
            if v is not None and count[v] > 1:
                if v not in bit:
                    bit[v] = 1 << used
                    used += 1
                bits[i] |= bit[v]
    return bits


def _pack_shard(rows: list[tuple], shard: int, capacity: int) -> list[tuple]:
    """rows: (doc_id, length, source, cluster) in order of packing."""
    bits = _bitmaps([[r[2] for r in rows], [r[3] for r in rows]])
    rest = [(length % capacity if length > capacity else length, b) for (_, length, _, _), b in zip(rows, bits)]
    order = sorted(range(len(rows)), key=lambda i: (-rest[i][0], i))
    bins = dict(zip(order, best_fit([rest[i] for i in order], capacity)))
    out, extra = [], max(bins.values(), default=-1) + 1
    for i, (doc, length, _, _) in enumerate(rows):
        full = length // capacity if length > capacity else 0
        for piece in range(full):
            out.append((doc, piece, piece * capacity, capacity, shard, extra))
            extra += 1
        if rest[i][0] or not full:
            out.append((doc, full, full * capacity, rest[i][0], shard, bins[i]))
    left: dict[int, int] = {}
    for row in out:
        left[row[5]] = left.get(row[5], capacity) - row[3]
    return [(*row, left[row[5]]) for row in out]


def _unfolded(slim: DataFrame) -> DataFrame:
    """The rows with ``copy``, the number of each among equal ones; large groups are dealt to tasks in parts."""
    counted = slim.groupBy(*slim.columns).agg(F.count("*").alias("n"))
    last = F.floor((F.col("n") - 1) / COPIES)
    parts = counted.select("*", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("part")).repartition(*slim.columns, "part")
    first = F.col("part") * COPIES
    return parts.select(*slim.columns, F.explode(F.sequence(first, F.least(first + COPIES, "n") - 1)).alias("copy"))


def pack(
    df: DataFrame, doc: str = "doc_id", length: str = "length", source: str = "source", cluster: str = "cluster",
    capacity: int = CAPACITY, shard_rows: int = SHARD_ROWS,
) -> DataFrame:
    """One row per piece: (doc_id, piece, start, length, shard, bin, bin_left); a bin is (shard, bin)."""
    slim = df.select(
        F.col(doc).cast("long").alias("doc_id"), F.greatest(F.coalesce(F.col(length).cast("long"), F.lit(0)), F.lit(0)).alias("length"),
        F.col(source).cast("string").alias("source"), F.col(cluster).cast("string").alias("cluster"),
    )
    slim = stored(_unfolded(slim), "pack")
    shards = max(1, -(-slim.count() // shard_rows))
    slots = slim.sparkSession.conf.get("spark.sql.shuffle.partitions")
    dealt = (
        slim.withColumn("shard", F.pmod(F.xxhash64("doc_id", "length", "source", "cluster", "copy", F.lit(3)), F.lit(shards)).cast("int"))
        .repartition(max(1, min(shards, int(slots) * 8)), "shard")
        .sortWithinPartitions("shard", F.desc("length"), "doc_id", "source", "cluster")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("shard", pa.int32()), ("bin", pa.int64()), ("bin_left", pa.int64())])

        def packed(rows, shard):
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*_pack_shard(rows, shard, capacity)), schema)], schema=schema)

        rows, now = [], None
        for batch in batches:
            for doc_id, size, src, clu, shard in zip(*(c.to_pylist() for c in batch.columns)):
                if shard != now and rows:
                    yield packed(rows, now)
                    rows = []
                now = shard
                rows.append((doc_id, size, src, clu))
        if rows:
            yield packed(rows, now)

    return dealt.select("doc_id", "length", "source", "cluster", "shard").mapInArrow(run, SCHEMA)
