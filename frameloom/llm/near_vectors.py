"""Embedding near-dedup: an exact cosine join by a subspace pigeonhole.

Unit vectors with cosine c have squared distance 2 - 2c. They are rotated by a fixed random rotation and cut
into blocks of eight coordinates; if the whole squared distance is within the budget, that of some block is
within its eighth (share by dimensions). So the vectors of a label are range-joined block by block: a grid over the
first coordinates of a block, in which a vector has its home cell and is also sent to the larger cells that
its range reaches. The grid takes one more coordinate each time the label doubles, so cells stay small. What
meets in a cell and keeps the block's budget is verified in double precision; a pair counts in the first block
that holds it, so nothing is counted twice.

A cell that is still large is cut into chunks, and every two chunks meet in a task of their own, so
memory is bounded. Equal vectors collapse first. Cells return the number of links of each vector and a spanning
forest of them, never the pairs. A heap of different vectors that are all alike costs time with the square of
its size, since every one of its links must be counted, but neither memory nor rows.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components, and rows without a label,
link with nothing; vectors of different lengths are not compared; equal vectors are linked with
each other; rows with one id are rows of their own with the same results only if their vectors are equal, and one node
of the components; a null id takes no part in links and has no component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from frameloom.llm.graph import components
from frameloom.llm.store import per_batch, stored

COSINE = 0.98
BLOCK = 8
#: Vectors that a cell of the grid, and a chunk of a large cell, holds on average.
CELL_ROWS = 2000
SLACK = 1e-7


def rotation(size: int, seed: int = 1) -> np.ndarray:
    """A fixed random rotation."""
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(size, size)))
    return q * np.sign(np.diag(r))


def block_edges(size: int) -> list[int]:
    return [*range(0, size, BLOCK), size]


def _rotated(raw: np.ndarray) -> np.ndarray:
    unit = raw / np.linalg.norm(raw, axis=1, keepdims=True)
    return unit @ rotation(raw.shape[1])


def _cells(x: np.ndarray, grid: np.ndarray, radius: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, cells): the home cells first, then larger cells in reach. ``grid``: coordinates used by each row."""
    width = 4 * radius
    place = np.floor(x / width).astype(np.int64)
    low, high = x - place * width, (place + 1) * width - x
    step = np.where(low < high, -1, 1)
    away = np.minimum(low, high)
    n, dims = x.shape
    used = np.arange(dims)[None, :] < grid[:, None]
    half = int(np.ceil(1 / width)) + 1
    base = 2 * half + 1
    power = np.array([base**k for k in range(dims)], np.int64)
    home = ((place + half) * power * used).sum(1)
    yield np.arange(n), home
    for mask in range(1, 1 << int(grid.max(initial=0))):
        picked = np.array([mask >> k & 1 for k in range(dims)], bool)
        fits = (used | ~picked[None, :]).all(1) & ((away**2 * picked).sum(1) <= radius**2 + 2 * SLACK)
        cell = home + (step * power * picked).sum(1)
        rows = np.flatnonzero(fits & (cell > home))
        if len(rows):
            yield rows, cell[rows]


def _deal(vectors: DataFrame, budget: float) -> DataFrame:
    """(label, size, block, cell, home, id, copies, vector) for every cell a vector belongs to."""
    schema = pa.schema([
        ("label", pa.string()), ("size", pa.int32()), ("block", pa.int32()), ("cell", pa.int64()), ("home", pa.bool_()),
        ("id", pa.int64()), ("copies", pa.int64()), ("vector", pa.binary()),
    ])

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        label, ids, copies, grid, vector = (batch.column(i) for i in range(5))
        sizes = np.array([len(v) for v in vector])
        parts = []
        for size in np.unique(sizes):
            at = np.flatnonzero(sizes == size)
            raw = np.stack([np.asarray(vector[int(i)].values, np.float64) for i in at])
            packed = pa.array([row.tobytes() for row in raw], pa.binary())
            x, depth = _rotated(raw), np.asarray(grid)[at]
            edges = block_edges(int(size))
            for block, (lo, hi) in enumerate(zip(edges, edges[1:])):
                radius = np.sqrt(budget * (hi - lo) / size)
                for k, (rows, cell) in enumerate(_cells(x[:, lo:hi], np.minimum(depth, hi - lo), radius)):
                    pick = pa.array(at[rows])
                    n = len(rows)
                    parts.append(pa.RecordBatch.from_arrays([
                        label.take(pick), pa.array(np.full(n, size, np.int32)), pa.array(np.full(n, block, np.int32)), pa.array(cell),
                        pa.array(np.full(n, k == 0)), ids.take(pick), copies.take(pick), packed.take(pa.array(rows)),
                    ], schema=schema))
        return pa.Table.from_batches(parts, schema).combine_chunks().to_batches()[0] if parts else None

    return per_batch(
        vectors.select("label", "id", "copies", "grid", "vector"), kernel,
        "label string, size int, block int, cell long, home boolean, id long, copies long, vector binary",
    )


def _tile(rows: dict[str, np.ndarray], block: int, threshold: float, budget: float, same: bool):
    """Links between the two sides of a tile (or inside one): for each row the copies linked, and pairs found."""
    raw = rows["raw"]
    n, size = raw.shape
    x, edges = _rotated(raw), block_edges(size)
    norm = np.linalg.norm(raw, axis=1)
    linked = np.zeros(n, np.int64)
    parent = np.arange(n)

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    left = np.arange(n) if same else np.flatnonzero(rows["side"] == 0)
    right = left if same else np.flatnonzero(rows["side"] == 1)
    for a in range(0, len(left), 512):
        i = left[a : a + 512]
        lo, hi = edges[block], edges[block + 1]
        near = _distance(x[i, lo:hi], x[right, lo:hi]) <= budget * (hi - lo) / size + 2 * SLACK
        if same:
            near &= right[None, :] > i[:, None]
        near &= rows["home"][i][:, None] | rows["home"][right][None, :]  # two visitors meet elsewhere
        p, q = np.nonzero(near)
        for s in range(0, len(p), 1 << 16):
            u, v = i[p[s : s + (1 << 16)]], right[q[s : s + (1 << 16)]]
            good = np.einsum("ij,ij->i", raw[u], raw[v]) / (norm[u] * norm[v]) >= threshold
            u, v = u[good], v[good]
            # in this block and in no earlier one, by one and the same sum
            first = ((x[u, lo:hi] - x[v, lo:hi]) ** 2).sum(1) <= budget * (hi - lo) / size + SLACK
            for e, (lo2, hi2) in enumerate(zip(edges[:block], edges[1 : block + 1])):
                d = ((x[u, lo2:hi2] - x[v, lo2:hi2]) ** 2).sum(1)
                first &= d > budget * (hi2 - lo2) / size + SLACK
            u, v = u[first], v[first]
            np.add.at(linked, u, rows["copies"][v])
            np.add.at(linked, v, rows["copies"][u])
            # many pairs, few trees: only pairs of different trees reach the Python loop
            while len(u):
                roots = _roots(parent)
                apart = roots[u] != roots[v]
                u, v = u[apart], v[apart]
                if len(u):
                    _, at = np.unique(roots[u], return_index=True)
                    for a1, b1 in zip(u[at].tolist(), v[at].tolist()):
                        x1, y1 = root(a1), root(b1)
                        if x1 != y1:
                            parent[max(x1, y1)] = min(x1, y1)
    return linked, _roots(parent)


def _roots(parent: np.ndarray) -> np.ndarray:
    while True:
        up = parent[parent]
        if (up == parent).all():
            return up
        parent = up


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T


def _join(dealt: DataFrame, threshold: float, budget: float) -> DataFrame:
    """(id, linked, root) from every tile; a tile is a cell, or two chunks of a large cell."""
    cell = ["label", "size", "block", "cell"]
    chunks = F.ceil(F.count("*").over(Window.partitionBy(*cell)) / CELL_ROWS).cast("int")
    cut = dealt.withColumn("chunks", chunks).withColumn("chunk", F.pmod(F.xxhash64("id"), "chunks").cast("int"))
    # chunk i meets every chunk: tile (i, j) holds i on side 0 and j on side 1, tile (i, i) both
    every = F.sequence(F.lit(0), F.col("chunks") - 1)
    tiles = cut.withColumn("other", F.explode(every)).select(
        *cell, F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"),
        F.when(F.col("chunk") <= F.col("other"), 0).otherwise(1).alias("side"), "home", "id", "copies", "vector",
    )
    key = [*cell, "i", "j"]
    ordered = tiles.repartition(*key).sortWithinPartitions(*key, "id").select(*key, "side", "home", "id", "copies", "vector")
    schema = pa.schema([("id", pa.int64()), ("linked", pa.int64()), ("root", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(now, held):
            table = pa.Table.from_batches(held)
            ids = table["id"].to_numpy()
            if len(ids) < 2:
                return None
            raw = np.frombuffer(b"".join(table["vector"].to_pylist()), np.float64).reshape(len(ids), -1)
            rows = {"raw": raw, "side": table["side"].to_numpy(), "home": table["home"].to_numpy(), "copies": table["copies"].to_numpy()}
            linked, roots = _tile(rows, now[2], threshold, budget, now[4] == now[5])
            hit = np.flatnonzero(linked)
            return pa.RecordBatch.from_arrays([pa.array(ids[hit]), pa.array(linked[hit]), pa.array(ids[roots[hit]])], schema=schema) if len(hit) else None

        held, now = [], None
        for batch in batches:
            keys = list(zip(*(batch.column(k).to_pylist() for k in range(6))))
            start = 0
            for k in range(1, len(keys) + 1):
                if k == len(keys) or keys[k] != keys[start]:
                    if keys[start] != now:
                        if held and (out := done(now, held)) is not None:
                            yield out
                        held, now = [], keys[start]
                    held.append(batch.slice(start, k - start))
                    start = k
        if held and (out := done(now, held)) is not None:
            yield out

    return ordered.mapInArrow(run, "id long, linked long, root long")


def near_vectors(
    df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = COSINE
) -> DataFrame:
    """(vec_id, n_links, component_id, kept, copies) of every row."""
    budget = 2 - 2 * threshold
    rows = df.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("vector"), F.col(label).cast("string").alias("label"))
    size = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x))
    sound = (
        F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("vector") > 0) & ~F.exists("vector", lambda x: x.isNull())
        & (size > 0) & (size < F.lit(float("inf"))) & ~F.isnan(size)
    )
    rows = rows.withColumn("sound", F.coalesce(sound, F.lit(False)))
    equal = stored(
        rows.where("sound").groupBy("label", "vector").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies")), "vectors"
    )
    per_label = equal.groupBy("label").agg(F.greatest(F.ceil(F.log2(F.count("*") / CELL_ROWS)), F.lit(0)).cast("int").alias("grid"))
    dealt = _deal(equal.join(per_label, "label"), budget)
    found = stored(_join(dealt, threshold, budget), "links")
    part = components(found.where("id != root").select(F.col("id").alias("a"), F.col("root").alias("b")))
    linked = found.groupBy(F.col("id").alias("i")).agg(F.sum("linked").alias("linked"))
    whole = (
        equal.join(linked, F.col("id") == F.col("i"), "left")
        .select("label", "vector", "copies", F.col("id").alias("rep"), (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
        .join(part, F.col("rep") == F.col("id"), "left")
        .select("label", "vector", "copies", "n_links", F.coalesce("component_id", "rep").alias("part"))
    )
    plain = rows.where("sound").join(whole, ["label", "vector"]).select(
        "vec_id", "n_links", F.col("part").alias("component_id"), (F.col("vec_id") == F.col("part")).alias("kept"), "copies"
    )
    other = rows.where("NOT sound").select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"), F.lit(1).cast("long").alias("copies")
    )
    return plain.unionAll(other)
