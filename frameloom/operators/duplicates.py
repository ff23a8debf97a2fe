"""Exact and near duplicates: Hamming joins, founder groups, representatives."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frameloom.operators.blocks import per_cell
from frameloom.operators.ordered import first_row
from frameloom.session import cut

BANDS = 8
# Pairs one bucket may cost before its members are split further.
BUCKET_PAIRS = 4_000_000
# Splits of a bucket by its remaining bits; the table of choices has 56 ** DEPTH rows at most. At five bits
# 16 bits are then open. A bucket that is still busy is dealt to SALTS tasks.
DEPTH, SALTS = 2, 32
# Limits of BANDS up to FLIP_LIMIT bits meet in FLIP_BANDS wide bands that may differ by a few bits each.
FLIP_BANDS, FLIP_LIMIT = 3, 10
# Distinct hashes settled in the first pass of the founder search; each later pass is
# three times as large, so the number of passes grows with the logarithm of the data.
FIRST_PASS = 200_000


def _bands(free: list[int]) -> list[int]:
    """Eight masks that share out the bit positions ``free`` in order."""
    edges = [round(i * len(free) / BANDS) for i in range(BANDS + 1)]
    return [sum(1 << bit for bit in free[a:b]) for a, b in zip(edges, edges[1:])]


def _choices(distance: int) -> list[tuple[int, ...]]:
    """Two values at most ``distance`` bits apart agree on at least 8 - distance bands."""
    return list(combinations(range(BANDS), BANDS - distance))


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >= 1 << 63 else mask


def _levels(bits: int, distance: int, depth: int) -> list[tuple]:
    """Rows (choice per level so far..., masks of the bands to choose from at ``depth``).

    The bands of a deeper level share out the bits that the levels above left open. The
    table depends on ``bits`` and ``distance`` only: 1, 56 or 3136 rows at the usual 5.
    """
    rows = [((), list(range(bits)))]
    for _ in range(depth):
        deeper = []
        for path, free in rows:
            bands = _bands(free)
            for n, chosen in enumerate(_choices(distance)):
                used = sum(bands[i] for i in chosen)
                deeper.append(((*path, n), [bit for bit in free if not used >> bit & 1]))
        rows = deeper
    return [(*path, [_signed(m) for m in _bands(free)]) for path, free in rows]


def _first_choice(difference: Column, bands: Column, distance: int) -> Column:
    """Number of the choice that reports a pair: the lowest bands it agrees on."""
    need = BANDS - distance
    number = {chosen: n for n, chosen in enumerate(_choices(distance))}
    table = []
    for agreed in range(1 << BANDS):
        lowest = tuple(i for i in range(BANDS) if agreed >> i & 1)[:need]
        table.append(number.get(lowest, -1))
    agreed = F.lit(0)
    for i in range(BANDS):
        same = difference.bitwiseAND(bands[i]) == 0
        agreed = agreed + F.when(same, F.lit(1 << i)).otherwise(F.lit(0))
    return F.element_at(F.lit(table), agreed + 1)


def _dealt(side: DataFrame) -> DataFrame:
    """Hashes over all tasks ahead of their explosion: their table is small and would be read by one."""
    return side.repartition(int(side.sparkSession.conf.get("spark.sql.shuffle.partitions")), "hash")


def _merged(side: DataFrame) -> DataFrame:
    """To the planner exploded rows are as small as the table they come from; it would broadcast them."""
    return side.hint("merge")


def hamming_join(
    left: DataFrame,
    right: DataFrame,
    distance: int,
    bits: int = 64,
    bucket_pairs: int = BUCKET_PAIRS,
) -> DataFrame:
    """Exact pairs (a, b, distance) of hashes at most ``distance`` bits apart.

    Both sides are one-column frames of distinct hashes (column ``hash``). Up to 7 bits the
    join runs on shared bands, and a bucket that too many hashes share is split again by
    its remaining bits. From 8 to 10 bits it runs on wide bands with few bits flipped on each
    side. Looser limits, under which most pairs share any such bucket, compare blocks of bounded size.
    """
    if distance == 0:
        same = left.join(right, "hash", "left_semi")
        return same.select(
            F.col("hash").alias("a"), F.col("hash").alias("b"), F.lit(0).cast("long").alias("distance")
        )
    if BANDS <= distance <= FLIP_LIMIT:
        return _flip_join(left, right, distance, bits, bucket_pairs)
    if distance >= BANDS:
        return _cells(left, right, distance)
    a = _dealt(left).select(F.col("hash").alias("a"))
    b = _dealt(right).select(F.col("hash").alias("b"))
    return _meet(a, b, [], bits, distance, bucket_pairs).select("a", "b", "distance")


def _meet(a: DataFrame, b: DataFrame, keys: list[str], bits: int, distance: int, limit: int) -> DataFrame:
    depth = len(keys) // 2
    path = [f"choice{i}" for i in range(depth)]
    choice, bucket, bands = f"choice{depth}", f"bucket{depth}", f"bands{depth}"
    rows = _levels(bits, distance, depth)
    table = a.sparkSession.createDataFrame(
        rows, ", ".join([*(f"{p} int" for p in path), f"{bands} array<long>"])
    )

    # Above the first split the bands are the same for all rows, and no row carries them.
    masked = F.col(bands) if path else F.lit(rows[0][0])

    def spread(df: DataFrame, value: str) -> DataFrame:
        wide = df.join(F.broadcast(table), path) if path else df
        masks = []
        for chosen in _choices(distance):
            mask = F.lit(0).cast("long")
            for i in chosen:
                mask = mask.bitwiseOR(masked[i])
            masks.append(mask)
        return (
            wide.select("*", F.posexplode(F.array(*masks)).alias(choice, "__mask"))
            .withColumn(bucket, F.col(value).bitwiseAND(F.col("__mask")))
            .drop("__mask")
        )

    a, b = spread(a, "a"), spread(b, "b").drop(bands)
    on = [*keys, choice, bucket]
    load = (
        a.groupBy(*on).agg(F.count(F.lit(1)).alias("na"))
        .join(_merged(b.groupBy(*on).agg(F.count(F.lit(1)).alias("nb"))), on)
        .filter(F.col("na") * F.col("nb") > limit)
        .select(*on)
    )
    load = cut(load)
    busy = load if load.take(1) else None
    plain = a if busy is None else a.join(busy, on, "left_anti")
    difference = F.col("a").bitwiseXOR(F.col("b"))

    def near(pairs: DataFrame) -> DataFrame:
        return (
            pairs.withColumn("distance", F.bit_count(difference).cast("long"))
            .filter(F.col("distance") <= distance)
            .filter(F.col(choice) == _first_choice(difference, masked, distance))
            .select("a", "b", "distance", *keys)
        )

    found = near(plain.join(_merged(b), on))
    if busy is None:
        return found
    if depth == DEPTH:
        # What is left open tells too few apart to split further: one side is dealt to salts, the other copied.
        left = a.join(busy, on, "left_semi").withColumn("salt", F.pmod(F.xxhash64("a"), F.lit(SALTS)).cast("int"))
        right = b.join(busy, on, "left_semi").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        return found.unionByName(near(left.join(_merged(right), [*on, "salt"])))
    crowded_a = a.join(busy, on, "left_semi").drop(bands)
    crowded_b = b.join(busy, on, "left_semi")
    here = table.withColumnRenamed(bands, "__here")
    deep = _meet(crowded_a, crowded_b, on, bits, distance, limit)
    deep = deep.join(F.broadcast(here), path) if path else deep.withColumn("__here", F.lit(rows[0][0]))
    deep = deep.filter(F.col(choice) == _first_choice(difference, F.col("__here"), distance))
    return found.unionByName(deep.select("a", "b", "distance", *keys))


def _radii(distance: int) -> list[int]:
    """Bits by which each wide band may differ: if all differed by more, the sum would exceed ``distance``."""
    total = distance + 1 - FLIP_BANDS
    return [total // FLIP_BANDS + (i < total % FLIP_BANDS) for i in range(FLIP_BANDS)]


def _flips(width: int, most: int) -> list[int]:
    return [sum(1 << bit for bit in chosen) for n in range(most + 1) for chosen in combinations(range(width), n)]


def _flip_join(left: DataFrame, right: DataFrame, distance: int, bits: int, limit: int) -> DataFrame:
    """Pairs that differ by few bits in one of three wide bands.

    Each side offers its band with up to half of those bits flipped, so both meet half way. The left side flips the
    lower half of the differing bits and the right side the upper, which leaves one meeting place a band, and a
    pair is reported in its first band that is near enough. Busy buckets are dealt to salts.
    """
    radii = _radii(distance)
    edges = [round(i * bits / FLIP_BANDS) for i in range(FLIP_BANDS + 1)]
    widths = [b - a for a, b in zip(edges, edges[1:])]

    def part(value: Column, band: int) -> Column:
        return F.shiftrightunsigned(value, edges[band]).bitwiseAND((1 << widths[band]) - 1)

    def offered(df: DataFrame, value: str, flip: str, most: list[int]) -> DataFrame:
        def way(band: int) -> Column:
            flips = F.array(*map(F.lit, _flips(widths[band], most[band]))).cast("array<bigint>")
            own = part(F.col(value), band)
            return F.transform(flips, lambda u: F.struct(F.lit(band).alias("band"), own.bitwiseXOR(u).alias("key"), u.alias(flip)))

        ways = [way(band) for band in range(FLIP_BANDS)]
        return df.select(F.col("hash").alias(value)).select(value, F.inline(F.concat(*ways)))

    a = offered(_dealt(left), "a", "u", [(r + 1) // 2 for r in radii])
    b = offered(_dealt(right), "b", "v", [r // 2 for r in radii])
    on = ["band", "key"]
    u, v, difference = F.col("u"), F.col("v"), F.col("a").bitwiseXOR(F.col("b"))
    half = (u.bitwiseAND(v) == 0) & (F.bit_count(u) - F.bit_count(v)).isin(0, 1) & ((v == 0) | (u < v.bitwiseAND(-v)))
    first = F.lit(True)
    for i, radius in enumerate(radii[:-1]):
        first &= (F.col("band") <= i) | (F.bit_count(part(difference, i)) > radius)

    def near(pairs: DataFrame) -> DataFrame:
        found = pairs.where(half & first).withColumn("distance", F.bit_count(difference).cast("long"))
        return found.where(F.col("distance") <= distance).select("a", "b", "distance")

    sizes = a.groupBy(*on).agg(F.count(F.lit(1)).alias("na")).join(_merged(b.groupBy(*on).agg(F.count(F.lit(1)).alias("nb"))), on)
    busy = cut(sizes.where(F.col("na") * F.col("nb") > limit).select(*on))
    if not busy.take(1):
        return near(a.join(_merged(b), on))
    one = a.join(busy, on, "left_semi").withColumn("salt", F.pmod(F.xxhash64("a"), F.lit(SALTS)).cast("int"))
    two = b.join(busy, on, "left_semi").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return near(a.join(busy, on, "left_anti").join(_merged(b), on)).unionByName(near(one.join(_merged(two), [*on, "salt"])))


def _cells(left: DataFrame, right: DataFrame, distance: int) -> DataFrame:
    import numpy as np
    import pandas as pd

    both = (
        left.select("hash", F.lit(True).alias("l"), F.lit(False).alias("r"))
        .unionByName(right.select("hash", F.lit(False).alias("l"), F.lit(True).alias("r")))
        .groupBy("hash")
        .agg(F.max("l").alias("l"), F.max("r").alias("r"))
    )

    def kernel(_, one, two, diagonal):
        x, y = one["hash"].to_numpy(), two["hash"].to_numpy()
        gap = np.bitwise_count((x[:, None] ^ y[None, :]).view(np.uint64))
        i, j = np.nonzero(gap <= distance)
        a, b, d = x[i], y[j], gap[i, j]
        one_l, one_r = one["l"].to_numpy()[i], one["r"].to_numpy()[i]
        two_l, two_r = two["l"].to_numpy()[j], two["r"].to_numpy()[j]
        forth = one_l & two_r
        back = (two_l & one_r) & (not diagonal)
        return pd.DataFrame(
            {
                "a": np.concatenate([a[forth], b[back]]),
                "b": np.concatenate([b[forth], a[back]]),
                "distance": np.concatenate([d[forth], d[back]]).astype("int64"),
            }
        )

    return per_cell(both, [], "hash", ["l", "r"], kernel, "a long, b long, distance long")


def distinct_hashes(df: DataFrame, path: str, hash_col: str) -> DataFrame:
    """One row per hash: first path and number of copies. Rows without a hash drop out."""
    return (
        df.filter(F.col(hash_col).isNotNull())
        .groupBy(F.col(hash_col).alias("hash"))
        .agg(F.min(path).alias("first_path"), F.count(F.lit(1)).alias("copies"))
    )


def hamming_pairs(df: DataFrame, path: str, hash_col: str, distance: int, bits: int = 64) -> DataFrame:
    """Pairs of different hashes within ``distance``, each with its first path and copies.

    Copies of one hash are collapsed first: a burst of identical files stays one row.
    """
    items = cut(distinct_hashes(df, path, hash_col))
    pairs = hamming_join(items.select("hash"), items.select("hash"), distance, bits)
    pairs = pairs.filter(F.col("a") < F.col("b"))
    left = items.select(F.col("hash").alias("a"), F.col("first_path").alias("path_a"), F.col("copies").alias("copies_a"))
    right = items.select(F.col("hash").alias("b"), F.col("first_path").alias("path_b"), F.col("copies").alias("copies_b"))
    return pairs.join(left, "a").join(right, "b").select(
        "a", "b", "path_a", "path_b", "copies_a", "copies_b", "distance"
    )


def near_duplicate_groups(
    df: DataFrame, path: str, hash_col: str, distance: int = 5, bits: int = 64,
    first_pass: int = FIRST_PASS,
) -> DataFrame:
    """Every hashed row with the founder of its group: (path, representative, is_representative).

    In path order a row joins the first founder within ``distance`` or becomes one, so a
    chain does not merge through its members. Rows are settled in passes of growing size:
    rows near an earlier founder are members and never meet each other, so a dense heap of
    near copies costs one founder, not all its pairs.
    """
    items = cut(distinct_hashes(df, path, hash_col))
    total = items.count()
    if total == 0:
        return df.filter(F.lit(False)).select(
            F.col(path).alias("path"), F.col(path).alias("representative"), F.lit(True).alias("is_representative")
        )
    founders = None
    low = None
    for high in [*_cut_points(items, total, first_pass), None]:
        batch = items
        if low is not None:
            batch = batch.filter(F.col("first_path") >= low)
        if high is not None:
            batch = batch.filter(F.col("first_path") < high)
        if founders is not None:
            near = hamming_join(batch.select("hash"), founders.select("hash"), distance, bits)
            batch = batch.join(near.select(F.col("a").alias("hash")).distinct(), "hash", "left_anti")
        fresh = _founders(cut(batch), distance, bits)
        founders = fresh if founders is None else cut(founders.unionByName(fresh))
        low = high
    near = hamming_join(items.select("hash"), founders.select("hash"), distance, bits)
    owner = (
        near.join(founders.select(F.col("hash").alias("b"), F.col("first_path").alias("founder")), "b")
        .groupBy(F.col("a").alias("hash"))
        .agg(F.min("founder").alias("representative"))
    )
    rows = df.filter(F.col(hash_col).isNotNull()).select(F.col(path).alias("path"), F.col(hash_col).alias("hash"))
    return rows.join(owner, "hash").select(
        "path", "representative", (F.col("path") == F.col("representative")).alias("is_representative")
    )


def _cut_points(items: DataFrame, total: int, first_pass: int) -> list:
    """Paths that separate the passes. They come from a sample: any choice gives the same result."""
    if total <= first_pass:
        return []
    sample = items.select("first_path").sample(min(1.0, 20_000 / total), seed=7).limit(50_000)
    paths = sorted(r[0] for r in sample.collect())
    cuts, size = [], float(first_pass)
    while size < total and paths:
        cuts.append(paths[min(len(paths) - 1, int(size / total * len(paths)))])
        size *= 3
    return sorted(set(cuts))


def _founders(nodes: DataFrame, distance: int, bits: int) -> DataFrame:
    """Founders among ``nodes`` alone, by rounds that settle all independent rows at once."""
    paths = nodes.select("hash", "first_path")
    pairs = hamming_join(paths.select("hash"), paths.select("hash"), distance, bits)
    one = paths.select(F.col("hash").alias("a"), F.col("first_path").alias("pa"))
    two = paths.select(F.col("hash").alias("b"), F.col("first_path").alias("pb"))
    edges = cut(
        pairs.filter(F.col("a") != F.col("b")).join(one, "a").join(two, "b")
        .filter(F.col("pa") < F.col("pb")).select("a", "b")
    )
    chosen = None
    left = paths
    while True:
        # A row with no earlier open neighbour is a founder.
        free = cut(left.join(edges.select(F.col("b").alias("hash")).distinct(), "hash", "left_anti"))
        chosen = free if chosen is None else chosen.unionByName(free)
        settled = edges.join(free.select(F.col("hash").alias("a")), "a").select(F.col("b").alias("hash"))
        settled = cut(settled.union(free.select("hash")).distinct())
        left = cut(left.join(settled, "hash", "left_anti"))
        if not left.take(1):
            return cut(chosen)
        edges = cut(
            edges.join(settled.select(F.col("hash").alias("a")), "a", "left_anti")
            .join(settled.select(F.col("hash").alias("b")), "b", "left_anti")
        )


# -- groups that are already known -------------------------------------------- #
def rerank(df: DataFrame, group: str, path: str, quality: str) -> DataFrame:
    """Mark the best of each group: highest quality, then smallest path; unscored last.

    The winner per group is an aggregate, so a group of any size combines on the map side. A row without a group
    stands for itself.
    """
    key = F.struct((-F.coalesce(F.col(quality), F.lit(-1.0))).alias("q"), F.col(path).alias("p"))
    grouped, alone = df.where(F.col(group).isNotNull()), df.where(F.col(group).isNull())
    best = grouped.groupBy(group).agg(F.min(key)["p"].alias("representative"), F.count(F.lit(1)).alias("group_size"))
    marked = grouped.join(best, group).unionByName(
        alone.withColumns({"representative": F.col(path), "group_size": F.lit(1).cast("long")})
    )
    return marked.withColumn("is_representative", F.col(path) == F.col("representative"))


def duplicate_listing(df: DataFrame, group: str, path: str) -> DataFrame:
    """Rows of groups with at least two members: (representative, path, is_representative).

    The first path represents the group. Long form, so a group of any size stays spread out.
    """
    head = (
        df.groupBy(group)
        .agg(F.min(path).alias("representative"), F.count(F.lit(1)).alias("group_size"))
        .filter(F.col("group_size") >= 2)
    )
    return df.join(head, group).select(
        "representative", F.col(path).alias("path"), "group_size",
        (F.col(path) == F.col("representative")).alias("is_representative"),
    )


def duplicate_paths(ranked: DataFrame, path: str) -> DataFrame:
    """Distinct paths that are not the representative of their group."""
    return ranked.filter(~F.col("is_representative")).select(path).distinct()


__all__ = [
    "duplicate_listing", "duplicate_paths", "first_row", "hamming_join", "hamming_pairs",
    "near_duplicate_groups", "rerank",
]
