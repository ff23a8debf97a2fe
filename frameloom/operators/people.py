"""People: vector pairs, average-linkage clusters, saved labels, presence."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frameloom.functions.scalar import role_tokens
from frameloom.functions.vectors import cosine_distance, norm, unit
from frameloom.operators.blocks import BLOCK_ROWS, per_cell
from frameloom.operators.ordered import OrderedGroups
from frameloom.session import cut

MIN_CLUSTER = 2
LABEL_DISTANCE = 0.4
# Far above what the order of its terms changes in the dot product of two unit vectors.
LAST_BITS = 1e-9


def unit_vectors(df: DataFrame, vector: str) -> DataFrame:
    """Normalise a vector column; zero vectors drop out (they have no direction)."""
    return df.filter(norm(vector) > 0).withColumn(vector, unit(vector))


def _matrix(frame, name):
    import numpy as np

    return np.vstack(frame[name].to_numpy()) if len(frame) else np.zeros((0, 1))


def cosine_pairs(df: DataFrame, by: Sequence[str], key: str, vector: str, limit: float, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Pairs (by, a, b, distance) of unit vectors at most ``limit`` apart, a < b.

    Every row meets every other of its group, copies of a vector and rows of a repeated key too; only rows
    of one key are no pair, and rows without a key are in none. The limits in use are far too loose for an
    exact index; blocks bound the memory of a task. They are dealt by key, so copies of one vector spread.
    """
    import numpy as np
    import pandas as pd

    by = list(by)
    key_type = df.schema[key].dataType.simpleString()
    by_types = [f"{c} {df.schema[c].dataType.simpleString()}" for c in by]

    def kernel(group, one, two, diagonal):
        left, right = _matrix(one, vector), _matrix(two, vector)
        gap = 1.0 - left @ right.T
        i, j = np.nonzero(gap <= limit + LAST_BITS)
        d = gap[i, j]
        # The last bits of a product depend on its tile: next to the limit the terms are added in order.
        edge = np.flatnonzero(d >= limit - LAST_BITS)
        p, q = i[edge], j[edge]
        d[edge] = 1.0 - sum(left[p, n] * right[q, n] for n in range(left.shape[1]))
        x, y = one[key].to_numpy()[i], two[key].to_numpy()[j]
        keep = (d <= limit) & (x < y if diagonal else x != y)
        x, y, d = x[keep], y[keep], d[keep]
        swap = x > y
        out = pd.DataFrame({"a": np.where(swap, y, x), "b": np.where(swap, x, y), "distance": d})
        for n, value in zip(by, group):
            out[n] = value
        return out[[*by, "a", "b", "distance"]]

    schema = ", ".join([*by_types, f"a {key_type}", f"b {key_type}", "distance double"])
    return per_cell(df.filter(F.col(key).isNotNull()), by, key, [vector], kernel, schema, block_rows)


# -- clusters ------------------------------------------------------------------ #
# What one task merges to the end: clusters of a group, and rows of either side of a cell of the search among more.
TASK_ROWS, CELL_ROWS = 64_000, 16_000
TILE_CELLS = 4_000_000


def _nearest_rows(asking, means, own):
    """Nearest row of ``means`` to every row of ``asking`` and its distance, tile by tile; the first of equals.

    ``own`` is the place of the asking row itself among ``means``, or -1.
    """
    import numpy as np

    near, apart = np.zeros(len(asking), dtype=int), np.full(len(asking), np.inf)
    step = max(1, TILE_CELLS // max(1, len(means)))
    for i in range(0, len(asking), step):
        like = asking[i : i + step] @ means.T
        at, mine = np.arange(len(like)), own[i : i + step]
        like[at[mine >= 0], mine[mine >= 0]] = -np.inf
        near[i : i + step] = np.argmax(like, axis=1)
        apart[i : i + step] = 1.0 - like[at, near[i : i + step]]
    return near, apart


def _finished(active: DataFrame, by: list[str], limit: float, key_type: str) -> DataFrame:
    """(by, cluster, into): average linkage to its end in groups that one task holds.

    A cluster keeps its nearest one until either of them is merged: a mean distance to a merged cluster is
    never below the smaller of the distances to its parts.
    """
    import numpy as np
    import pandas as pd

    schema = ", ".join([*(f"{c} {active.schema[c].dataType.simpleString()}" for c in by), f"cluster {key_type}", f"into {key_type}"])

    def run(group, pdf):
        pdf = pdf.sort_values("cluster")
        keys, size, mean = pdf["cluster"].to_numpy(), pdf["size"].to_numpy().astype(float), _matrix(pdf, "mean")
        own = np.arange(len(keys))
        near, apart = np.zeros(len(keys), dtype=int), np.full(len(keys), np.inf)
        live = asking = own
        while len(live) > 1:
            if len(asking):
                found, apart[asking] = _nearest_rows(mean[asking], mean[live], np.searchsorted(live, asking))
                near[asking] = live[found]  # of equals the smaller key, as rows are in key order
            live = live[apart[live] <= limit]  # the others are final
            if not len(live):
                break
            a = live[(near[near[live]] == live) & (live < near[live])]
            if not len(a):  # equal distances that differ in a last bit: the closest pair is right in any case
                first = live[np.argmin(apart[live])]
                a, b = np.array([min(first, near[first])]), np.array([max(first, near[first])])
            else:
                b = near[a]
            mean[a] = (mean[a] * size[a, None] + mean[b] * size[b, None]) / (size[a] + size[b])[:, None]
            size[a] += size[b]
            into = np.arange(len(keys))
            into[b] = a
            own = into[own]
            changed = np.zeros(len(keys), dtype=bool)
            changed[a] = changed[b] = True
            live = np.setdiff1d(np.union1d(live, a), b)
            asking = live[changed[live] | changed[near[live]]]
        moved = np.flatnonzero(keys[own] != keys)
        out = pd.DataFrame({"cluster": keys[moved], "into": keys[own[moved]]})
        for n, value in zip(by, group):
            out[n] = value
        return out[[*by, "cluster", "into"]]

    return active.select(*by, "cluster", "size", "mean").groupBy(*by).applyInPandas(run, schema)


def _nearest(rows: DataFrame, by: list[str], limit: float, key_type: str, cell_rows: int) -> DataFrame:
    """(by, cluster, other, distance) of the ``stale`` rows: their nearest among all rows of the group, within ``limit``.

    Both sides are dealt to blocks of about ``cell_rows``; a cell holds one block of each and returns a row an asking row.
    """
    import numpy as np
    import pandas as pd

    group = by or ["__all"]
    rows = rows if by else rows.withColumn("__all", F.lit(0))
    parts = lambda n: F.ceil(n / F.lit(cell_rows)).cast("long")
    sizes = rows.groupBy(*group).agg(
        parts(F.count(F.lit(1))).alias("__blocks"), F.greatest(parts(F.count_if("stale")), F.lit(1)).alias("__lots")
    )
    placed = rows.join(sizes, group)
    lot, block = F.pmod(F.xxhash64("cluster"), F.col("__lots")), F.pmod(F.xxhash64("cluster"), F.col("__blocks"))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    asking = placed.where("stale").withColumn("__lot", lot.cast("long")).withColumn("__block", every("__blocks"))
    members = placed.withColumn("__block", block.cast("long")).withColumn("__lot", every("__lots"))
    cell = [*group, "__lot", "__block"]
    types = [f"{c} {rows.schema[c].dataType.simpleString()}" for c in by]

    def run(k, ask, all_rows):
        ask, all_rows = ask.sort_values("cluster"), all_rows.sort_values("cluster")
        out = pd.DataFrame({"cluster": ask["cluster"], "other": ask["cluster"], "distance": np.inf})
        if len(ask) and len(all_rows):
            keys, asked = all_rows["cluster"].to_numpy(), ask["cluster"].to_numpy()
            at = np.searchsorted(keys, asked)
            own = np.where(keys[np.minimum(at, len(keys) - 1)] == asked, at, -1)
            near, apart = _nearest_rows(_matrix(ask, "mean"), _matrix(all_rows, "mean"), own)
            out["other"], out["distance"] = keys[near], apart
        out = out[out["distance"] <= limit]
        for n, value in zip(by, k):
            out[n] = value
        return out[[*by, "cluster", "other", "distance"]]

    names = [*cell, "cluster", "mean"]
    one, two = asking.select(*names).toDF(*names), members.select(*names).toDF(*names)
    met = one.groupBy(*cell).cogroup(two.groupBy(*cell)).applyInPandas(
        run, ", ".join([*types, f"cluster {key_type}", f"other {key_type}", "distance double"])
    )
    best = met.groupBy(*by, "cluster").agg(F.min(F.struct("distance", "other")).alias("best"))
    return best.select(*by, "cluster", "best.other", "best.distance")


def average_linkage_clusters(
    df: DataFrame, by: Sequence[str], key: str, vector: str, limit: float, dim: int,
    block_rows: int = TASK_ROWS,
) -> DataFrame:
    """Average-linkage clusters cut at ``limit``: rows of ``df`` plus ``cluster`` (its smallest key).

    ``df`` holds unit vectors of ``dim`` elements. The mean distance of two clusters is one minus the dot product of
    their mean vectors, so a cluster is one row (mean, size) however many faces it has. While a group has more than
    ``block_rows`` clusters it goes through rounds over all tasks: each merges all its mutually nearest
    clusters, which gives the same tree as merging one pair at a time; a cluster with nothing inside ``limit`` is
    final and leaves, and only clusters that were merged, or whose nearest was, search again. What fits in one task is
    merged there to the end, by the same rule.
    """
    by = list(by)
    key_type = df.schema[key].dataType.simpleString()
    faces = df.select(*by, F.col(key).alias("face"), F.col(vector).alias("mean"))
    # Copies of a vector are one weighted row from the start.
    start = cut(
        faces.groupBy(*by, "mean").agg(F.min("face").alias("cluster"), F.count(F.lit(1)).alias("size"))
    )
    match = [F.col(f"f.{c}").eqNullSafe(F.col(f"s.{c}")) for c in (*by, "mean")]
    joined = faces.alias("f").join(start.alias("s"), match)
    owner = joined.select(*(F.col(f"f.{c}") for c in by), "f.face", "s.cluster")
    active, steps = start.withColumns({
        "other": F.lit(None).cast(key_type), "distance": F.lit(None).cast("double"), "stale": F.lit(True),
    }), []
    while True:
        counts = active.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
        large = cut(counts.where(F.col("n") > block_rows).select(*by, F.lit(True).alias("large")))
        some = bool(large.take(1))
        many = (active.join(large.drop("large"), by, "left_semi") if by else active) if some else None
        few = (active.join(large.drop("large"), by, "left_anti") if by else active.limit(0)) if some else active
        steps.append(cut(_finished(few, by, limit, key_type)))
        if many is None:
            break
        known = many.where("NOT stale").select(*by, "cluster", "other", "distance")
        near = cut(known.unionByName(_nearest(many, by, limit, key_type, min(block_rows, CELL_ROWS))))
        back = near.select(*by, F.col("cluster").alias("other"), F.col("other").alias("cluster"))
        moved = cut(
            near.join(back, [*by, "cluster", "other"]).filter(F.col("cluster") < F.col("other"))
            .select(*by, F.col("other").alias("cluster"), F.col("cluster").alias("into"))
        )
        if not moved.take(1):  # nothing is left, or equal distances differ in a last bit: then the closest pair is right
            pair = F.struct("distance", F.greatest("cluster", "other").alias("cluster"), F.least("cluster", "other").alias("into"))
            least = near.groupBy(*by).agg(F.min(pair).alias("pair")).where("pair IS NOT NULL")
            moved = cut(least.select(*by, "pair.cluster", "pair.into"))
            if not moved.take(1):
                break
        steps.append(moved)
        gone = moved.select(*by, "cluster")
        touched = gone.unionByName(moved.select(*by, F.col("into").alias("cluster"))).withColumnRenamed("cluster", "other")
        told = many.select(*by, "cluster", "size", "mean").join(near, [*by, "cluster"], "left")
        lost = told.join(moved, [*by, "cluster"]).select(*by, F.col("into").alias("cluster"), F.col("size").alias("size2"), F.col("mean").alias("mean2"))
        left = told.join(gone, [*by, "cluster"], "left_anti").join(lost, [*by, "cluster"], "left")
        left = left.where("other IS NOT NULL OR size2 IS NOT NULL")
        left = left.join(touched.withColumn("touched", F.lit(True)), [*by, "other"], "left")
        # Names of their own: inside a lambda a column of this select would go before one of the table.
        left = left.withColumnsRenamed({"size": "size1", "mean": "mean1"})
        whole = F.col("size1") + F.col("size2")
        mixed = F.zip_with("mean1", "mean2", lambda x, y: (x * F.col("size1") + y * F.col("size2")) / whole)
        active = cut(left.select(
            *by, "cluster", F.coalesce(whole, "size1").alias("size"), F.coalesce(mixed, "mean1").alias("mean"), "other", "distance",
            (F.col("size2").isNotNull() | F.col("touched").isNotNull()).alias("stale"),
        ))

    for n, moved in enumerate(steps, 1):  # who ended where, one equi-join per round
        owner = owner.join(moved, [*by, "cluster"], "left").select(*by, "face", F.coalesce("into", "cluster").alias("cluster"))
        owner = owner if n % 8 else cut(owner)
    return df.join(owner.withColumnRenamed("face", key), [*by, key])


def centroids(df: DataFrame, by: Sequence[str], vector: str, dim: int) -> DataFrame:
    """Normalised mean of unit vectors per group, one aggregate per element: a single shuffle."""
    means = [F.avg(F.col(vector)[i]).alias(f"m{i}") for i in range(dim)]
    return df.groupBy(*by).agg(*means, F.count(F.lit(1)).alias("size")).select(
        *by, unit(F.array(*[F.col(f"m{i}") for i in range(dim)])).alias("centroid"), "size"
    )


def cluster_profiles(members: DataFrame, by: Sequence[str], image: str, minimum: int = MIN_CLUSTER) -> DataFrame:
    """Faces, distinct photos and first photo of each cluster with at least ``minimum`` faces."""
    return (
        members.groupBy(*by)
        .agg(
            F.count(F.lit(1)).alias("size"),
            F.countDistinct(image).alias("photos"),
            F.min(image).alias("representative"),
        )
        .filter(F.col("size") >= minimum)
    )


def review_order(cluster: str) -> list[Column]:
    return [F.col("size").desc(), F.col(cluster)]


def numbered_clusters(profiles: DataFrame, by: Sequence[str], name: str = "cluster_id") -> DataFrame:
    """Number clusters from 0, largest first, then by first photo."""
    order = [F.col("size").desc(), F.col("representative"), F.col("cluster")]
    return OrderedGroups(profiles, by, order).position(name).df


def group_by_person(members: DataFrame, photos: DataFrame, by: Sequence[str], image: str, minimum: int = 3) -> DataFrame:
    """(by, person, image): clusters on at least ``minimum`` photos, else everyone together.

    Persons are numbered over all clusters, largest first, so the numbers may have gaps.
    """
    by = list(by)
    profiles = numbered_clusters(cluster_profiles(members, [*by, "cluster"], image, 1), by)
    kept = profiles.filter(F.col("photos") >= minimum).select(
        *by, "cluster", F.concat(F.lit("Person "), F.col("cluster_id") + 1).alias("person")
    )
    named = members.select(*by, "cluster", image).distinct().join(kept, [*by, "cluster"]).select(*by, "person", image)
    lonely = photos.select(*by, image).distinct()
    if by:
        lonely = lonely.join(kept.select(*by).distinct(), by, "left_anti")
    else:
        lonely = lonely.filter(kept.agg((F.count(F.lit(1)) == 0).alias("n")).scalar())
    return named.unionByName(lonely.select(*by, F.lit("Everyone").alias("person"), image))


# -- saved labels --------------------------------------------------------------- #
def nearest_labels(
    labels: DataFrame, clusters: DataFrame, by: Sequence[str], limit: float = LABEL_DISTANCE,
) -> DataFrame:
    """Bind saved labels to clusters: (by, ordinal, label, cluster, distance).

    Labels choose in ``ordinal`` order, each the nearest free cluster within ``limit``; at equal
    distance the later cluster. ``labels`` has (by, ordinal, label, centroid), ``clusters``
    (by, cluster, centroid), both unit vectors. A label is settled as soon as no open label before
    it has its cluster among the candidates, so a round settles all independent labels.
    """
    by = list(by)
    distance = cosine_distance(F.col("lc"), F.col("cc"))
    left = labels.select(*by, "ordinal", "label", F.col("centroid").alias("lc"))
    right = clusters.select(*by, "cluster", F.col("centroid").alias("cc"))
    # Labels are the few hand-named people of one project; each meets the clusters of its project.
    pairs = left.join(right, by).withColumn("distance", distance).filter(F.col("distance") <= limit)
    open_pairs = cut(pairs.select(*by, "ordinal", "label", "cluster", "distance"))
    done = None
    while open_pairs.take(1):
        best = F.max_by(F.struct("cluster", "label", "distance"), F.struct(-F.col("distance"), F.col("cluster")))
        wish = open_pairs.groupBy(*by, "ordinal").agg(best.alias("w")).select(
            *by, "ordinal", F.col("w.label").alias("label"), F.col("w.cluster").alias("cluster"), F.col("w.distance").alias("distance")
        )
        first = open_pairs.groupBy(*by, "cluster").agg(F.min("ordinal").alias("ordinal"))
        settled = cut(wish.join(first, [*by, "cluster", "ordinal"]))
        done = settled if done is None else done.unionByName(settled)
        open_pairs = cut(
            open_pairs.join(settled.select(*by, "ordinal"), [*by, "ordinal"], "left_anti")
            .join(settled.select(*by, "cluster"), [*by, "cluster"], "left_anti")
        )
    if done is None:
        return open_pairs
    return done.select(*by, "ordinal", "label", "cluster", "distance")


def people_present(members: DataFrame, labels: DataFrame, by: Sequence[str], image: str) -> DataFrame:
    """(by, image, label): labelled people on each photo, one row each."""
    by = list(by)
    named = labels.filter(F.col("label").isNotNull() & (F.col("label") != ""))
    return members.join(named, [*by, "cluster"]).select(*by, image, "label").distinct()


def persons_per_photo(members: DataFrame, labels: DataFrame, by: Sequence[str], image: str) -> DataFrame:
    """(by, image, persons): sorted distinct tokens of the labelled clusters on each photo.

    The token vocabulary is one entry per labelled person, so the array is small.
    """
    by = list(by)
    tokens = labels.withColumn("token", F.explode(role_tokens("label", "side"))).select(*by, "cluster", "token")
    return (
        members.join(tokens, [*by, "cluster"])
        .groupBy(*by, image)
        .agg(F.sort_array(F.collect_set("token")).alias("persons"))
    )


def labelled_clusters(profiles: DataFrame, labels: DataFrame, by: Sequence[str]) -> DataFrame:
    named = labels.filter(F.col("label").isNotNull() & (F.col("label") != ""))
    return profiles.join(named, [*by, "cluster"])


# -- accuracy -------------------------------------------------------------------- #
def pair_statistics(df: DataFrame, by: Sequence[str], key: str, vector: str, label: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Per cell: counts, sums and extremes of distances of same-label and other pairs."""
    return _pair_cells(df, by, key, vector, label, block_rows, histogram=False)


def separation(stats: DataFrame, by: Sequence[str]) -> DataFrame:
    """Mean and extreme distances, and the separation of the two means."""
    out = stats.groupBy(*by) if by else stats.groupBy()
    same = F.sum("same_sum") / F.sum("same_n")
    diff = F.sum("diff_sum") / F.sum("diff_n")
    return out.agg(
        F.sum("same_n").alias("same_pairs"), same.alias("same_mean"), F.max("same_max").alias("same_max"),
        F.sum("diff_n").alias("diff_pairs"), diff.alias("diff_mean"), F.min("diff_min").alias("diff_min"),
        (diff - same).alias("separation"),
    )


def _pair_cells(df, by, key, vector, label, block_rows, histogram):
    import numpy as np
    import pandas as pd

    by = list(by)
    by_types = [f"{c} {df.schema[c].dataType.simpleString()}" for c in by]

    def kernel(group, one, two, diagonal):
        a, b = _matrix(one, vector), _matrix(two, vector)
        gap = 1.0 - a @ b.T if len(one) and len(two) else np.zeros((len(one), len(two)))
        same = one[label].to_numpy()[:, None] == two[label].to_numpy()[None, :]
        use = np.triu(np.ones(gap.shape, bool), 1) if diagonal else np.ones(gap.shape, bool)
        s, d = gap[use & same], gap[use & ~same]
        if histogram:
            out = []
            for kind, values in (("same", s), ("diff", d)):
                # A pair counts from the first thousandth at or above its distance.
                near = np.rint(values * 1000).astype("int64")
                reach = np.where(values <= near / 1000.0, near, near + 1)
                for name, marks in (("reach", reach), ("candidate", near)):
                    n = np.bincount(marks)  # distances lie in 0..2
                    at = np.flatnonzero(n)
                    n = n[at]
                    out.append(pd.DataFrame({"kind": kind, "mark": name, "milli": at, "n": n}))
            out = pd.concat(out)
            names = ["kind", "mark", "milli", "n"]
        else:
            out = pd.DataFrame(
                [{
                    "same_n": len(s), "same_sum": float(s.sum()), "same_max": s.max() if len(s) else None,
                    "diff_n": len(d), "diff_sum": float(d.sum()), "diff_min": d.min() if len(d) else None,
                }]
            )
            names = list(out.columns)
        for n, value in zip(by, group):
            out[n] = value
        return out[[*by, *names]]

    fields = (
        "kind string, mark string, milli long, n long" if histogram
        else "same_n long, same_sum double, same_max double, diff_n long, diff_sum double, diff_min double"
    )
    schema = ", ".join([*by_types, fields])
    return per_cell(df, by, key, [vector, label], kernel, schema, block_rows)


def best_threshold(df: DataFrame, key: str, vector: str, label: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(threshold, accuracy): the cut that best tells same-label pairs from others.

    Candidates are the distances rounded to three places; the lowest of equals wins. Distances lie
    in 0..2, so the histogram has at most 2001 marks and the sweep over it is one small window.
    """
    from pyspark.sql.window import Window

    cells = _pair_cells(df, [], key, vector, label, block_rows, histogram=True)
    marks = cells.groupBy("milli").agg(
        F.coalesce(F.sum(F.when((F.col("mark") == "reach") & (F.col("kind") == "same"), F.col("n"))), F.lit(0)).alias("same"),
        F.coalesce(F.sum(F.when((F.col("mark") == "reach") & (F.col("kind") == "diff"), F.col("n"))), F.lit(0)).alias("diff"),
        F.max((F.col("mark") == "candidate").cast("int")).alias("candidate"),
    )
    upto = Window.orderBy("milli").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    swept = marks.select(
        "milli", "candidate",
        (
            (F.sum("same").over(upto) + F.sum("diff").over(whole) - F.sum("diff").over(upto))
            / (F.sum("same").over(whole) + F.sum("diff").over(whole))
        ).alias("accuracy"),
    ).filter(F.col("candidate") == 1)
    return swept.agg(
        (F.max_by("milli", F.struct(F.col("accuracy"), -F.col("milli"))) / 1000.0).alias("threshold"),
        F.max("accuracy").alias("accuracy"),
    )


def purity(members: DataFrame, cluster: str, label: str) -> DataFrame:
    """(clusters_found, true_people, purity) of clusters against known labels."""
    counts = members.groupBy(cluster, label).agg(F.count(F.lit(1)).alias("n"))
    major = counts.groupBy(cluster).agg(F.max("n").alias("major"), F.sum("n").alias("n"))
    people = members.agg(F.countDistinct(label).alias("p"))
    return major.agg(
        F.count(F.lit(1)).alias("clusters_found"),
        (F.sum("major") / F.sum("n")).alias("purity"),
    ).withColumn("true_people", people.scalar())


def mean_norm(df: DataFrame, vector: str) -> DataFrame:
    return df.agg(F.avg(norm(vector)).alias("mean_norm"), F.count(F.lit(1)).alias("vectors"))
