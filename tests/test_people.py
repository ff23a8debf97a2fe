import numpy as np
import pytest
from pyspark.sql import functions as F

from frameloom.operators import people as P


def brute_linkage(vectors, limit):
    """Average linkage by the definition: mean of all pair distances, closest pair first."""
    gap = 1.0 - vectors @ vectors.T
    groups = [[i] for i in range(len(vectors))]
    while len(groups) > 1:
        best = min(
            (gap[np.ix_(a, b)].mean(), i, j) for i, a in enumerate(groups) for j, b in enumerate(groups) if i < j
        )
        if best[0] > limit:
            break
        groups[best[1]] += groups.pop(best[2])
    return {frozenset(g) for g in groups}


def sample(n=70, people=9, dim=6, seed=1):
    rnd = np.random.default_rng(seed)
    base = rnd.normal(size=(people, dim))
    # One person owns a third of the faces.
    who = np.where(rnd.random(n) < 0.33, 0, rnd.integers(0, people, n))
    v = base[who] + rnd.normal(scale=0.55, size=(n, dim))
    return v / np.linalg.norm(v, axis=1, keepdims=True), who


@pytest.fixture(scope="module")
def faces(spark):
    v, who = sample()
    rows = [(i, i % 40, int(w), [float(x) for x in row]) for i, (row, w) in enumerate(zip(v, who))]
    rows += [(100 + i, i, int(who[i]), rows[i][3]) for i in range(5)]
    return spark.createDataFrame(rows, "id long, image int, label int, v array<double>").cache()


def vectors_of(df):
    rows = sorted(df.collect(), key=lambda r: r.id)
    return [r.id for r in rows], np.array([r.v for r in rows]), rows


@pytest.mark.parametrize("block", [2000, 16])
def test_average_linkage_equals_the_definition(faces, block):
    ids, v, _ = vectors_of(faces)
    out = P.average_linkage_clusters(faces, [], "id", "v", 0.4, 6, block_rows=block)
    got = {}
    for r in out.collect():
        got.setdefault(r.cluster, set()).add(r.id)
    assert {frozenset(s) for s in got.values()} == {frozenset(ids[i] for i in g) for g in brute_linkage(v, 0.4)}
    assert all(min(s) == c for c, s in got.items())


def test_average_linkage_per_project(faces):
    two = faces.withColumn("project", F.col("id") % 2)
    out = P.average_linkage_clusters(two, ["project"], "id", "v", 0.4, 6, block_rows=16)
    for project in (0, 1):
        ids, v, _ = vectors_of(faces.filter(F.col("id") % 2 == project))
        got = {}
        for r in out.filter(F.col("project") == project).collect():
            got.setdefault(r.cluster, set()).add(r.id)
        assert {frozenset(s) for s in got.values()} == {frozenset(ids[i] for i in g) for g in brute_linkage(v, 0.4)}


def test_chain_is_split_by_average_linkage(spark):
    angles = [0.0, 0.5, 1.0]
    rows = [(i, [float(np.cos(a)), float(np.sin(a))]) for i, a in enumerate(angles)]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    out = P.average_linkage_clusters(df, [], "id", "v", 0.2, 2)
    assert len({r.cluster for r in out.collect()}) == 2


def test_zero_vectors_are_dropped(spark):
    df = spark.createDataFrame([(1, [0.0, 0.0]), (2, [3.0, 4.0])], "id long, v array<double>")
    assert [(r.id, r.v) for r in P.unit_vectors(df, "v").collect()] == [(2, [0.6, 0.8])]


@pytest.mark.parametrize("block", [2000, 9])
def test_pairs_and_thresholds(faces, block):
    one = faces.filter("id < 100")
    ids, v, rows = vectors_of(one)
    gap = 1.0 - v @ v.T
    pairs = [(ids[i], ids[j]) for i in range(len(ids)) for j in range(i + 1, len(ids)) if gap[i, j] <= 0.3]
    got = P.cosine_pairs(one, [], "id", "v", 0.3, block).collect()
    assert sorted((r.a, r.b) for r in got) == sorted(pairs)

    label = [r.label for r in rows]
    same = [gap[i, j] for i in range(len(ids)) for j in range(i + 1, len(ids)) if label[i] == label[j]]
    diff = [gap[i, j] for i in range(len(ids)) for j in range(i + 1, len(ids)) if label[i] != label[j]]
    best_t, best_a = None, -1.0
    for t in sorted({round(d, 3) for d in same + diff}):
        a = (sum(d <= t for d in same) + sum(d > t for d in diff)) / (len(same) + len(diff))
        if a > best_a:
            best_t, best_a = t, a
    row = P.best_threshold(one, "id", "v", "label", block).first()
    assert (row.threshold, row.accuracy) == pytest.approx((best_t, best_a))
    stats = P.separation(P.pair_statistics(one, [], "id", "v", "label", block), []).first()
    assert stats.same_pairs == len(same) and stats.diff_pairs == len(diff)
    assert (stats.same_mean, stats.diff_min) == pytest.approx((np.mean(same), min(diff)))


@pytest.mark.parametrize("block", [2000, 7])
def test_pairs_of_copies_and_repeated_keys_are_all_there(spark, block):
    """Copies of a vector pair with each other and with all near ones; a repeated key pairs with others, not with itself."""
    v, _ = sample(n=12)
    rows = [(3 * i + k, [float(x) for x in v[i]]) for i in range(12) for k in range(3)] + [(5, [float(x) for x in v[1]]), (5, [float(x) for x in v[7]])]
    rows += [(100 + i, [float(x) for x in v[0]]) for i in range(20)]
    df = spark.createDataFrame([*rows, (None, rows[0][1])], "id long, v array<double>")
    want = sorted((a, b) for a, x in rows for b, y in rows if a < b and 1.0 - np.dot(x, y) <= 0.3)
    got = P.cosine_pairs(df, [], "id", "v", 0.3, block).collect()
    assert sorted((r.a, r.b) for r in got) == want
    assert sum(abs(r.distance) < 1e-12 for r in got) >= 23 * 22 / 2


@pytest.mark.parametrize("block", [2000, 150])
def test_pairs_at_the_limit_do_not_depend_on_the_tile(spark, block):
    """Pairs exactly at the limit are those whose terms, added in order, meet it."""
    rnd = np.random.default_rng(2)
    v = rnd.integers(-2, 3, (400, 6)).astype(float)
    v = sorted({tuple(x / sum(y * y for y in row) ** 0.5 for x in row) for row in v.tolist() if any(row)})
    gap = {(i, j): 1.0 - sum_in_order(x, y) for j, y in enumerate(v) for i, x in enumerate(v[:j])}
    rows = spark.createDataFrame([(i, list(row)) for i, row in enumerate(v)], "id long, v array<double>")
    got = P.cosine_pairs(rows, [], "id", "v", 0.6, block).collect()
    assert {(r.a, r.b) for r in got} == {p for p, d in gap.items() if d <= 0.6}
    assert any(0 < abs(d - 0.6) < 1e-12 for d in gap.values())


def sum_in_order(x, y):
    total = 0.0
    for a, b in zip(x, y):
        total += a * b
    return total


def test_labels_choose_in_order(spark):
    e = lambda *x: [float(v) for v in np.array(x) / np.linalg.norm(x)]
    labels = spark.createDataFrame(
        [(1, 0, "first", e(1, 0.05)), (1, 1, "second", e(1, 0)), (1, 2, "far", e(-1, 0)), (2, 0, "other", e(0, 1))],
        "p int, ordinal int, label string, centroid array<double>",
    )
    clusters = spark.createDataFrame(
        [(1, 10, e(1, 0)), (1, 11, e(1, 0.3)), (2, 10, e(0, 1)), (2, 11, e(0, 1))], "p int, cluster int, centroid array<double>"
    )
    got = {(r.p, r.label): r.cluster for r in P.nearest_labels(labels, clusters, ["p"], 0.4).collect()}
    # Equal distances go to the later cluster.
    assert got == {(1, "first"): 10, (1, "second"): 11, (2, "other"): 11}


def test_everyone_when_nobody_is_seen_often(spark):
    faces = spark.createDataFrame([(1, "a", 0), (2, "b", 1)], "id int, image string, cluster int")
    got = {tuple(r) for r in P.group_by_person(faces, faces, [], "image", 3).collect()}
    assert got == {("Everyone", "a"), ("Everyone", "b")}
    many = spark.createDataFrame([(i, f"i{i % 3}", 0) for i in range(4)] + [(9, "x", 1)], "id int, image string, cluster int")
    got = {tuple(r) for r in P.group_by_person(many, many, [], "image", 3).collect()}
    assert got == {("Person 1", "i0"), ("Person 1", "i1"), ("Person 1", "i2")}


def test_linkage_searches_again_only_where_something_merged(spark):
    """Rounds over cells and one task give the same clusters, also where distances tie."""
    rnd = np.random.default_rng(5)
    v = rnd.normal(size=(900, 8))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    rows = [(i, i % 2, [float(x) for x in row]) for i, row in enumerate(v)] + [(2000 + i, i % 2, [float(x) for x in v[i % 50 + i % 2]]) for i in range(90)]
    df = spark.createDataFrame(rows, "id long, project int, v array<double>").cache()
    told = []
    for block in (64_000, 300):
        out = P.average_linkage_clusters(df, ["project"], "id", "v", 0.5, 8, block_rows=block)
        told.append(sorted((r.project, r.id, r.cluster) for r in out.collect()))
    assert told[0] == told[1] and len(told[0]) == len(rows)


def test_nearest_rows_are_found_tile_by_tile(monkeypatch):
    """The search of some rows among all equals the full matrix, whatever the tile; a row is not its own neighbour."""
    rnd = np.random.default_rng(3)
    v = rnd.normal(size=(1500, 16))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    near, apart = P._nearest_rows(v, v, np.arange(len(v)))
    gap = 1.0 - v @ v.T
    np.fill_diagonal(gap, np.inf)
    assert (near == gap.argmin(axis=1)).all() and np.allclose(apart, gap.min(axis=1))
    monkeypatch.setattr(P, "TILE_CELLS", 7_000)
    again, _ = P._nearest_rows(v[:100], v, np.arange(100))
    assert (again == near[:100]).all()
