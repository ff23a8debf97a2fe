import random

import pytest

from frameloom.operators import duplicates as D


def make(seed=3):
    rnd = random.Random(seed)
    rows = []
    for _ in range(120):
        base = rnd.getrandbits(63)
        rows.append(base)
        for _ in range(rnd.randint(0, 4)):
            near = base
            for _ in range(rnd.randint(0, 6)):
                near ^= 1 << rnd.randrange(63)
            rows += [near] * rnd.randint(1, 2)
    # A third of all rows share 40 bits and land in the same buckets.
    fixed = rnd.getrandbits(40)
    rows += [fixed | rnd.getrandbits(22) << 40 for _ in range(len(rows) // 2)]
    rnd.shuffle(rows)
    return [(f"p{i:05d}", h) for i, h in enumerate(rows)]


def gap(a, b):
    return bin(a ^ b).count("1")


def brute_groups(data, d):
    out, founders = {}, []
    for path, h in sorted(data):
        owner = next((p for p, f in founders if gap(f, h) <= d), None)
        if owner is None:
            founders.append((path, h))
        out[path] = owner or path
    return out


@pytest.fixture(scope="module")
def data():
    return make()


@pytest.fixture(scope="module")
def frame(spark, data):
    return spark.createDataFrame(data, "path string, hash long").cache()


@pytest.mark.parametrize("distance,limit", [(5, 10**6), (5, 300), (3, 10**6), (7, 500), (12, 10**6), (0, 10**6), (8, 10**6), (9, 200), (10, 10**6)])
def test_join_is_exact(spark, data, distance, limit):
    unique = sorted({h for _, h in data})
    side = spark.createDataFrame([(h,) for h in unique], "hash long")
    got = [(r.a, r.b, r.distance) for r in D.hamming_join(side, side, distance, bucket_pairs=limit).collect()]
    want = {(a, b, gap(a, b)) for a in unique for b in unique if gap(a, b) <= distance}
    assert len(got) == len(set(got)) and set(got) == want


@pytest.mark.parametrize("distance", [5, 10])
def test_exploded_hashes_are_not_broadcast(spark, data, tmp_path, distance):
    spark.createDataFrame([(h,) for h in sorted({h for _, h in data})], "hash long").write.parquet(str(tmp_path / "hashes"))
    side = spark.read.parquet(str(tmp_path / "hashes"))  # a file of known, small size
    joined = D.hamming_join(side, side, distance)
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


@pytest.mark.parametrize("first_pass", [10**6, 60])
def test_groups_equal_the_sequential_rule(frame, data, first_pass):
    got = {r.path: r.representative for r in D.near_duplicate_groups(frame, "path", "hash", 5, first_pass=first_pass).collect()}
    assert got == brute_groups(data, 5)


def test_chain_does_not_merge(spark):
    chain = spark.createDataFrame([("a", 0), ("b", 0b11111), ("c", 0b1111111111), ("d", None)], "path string, hash long")
    got = {r.path: r.representative for r in D.near_duplicate_groups(chain, "path", "hash", 5).collect()}
    assert got == {"a": "a", "b": "a", "c": "c"}


def test_empty(spark):
    none = spark.createDataFrame([], "path string, hash long")
    assert D.near_duplicate_groups(none, "path", "hash", 5).count() == 0


def test_rerank_ties_and_missing(spark):
    df = spark.createDataFrame([("g", "b", 70.0), ("g", "a", 70.0), ("g", "c", None), ("h", "z", None)], "g string, path string, q double")
    out = {r.path: (r.representative, r.is_representative) for r in D.rerank(df, "g", "path", "q").collect()}
    assert out == {"a": ("a", True), "b": ("a", False), "c": ("a", False), "z": ("z", True)}


def test_wide_bands_and_the_sign_bit(spark):
    rnd = random.Random(11)
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    unique = set()
    for _ in range(60):
        base = rnd.getrandbits(64)
        for _ in range(6):
            near = base
            for bit in rnd.sample([63, 62, 0, *range(64)], rnd.randint(0, 9)):
                near ^= 1 << bit
            unique.add(near)
    one, two = sorted(unique)[::2], sorted(unique)[1::2]
    side = lambda hashes: spark.createDataFrame([(signed(h),) for h in hashes], "hash long")
    for limit in (8, 9, 10):
        got = [(r.a, r.b, r.distance) for r in D.hamming_join(side(one), side(two), limit).collect()]
        want = {(signed(a), signed(b), gap(a, b)) for a in one for b in two if gap(a, b) <= limit}
        assert len(got) == len(set(got)) and set(got) == want
    assert D.hamming_join(side([]).limit(0), side(two), 9).count() == 0
