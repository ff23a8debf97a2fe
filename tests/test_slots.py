"""Sequential rules over slots against plain loops, with one key that holds most rows."""

import random

import pytest
from pyspark.sql import functions as F

from frameloom.operators import entitlements as E
from frameloom.operators import slots


@pytest.fixture
def many_slots(spark):
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)


def plain(rows, fold, width):
    """Rows (key, columns in order): the fold over every key from its start."""
    groups = {}
    for key, place, row in sorted(rows, key=lambda r: (str(r[0]), r[1])):
        groups.setdefault(key, []).append((place, row))
    out = {}
    for key, told in groups.items():
        columns = {n: [row[n] for _, row in told] for n in told[0][1]}
        made = [[None] * len(told) for _ in range(width)]
        fold(columns, 0, len(told), None, made)
        out |= {(key, place): tuple(m[i] for m in made) for i, (place, _) in enumerate(told)}
    return out


def keys(n, rng):
    return ["busy" if rng.random() < 0.7 else rng.choice(["a", "b", "zz", None]) for _ in range(n)]


@pytest.mark.parametrize("most", [1, 4, 30])
def test_counters_of_a_busy_machine(spark, many_slots, most):
    rng = random.Random(most)
    rows = [(k, i, rng.choice([None, -1, *range(most + 1)])) for i, k in enumerate(keys(1500, rng))]
    df = spark.createDataFrame(rows, "m string, i long, c long")
    got = {(r.m, r.i): (r.flushed, r.pending) for r in E.counter_flushes(df, "m", "i", "c").collect()}
    assert got == plain([(m, i, {"count": c}) for m, i, c in rows], E.flush_fold, 2)


@pytest.mark.parametrize("quiet", [0.0, 0.5])
def test_seats_of_a_busy_licence(spark, many_slots, quiet):
    rng = random.Random(3)
    acts = [("activate" if rng.random() < 0.5 + quiet else "deactivate") if rng.random() < 0.999 else "revoke" for _ in range(1500)]
    rows = [(k, i, rng.randrange(9), a) for (i, k), a in zip(enumerate(keys(1500, rng)), acts)]
    df = spark.createDataFrame(rows, "l string, i long, d long, a string")
    got = {(r.l, r.i): (r.verdict, r.active_seats) for r in E.seat_history(df, "l", "d", "a", "i", F.lit(3)).collect()}
    want = plain([(k, i, {"device": d, "action": a, "seat_limit": 3}) for k, i, d, a in rows], E.seat_fold, 2)
    assert got == want


@pytest.mark.parametrize("step", [[1], [1, 2, 3], [1, 5, 90]])
def test_limiter_without_pauses(spark, many_slots, step):
    rng, t, rows = random.Random(5), 0.0, []
    for i, k in enumerate(keys(1500, rng)):
        t += rng.choice(step)
        rows.append((k, i, t, rng.random() < 0.01))
    df = spark.createDataFrame(rows, "k string, i long, t double, r boolean")
    got = {(r.k, r.i): (r.allowed, r.remaining, r.retry_after) for r in E.rate_limit(df, "k", F.col("t"), "i", 4, 60, F.col("r")).collect()}
    want = {(k, i): v for (k, (_, i)), v in plain([(k, (t, i), {"t": t, "reset": r}) for k, i, t, r in rows], E.limiter_fold(4, 60), 3).items()}
    assert got == want


def test_a_busy_key_lies_in_many_slots(spark, many_slots):
    import pyarrow as pa

    seen = spark.sparkContext.accumulator(0)

    def fold(columns, start, stop, state, out):
        if state is None and out:
            seen.add(1)
        if out:
            out[0][start:stop] = range((state or 0), (state or 0) + stop - start)
        return (state or 0) + stop - start

    df = spark.range(0, 4000).select(F.lit("one").alias("k"), "id")
    got = slots.fold_slots(df, ["k"], ["id"], fold, [("n", pa.int64())]).collect()
    assert sorted(r.n for r in got) == list(range(4000)) and all(r.n == r.id for r in got)
    assert seen.value >= 8  # every slot began by itself
    assert slots.fold_slots(df.limit(0), ["k"], ["id"], fold, [("n", pa.int64())]).count() == 0
