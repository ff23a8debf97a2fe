import random

import pytest
from pyspark.sql import functions as F

from frameloom.operators import ordered
from frameloom.operators.ordered import OrderedGroups, first_row, fold_sorted, hot_groups, top_n

PLAIN = 10**9


@pytest.fixture(scope="module")
def rows(spark):
    rnd = random.Random(5)
    # One group holds most rows; nulls and ties in the order key.
    data = [(rnd.choice("aaaab") if rnd.random() > 0.05 else None, rnd.choice([None, 1, 2, 3]), i, rnd.random()) for i in range(4000)]
    return spark.createDataFrame(data, "g string, t int, i int, v double").cache()


@pytest.mark.parametrize("by", [["g"], []])
def test_hot_groups_give_the_same_result(rows, by):
    def run(hot_rows):
        walk = OrderedGroups(rows, by, [F.col("t").desc_nulls_last(), F.col("i")], hot_rows)
        walk.position().previous("v", "before").running_sum(F.col("i"), "total")
        assert walk.sliced == (hot_rows < PLAIN)
        return {tuple(r) for r in walk.df.select("g", "t", "i", "pos", "before", "total").collect()}

    assert run(PLAIN) == run(200)


def test_hot_groups_are_measured(rows):
    assert {k for (k,) in hot_groups(rows, ["g"], 1000).keys.collect()} == {"a"}
    assert not hot_groups(rows, ["g"], 10**6)
    assert hot_groups(rows, [], 10) and not hot_groups(rows, [], 10**6)


def test_top_n_and_first_row(rows):
    data = [r.asDict() for r in rows.collect()]
    got = {(r.g, r.i) for r in top_n(rows, ["g"], [F.col("v").desc(), F.col("i")], 5).collect()}
    want = set()
    for g in {r["g"] for r in data}:
        best = sorted((r for r in data if r["g"] == g), key=lambda r: -r["v"])[:5]
        want |= {(g, r["i"]) for r in best}
    assert got == want
    smallest = {r.g: r.i for r in first_row(rows, ["g"], F.col("v")).collect()}
    assert smallest == {g: min((r for r in data if r["g"] == g), key=lambda r: r["v"])["i"] for g in smallest}


def test_fold_sorted_keeps_state_across_batches(spark, rows):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        def step(state, row):
            n = (state or 0) + 1
            return n, {"g": row["g"], "i": row["i"], "n": n}

        data = rows.filter("g IS NOT NULL").select("g", "i")
        out = fold_sorted(data, ["g"], ["i"], step, "g string, i int, n long")
        want = OrderedGroups(data, ["g"], [F.col("i")], PLAIN).position("n").df.withColumn("n", F.col("n") + 1)
        assert {tuple(r) for r in out.collect()} == {tuple(r) for r in want.select("g", "i", "n").collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_story_places_hot_groups_alike(spark, monkeypatch):
    from frameloom.operators import ordered
    from frameloom.operators import selection as sel

    pool = spark.range(400).select(
        F.when(F.col("id") % 40 != 0, F.col("id") % 3).alias("project"), F.concat(F.lit("p"), F.col("id").cast("string")).alias("path"),
        F.when(F.col("id") % 7 != 0, (F.col("id") * 37 % 101).cast("double")).alias("quality"),
        F.when(F.col("id") % 11 != 0, F.col("id") * 53 % 97).alias("taken"), (F.col("id") % 5 == 0).alias("best"),
        (F.col("id") % 2 == 0).alias("faces"), (F.col("id") % 6).alias("n"),
    )
    told = []
    for limit in (10**9, 40):
        monkeypatch.setattr(ordered, "HOT_ROWS", limit)
        rows = sel.story(pool, ["project"], "path", "quality", "taken", "best", "faces", "n").collect()
        told.append(sorted(map(tuple, rows), key=repr))
    assert told[0] == told[1]
    for section in ("Ceremony", "Family", "Portraits", "Closing", "Highlights", "Cover"):
        assert any(r[2] == section for r in told[0])
    for project in (0, 1, 2, None):
        assert sorted(r[3] for r in told[0] if r[0] == project and r[2] == "Ceremony") == list(range(pool.filter(F.col("project").eqNullSafe(F.lit(project))).count()))


def test_keys_are_counted_only_under_a_busy_hash(spark, monkeypatch):
    """ordinary groups were counted key by key, which moved every key there is."""
    monkeypatch.setattr(ordered, "MARKS", 8)
    df = spark.range(2_000).selectExpr("CASE WHEN id % 4 = 0 THEN NULL ELSE id % 500 END AS k")
    assert [r.k for r in hot_groups(df, ["k"], 400).keys.collect()] == [None]
    assert not hot_groups(df, ["k"], 500)
    assert hot_groups(df, ["k"], 1_900).keys is None
