import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from frameloom.operators import entitlements as E
from frameloom.streaming import keyed, run

START = datetime(2024, 1, 1)
SCHEMA = "key string, ord long, ts timestamp"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Three files, each an hour or more after the one before: three micro-batches."""
    place = tmp_path_factory.mktemp("hits")
    rnd, t, rows, n = random.Random(1), START, [], 0
    for part in range(3):
        batch = []
        for _ in range(120):
            t += timedelta(seconds=rnd.choice([1, 5, 20]))
            batch.append((f"{'abc'[part]}{rnd.randrange(3)}" if rnd.random() < 0.3 else "busy", n, t))
            n += 1
        t += timedelta(hours=3)
        rows += batch
        out = place / f"tmp{part}"
        spark.createDataFrame(batch, SCHEMA).coalesce(1).write.parquet(str(out))
        (next(out.glob("*.parquet"))).rename(place / f"hits-{part}.parquet")
    return str(place), rows


def stream(spark, folder, files=1):
    return run.file_stream(spark, folder[0], "hits-*.parquet", spark.createDataFrame([], SCHEMA).schema, files)


def test_limiter_over_batches_equals_batch(spark, folder):
    out = run.drain(keyed.limit_stream(stream(spark, folder), "key", "ts", "ord", 4, 60), "t")
    batch = E.rate_limit(
        spark.createDataFrame(folder[1], SCHEMA), "key", F.unix_micros("ts") / F.lit(1e6), "ord", 4, 60
    )
    want = {(r.key, r.ord): (r.allowed, r.remaining, r.retry_after) for r in batch.collect()}
    assert {(r.key, r.ord): (r.allowed, r.remaining, r.retry_after) for r in out.collect()} == want
    assert {v[0] for v in want.values()} == {True, False}


def test_idle_counters_are_swept(spark, folder, tmp_path):
    query = (
        keyed.limit_stream(stream(spark, folder), "key", "ts", "ord", 4, 60).writeStream.format("parquet")
        .option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(str(tmp_path / "o"))
    )
    query.awaitTermination()
    kept = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    # a*, b* and c* keys live in one file each; the early ones are gone at the end.
    assert len({k for k, _, _ in folder[1]}) == 10
    assert kept[-1] < 10


def test_seats_over_batches_equal_batch(spark, folder):
    def shape(df):
        action = F.when(F.col("ord") % 97 == 96, "revoke").when(F.col("ord") % 3 == 2, "deactivate").otherwise("activate")
        return df.withColumns({"device": F.col("ord") % 5, "action": action})

    out = run.drain(keyed.seat_stream(shape(stream(spark, folder)), "key", "device", "action", "ord", F.lit(2), "ts"), "s")
    batch = E.seat_history(shape(spark.createDataFrame(folder[1], SCHEMA)), "key", "device", "action", "ord", F.lit(2))
    want = {r.ord: (r.verdict, r.active_seats) for r in batch.collect()}
    assert {r.ord: (r.verdict, r.active_seats) for r in out.collect()} == want
    assert {"activated", "limit", "revoked", "refused"} <= {v for v, _ in want.values()}


def test_only_new_or_changed_files_are_analysed(spark, tmp_path):
    schema = "namespace string, path string, size long, mtime_s long"
    seen = []

    def analyse(df):
        seen.extend(sorted((r.path, r.size) for r in df.collect()))
        return df

    def go(rows, label):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / label))
        files = run.file_stream(spark, str(tmp_path / label), "*.parquet", spark.createDataFrame([], schema).schema)
        run.analyse_new_files(files, analyse, str(tmp_path / "cache"), str(tmp_path / f"p-{label}"))

    go([("q", "a", 1, 1), ("q", "b", 1, 1), ("q", "b", 1, 1)], "first")
    go([("q", "a", 1, 1), ("q", "b", 2, 1), ("q", "c", 1, 1)], "second")
    assert seen == [("a", 1), ("b", 1), ("b", 2), ("c", 1)]
    assert spark.read.parquet(str(tmp_path / "cache")).count() == 4


@pytest.mark.parametrize("folder", [False, True])
def test_a_table_is_one_file_or_a_folder_of_files(spark, tmp_path, folder):
    import pandas as pd

    from frameloom.plans import QUERIES

    rows = pd.DataFrame({"doc_id": [1, 2, 3], "text": ["a b", "c", ""], "lang": "en", "source": "s", "n_chars": [3, 1, 0]})
    place = tmp_path / "documents.parquet"
    if folder:
        place.mkdir()
    for n in range(3 if folder else 1):
        (rows[n:n + 1] if folder else rows).to_parquet(place / f"part-{n}.parquet" if folder else place, index=False)
    got = QUERIES["ST7_incremental_analysis"](spark, str(tmp_path)).collect()
    assert sorted((r.path, r["size"], r.words) for r in got) == [("1", 3, 2), ("2", 1, 1), ("3", 0, 1)]


def test_a_busy_key_is_folded_in_parts(spark, tmp_path):
    spark.range(120_000).selectExpr("'k' AS key", "id AS ord", "timestamp_micros(1700000000000000 + id * 1000) AS ts").coalesce(1).write.parquet(str(tmp_path / "hits"))
    rows = run.file_stream(spark, str(tmp_path / "hits"), "*.parquet", "key string, ord long, ts timestamp").withWatermark("ts", "1 minute")

    def fold(columns, start, stop, state, out):
        n = state or 0
        for i in range(start, stop):
            assert columns["ord"][i] == n  # in order over all parts
            out[0][i], n = stop, n + 1
        return n

    out = keyed.stateful(rows, "key", ["ts", "ord"], fold, [("held", "long")], ["key", "ord"], "ts")
    got = run.drain(out, "parts").agg(F.count("key"), F.countDistinct("ord"), F.max("held")).first()
    assert tuple(got) == (120_000, 120_000, keyed.FOLD_ROWS)


def test_tokens_of_a_session_are_kept_in_parts(spark, tmp_path):
    """every token was one call to read and one to write; parts stay right over batches and are few."""
    rows = [(i % 2, (i * 7) % 40, i) for i in range(120)]
    for n in range(3):
        spark.createDataFrame(rows[n * 40:n * 40 + 40], "s long, tok long, seq long").selectExpr(
            "*", "timestamp_seconds(1700000000 + seq) AS ts", "timestamp_seconds(1700000110) AS e"
        ).coalesce(1).write.parquet(str(tmp_path / f"in{n}"))
        (next((tmp_path / f"in{n}").glob("part-*"))).rename(tmp_path / f"{n}.parquet")
    read = run.file_stream(spark, str(tmp_path), "*.parquet", "s long, tok long, seq long, ts timestamp, e timestamp", files_per_batch=1)
    with run.keyed_state(spark):
        stream = keyed.token_stream(read, "s", "tok", "seq", "ts", "e")
        got = {r.ord: r.outcome for r in run.drain(stream, "tokens").collect()}
        assert run.state_left(stream, "parts") <= 2 * (keyed.TOKEN_PARTS + 4)
    state, want = {}, {}
    for s, tok, i in rows:
        told = [[None]]
        state[s] = keyed.token_fold({"token": [tok], "t": [i], "expires_t": [110], "available": [True]}, 0, 1, state.get(s), told)
        want[i] = told[0][0]
    assert got == want
