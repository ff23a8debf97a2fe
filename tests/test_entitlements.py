import random

import pytest
from pyspark.sql import functions as F

from frameloom.operators import entitlements as E
from frameloom.operators import ordered


@pytest.fixture(params=[10**9, 50], ids=["plain", "hot"])
def hot(request, monkeypatch):
    monkeypatch.setattr(ordered, "HOT_ROWS", request.param)


def test_limiter_against_a_loop(spark, hot):
    rnd = random.Random(2)
    rows, t = [], 0.0
    for i in range(600):
        t += rnd.choice([0.0, 1.0, 5.0, 40.0])
        rows.append(("busy" if rnd.random() < 0.7 else f"k{i % 5}", i, t, rnd.random() < 0.05))
    df = spark.createDataFrame(rows, "k string, i int, t double, r boolean")
    state, want = {}, {}
    for k, i, t, reset in rows:
        if reset:
            state.pop(k, None)
            want[i] = (True, 3, 0)
            continue
        n, start = state.get(k, (0, t))
        if t - start >= 30:
            n, start = 0, t
        state[k] = (n + 1, start)
        want[i] = (n + 1 <= 3, max(0, 2 - n), max(1, int(30 - (t - start))))
    out = E.rate_limit(df, "k", F.col("t"), "i", 3, 30, F.col("r"))
    assert {r.i: (r.allowed, r.remaining, r.retry_after) for r in out.collect()} == want


def test_seats(spark):
    rows = [
        (1, "a", "activate", 0, "activated", 1), (1, "a", "activate", 1, "reused", 1), (1, "b", "activate", 2, "activated", 2),
        (1, "c", "activate", 3, "limit", 2), (1, "a", "deactivate", 4, "released", 1), (1, "a", "deactivate", 5, "ignored", 1),
        (1, "c", "activate", 6, "activated", 2), (1, "", "revoke", 7, "revoked", 0), (1, "a", "activate", 8, "refused", 0),
        (1, "", "revoke", 9, "already_revoked", 0), (2, "a", "activate", 10, "activated", 1),
    ]
    df = spark.createDataFrame([r[:4] for r in rows], "lic int, dev string, act string, seq int")
    got = {r.seq: (r.verdict, r.active_seats) for r in E.seat_history(df, "lic", "dev", "act", "seq", F.lit(2)).collect()}
    assert got == {r[3]: (r[4], r[5]) for r in rows}


def test_admission_against_history(spark, hot):
    rnd = random.Random(4)
    rows = [(rnd.choice([1, 1, 1, 2]), f"d{rnd.randrange(6)}", i) for i in range(300)]
    df = spark.createDataFrame(rows, "lic int, dev string, seq int")
    quick = {r.seq: r.verdict for r in E.admit_seats(df, "lic", "dev", ["seq"], F.lit(3)).collect()}
    slow = E.seat_history(df.withColumn("act", F.lit("activate")), "lic", "dev", "act", "seq", F.lit(3))
    assert quick == {r.seq: r.verdict for r in slow.collect()}


def test_tokens_against_a_loop(spark):
    from frameloom.streaming.keyed import token_fold

    rnd = random.Random(6)
    rows = [(rnd.randrange(40), rnd.randrange(30), i, float(i), 150.0) for i in range(300)]
    df = spark.createDataFrame(rows, "s int, tok int, seq int, t double, e double")
    state, want = {}, {}
    for s, tok, i, t, e in rows:
        told = [[None]]
        state[s] = token_fold({"token": [tok], "t": [t], "expires_t": [e], "available": [True]}, 0, 1, state.get(s), told)
        want[i] = told[0][0]
    assert {"ok", "reused", "revoked", "expired"} == set(want.values())
    got = {r.seq: r.outcome for r in E.token_history(df, "s", "tok", "seq", "t", "e").collect()}
    assert got == want


def test_counter_flush(spark):
    df = spark.createDataFrame([("m", i, 10) for i in range(7)] + [("n", 0, -3)], "m string, i int, c int")
    got = sorted((r.m, r.i, r.flushed, r.pending) for r in E.counter_flushes(df, "m", "i", "c").collect())
    assert got == [
        ("m", 0, 0, 10), ("m", 1, 0, 20), ("m", 2, 30, 0), ("m", 3, 0, 10), ("m", 4, 0, 20), ("m", 5, 30, 0), ("m", 6, 0, 10), ("n", 0, 0, 0),
    ]


def test_running_balance_hot(spark, hot):
    df = spark.createDataFrame([(1 if i % 3 else 2, i, i * (-1) ** i) for i in range(400)], "u int, i int, a long")
    got = {r.i: r.balance_after for r in E.running_balance(df, "u", "a", ["i"]).collect()}
    total, want = {}, {}
    for i in range(400):
        u = 1 if i % 3 else 2
        total[u] = total.get(u, 0) + i * (-1) ** i
        want[i] = total[u]
    assert got == want


ACTIVATIONS = "activation string, licence int, device string, status string, activated_at int, deactivated_at int"


def test_activation_against_a_loop(spark, hot):
    rnd = random.Random(8)
    rows = []
    for i in range(120):
        status = rnd.choice(["ACTIVE", "DEACTIVATED", "DEACTIVATED", "REVOKED"])
        ended = rnd.randrange(9) if status == "DEACTIVATED" else None
        rows.append((f"a{i:03}", rnd.choice([1, 1, 2, 3, None]), rnd.choice([*"abcdefgh", None]), status, i, ended))
    asks = [(i, rnd.choice([1, 1, 2, 3, 4, None]), rnd.choice([*"abcdefghijk", None]), 1000 + rnd.randrange(50)) for i in range(200)]
    table = {r[0]: list(r) for r in rows}
    want = {}
    for seq, licence, device, at in sorted(asks, key=lambda r: (r[3], r[0])):
        mine = [r for r in table.values() if r[1] == licence and r[2] == device]
        gone = [r for r in mine if r[3] == "DEACTIVATED"]
        if licence is None or device is None:
            want[seq] = "refused"
        elif any(r[3] == "ACTIVE" for r in mine):
            want[seq] = "reused"
        elif sum(r[1] == licence and r[3] == "ACTIVE" for r in table.values()) >= 12:
            want[seq] = "limit"
        elif gone:
            max(gone, key=lambda r: (r[5], r[0]))[3:] = ["ACTIVE", at, None]
            want[seq] = "reactivated"
        else:
            table[f"n{seq}"] = [f"n{seq}", licence, device, "ACTIVE", at, None]
            want[seq] = "created"
    requests = spark.createDataFrame(asks, "seq int, licence int, device string, at int")
    new_id = F.concat(F.lit("n"), F.col("seq").cast("string"))
    out = E.activate_seats(requests, spark.createDataFrame(rows, ACTIVATIONS), ["at"], F.lit(12), new_id)
    assert {r.seq: r.verdict for r in out["verdicts"].collect()} == want
    assert set(want.values()) == {"refused", "reused", "limit", "reactivated", "created"}
    assert sorted(map(tuple, out["activations"].collect()), key=repr) == sorted(map(tuple, table.values()), key=repr)
    told = [r for r in out["audit"].collect()]
    assert len(told) == sum(v not in ("limit", "refused") for v in want.values())


def test_activation_of_empty_tables(spark):
    requests = spark.createDataFrame([], "seq int, licence int, device string, at int")
    out = E.activate_seats(requests, spark.createDataFrame([], ACTIVATIONS), ["at"], F.lit(1), F.lit("n"))
    assert all(not part.collect() for part in out.values())


def test_logout_against_a_loop(spark):
    from frameloom.operators import manifest as M

    rnd = random.Random(9)
    rows = [
        (f"t{i}", rnd.choice([1, 1, 2, 3, 4, None]), rnd.choice([None, None, 5]), None) for i in range(60)
    ] + [("gone", 9, 5, "rotated"), ("lone", None, None, None), (None, 2, None, None)]
    rows = [(t, s, at, "rotated" if at else None) for t, s, at, _ in rows]
    shown = ["gone", "lone", "nobody", None, *(f"t{rnd.randrange(60)}" for _ in range(12))]
    logouts = [(i, t, 100 + i) for i, t in enumerate(shown)]
    state = {i: list(r) for i, r in enumerate(rows)}
    want = {}
    for seq, token, at in logouts:
        session = next((r[1] for r in rows if token is not None and r[0] == token), None)
        hit = [r for r in state.values() if session is not None and r[1] == session and r[2] is None]
        for r in hit:
            r[2:] = [at, "logout"]
        want[seq] = (len(hit), bool(hit))
    tokens = spark.createDataFrame(rows, "token string, session int, revoked_at int, revoked_reason string")
    out = M.end_sessions(tokens, spark.createDataFrame(logouts, "seq int, token string, at int"))
    assert {r.seq: (r.revoked, r.ended) for r in out["outcomes"].collect()} == want
    assert sorted(map(tuple, out["tokens"].collect()), key=repr) == sorted(map(tuple, state.values()), key=repr)
    assert sorted(r.seq for r in out["audit"].collect()) == sorted(s for s, (n, _) in want.items() if n)


def test_requests_without_a_partner_are_dealt(spark):
    requests = spark.range(20000).select(
        F.col("id").alias("request"), F.lit(1).alias("user"), F.when(F.col("id") % 2 == 0, "nokey").alias("key_hash"), F.lit(" ").alias("fingerprint")
    )
    lic = spark.createDataFrame([("k", 1, 1, "ACTIVE", 0, 9)], "key_hash string, licence int, owner int, status string, starts int, expires int")
    dev = spark.createDataFrame([(1, "fp", 1, "ACTIVE")], "user int, fingerprint string, device int, status string")
    act = spark.createDataFrame([(1, 1, "ACTIVE")], "licence int, device int, status string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = E.validate_seats(requests, lic, dev, act, F.lit(5))
        sizes = [r["n"] for r in out.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
    verdicts = {r.verdict: r["count"] for r in out.groupBy("verdict").count().collect()}
    assert verdicts == {"unknown_key": 10000, "no_key": 10000}
    assert len(sizes) > 1 and max(sizes) < 2 * 20000 / len(sizes)


def test_a_judged_request_meets_no_device(spark):
    """A request that is judged by its licence stays one row, however many rows its device has."""
    requests = spark.createDataFrame([(1, 2, "k", "fp"), (2, 1, "k", "fp")], "request int, user int, key_hash string, fingerprint string")
    lic = spark.createDataFrame([("k", 1, 1, "ACTIVE", 0, 9)], "key_hash string, licence int, owner int, status string, starts int, expires int")
    dev = spark.createDataFrame([(2, "fp", 1, "ACTIVE"), (2, "fp", 2, "ACTIVE"), (1, "fp", 3, "ACTIVE")], "user int, fingerprint string, device int, status string")
    act = spark.createDataFrame([(1, 3, "ACTIVE")], "licence int, device int, status string")
    out = E.validate_seats(requests, lic, dev, act, F.lit(5)).collect()
    assert sorted((r.request, r.user, r.verdict) for r in out) == [(1, 2, "wrong_owner"), (2, 1, "ok")]


def test_the_name_of_a_first_request_is_aggregated_once(spark):
    """it stood four times in the aggregate and the name of the new seat once."""
    requests = spark.createDataFrame([(f"r{i}", i % 3, i % 4, i) for i in range(24)], "seq string, licence int, device int, at int")
    out = E.activate_seats(requests, spark.createDataFrame([], ACTIVATIONS), ["at"], F.lit(2), F.concat(F.lit("new-"), "seq"))
    plan = out["verdicts"]._jdf.queryExecution().optimizedPlan().toString()
    assert "min_by" not in plan and "new-" not in plan


def test_activation_reads_limit_and_id_off_other_columns(spark):
    """The first request of a device brings its own limit and name, also from columns that order nothing."""
    rows = [("a", 1, 1, 5, 1, "x"), ("b", 1, 1, 3, 2, "y"), ("c", 1, 2, 4, 1, "z"), ("d", 1, 2, 4, 2, "w")]
    requests = spark.createDataFrame(rows, "seq string, licence int, device int, at int, most int, tag string")
    out = E.activate_seats(requests, spark.createDataFrame([], ACTIVATIONS), ["at"], F.col("most"), F.concat("tag", "seq"))
    assert {r.seq: r.verdict for r in out["verdicts"].collect()} == {"a": "reused", "b": "created", "c": "limit", "d": "limit"}
    assert [r.activation for r in out["activations"].collect()] == ["yb"]


def test_only_one_smallest_row_a_device_is_aggregated(spark):
    """the order of a first request was aggregated twice and sent back to every request."""
    df = spark.createDataFrame([(1, "a", 0), (1, "a", 1), (1, "b", 2), (2, "c", None), (2, None, 3)], "lic int, dev string, seq int")
    out = E.admit_seats(df, "lic", "dev", ["seq"], F.lit(1))
    assert "min_by" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r.lic, r.dev, r.verdict) for r in out.collect()) == [(1, "a", "activated"), (1, "a", "reused"), (1, "b", "limit"), (2, "c", "activated")]


def test_keys_move_at_half_their_length(spark):
    """a key that is hex moves as bytes and stays apart from a key with just these bytes; blank ones match nothing."""
    requests = spark.createDataFrame(
        [(1, 7, "6162", "f"), (2, 7, "ab", "f"), (3, 7, "", "f"), (4, 7, None, "f"), (5, 7, "AB", "f"), (6, 7, "a", "f")],
        "request int, user int, key_hash string, fingerprint string",
    )
    lic = spark.createDataFrame(
        [(1, 7, "6162"), (2, 8, "ab"), (3, 7, ""), (4, 7, "")], "licence int, owner int, key_hash string"
    ).selectExpr("*", "'ACTIVE' AS status", "TIMESTAMP_NTZ '2000-01-01' AS starts", "CAST(NULL AS TIMESTAMP_NTZ) AS expires")
    dev = spark.createDataFrame([(9, 7, "f", "ACTIVE")], "device int, user int, fingerprint string, status string")
    act = spark.createDataFrame([(1, 9, "ACTIVE")], "licence int, device int, status string")
    out = E.validate_seats(requests, lic, dev, act, F.lit("2001-01-01").cast("timestamp_ntz"))
    assert sorted((r.request, r.verdict) for r in out.collect()) == [
        (1, "ok"), (2, "wrong_owner"), (3, "no_key"), (4, "no_key"), (5, "unknown_key"), (6, "unknown_key"),
    ]
    assert spark.createDataFrame([("ab" * 32,)], "k string").select(F.length(E._packed("k"))).first()[0] == 33
