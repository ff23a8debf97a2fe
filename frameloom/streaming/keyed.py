"""Stateful streams: the step functions of the batch operators, kept per key."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from frameloom.operators.entitlements import POLICY, flush_fold, limiter_fold, seat_fold

#: Counters are swept when idle for an hour; seats, sessions and usage totals when idle for half a year.
IDLE_MS, KEPT_MS = 3_600_000, 183 * 86_400_000
#: Rows of a key that are Python objects at one time; the rest of a batch waits in arrays.
FOLD_ROWS = 50_000
#: Parts that hold the spent tokens of a session; each is read and written in one call.
TOKEN_PARTS = 8


def stateful(
    rows: DataFrame, key: str, order: list[str], fold: Callable, results: list[tuple[str, str]], carried: list[str],
    time: str, idle_ms: int = IDLE_MS,
) -> DataFrame:
    """Fold the rows of every key over a stream, micro-batch by micro-batch, in order inside each.

    ``fold`` is that of the batch operator. State is one small JSON text a key; the state of a key that stays quiet for
    ``idle_ms`` behind the watermark of ``time`` is swept. A busy key is sorted as arrays and folded ``FOLD_ROWS`` at a time.
    """
    import pandas as pd

    types = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = ", ".join([*(f"{n} {types[n]}" for n in carried), *(f"{n} {t}" for n, t in results)])

    def run(group, batches, state):
        if state.hasTimedOut:
            state.remove()
            return
        # All rows have the same key, so it is left out until a part is folded.
        pdf = pd.concat([b.drop(columns=key) for b in batches], ignore_index=True)
        pdf = pdf.sort_values(order, ignore_index=True)
        kept = json.loads(state.get[0]) if state.exists else None
        for at in range(0, len(pdf), FOLD_ROWS):
            part = pdf[at : at + FOLD_ROWS]
            columns = {key: [group[0]] * len(part), **{n: part[n].tolist() for n in part.columns}}
            out = [[None] * len(part) for _ in results]
            kept = fold(columns, 0, len(part), kept, out)
            yield pd.DataFrame({**{n: columns[n] for n in carried}, **{n: o for (n, _), o in zip(results, out)}})
        if kept is not None:
            state.update((json.dumps(kept),))
            last = int(pdf[time].max().value // 1_000_000)
            state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs()) + idle_ms)
        elif state.exists:
            state.remove()

    return rows.groupBy(key).applyInPandasWithState(run, schema, "kept string", "append", GroupStateTimeout.EventTimeTimeout)


def limit_stream(
    hits: DataFrame, key: str, time: str, order: str, limit: int, window: float,
    reset: Column | None = None, late: str = "10 minutes", idle_ms: int = IDLE_MS,
) -> DataFrame:
    """Rate-limit verdict per hit; counters idle for an hour (or a longer window) are swept."""
    rows = hits.withWatermark(time, late).select(
        F.col(key).alias("key"), F.col(order).alias("ord"), F.col(time).alias("ts"),
        (F.unix_micros(F.col(time)) / F.lit(1_000_000.0)).alias("t"),
        (F.lit(False) if reset is None else F.coalesce(reset, F.lit(False))).alias("reset"),
    )
    results = [("allowed", "boolean"), ("remaining", "long"), ("retry_after", "long")]
    return stateful(rows, "key", ["t", "ord"], limiter_fold(limit, window), results, ["key", "ord"], "ts", max(idle_ms, int(window * 1000)))


def seat_stream(
    events: DataFrame, licence: str, device: str, action: str, order: str, seat_limit: Column, time: str,
    late: str = "10 minutes", idle_ms: int = KEPT_MS,
) -> DataFrame:
    """Seat verdict and active seats after each event of a licence."""
    rows = events.withWatermark(time, late).select(
        F.col(licence).alias("licence"), F.col(device).alias("device"), F.col(action).alias("action"),
        F.col(order).alias("ord"), seat_limit.cast("long").alias("seat_limit"), F.col(time).alias("ts"),
    )
    results = [("verdict", "string"), ("active_seats", "long")]
    return stateful(rows, "licence", ["ord"], seat_fold, results, ["licence", "device", "action", "ord", "seat_limit"], "ts", idle_ms)


def token_fold(columns, start, stop, state, out):
    """One session: its spent tokens, and whether it was burned, which settles every later presentation."""
    spent, burned = state or ([], False)
    spent = set(spent)
    for i in range(start, stop):
        token = columns["token"][i]
        if token in spent:
            outcome, burned = "reused", True
        elif burned:
            outcome = "revoked"
        elif columns["t"][i] >= columns["expires_t"][i]:
            outcome = "expired"
        elif not columns["available"][i]:
            outcome, burned = "user_unavailable", True
        else:
            outcome = "ok"
            spent.add(token)
        if out:
            out[0][i] = outcome
    return [sorted(spent), burned]


def token_stream(
    presented: DataFrame, session: str, token: str, order: str, time: str, expires: str, available: Column | None = None,
    late: str = "10 minutes", idle_ms: int = KEPT_MS,
) -> DataFrame:
    """Outcome of each presented refresh token; a session's tokens share its expiry.

    Spent tokens are a map state of ``TOKEN_PARTS`` entries by a hash of the token, so the calls of a batch are bounded
    however many tokens it holds, and it reads and writes only the parts that its tokens fall into. A timer sweeps a session that stays quiet for ``idle_ms`` (longer than any session lives), so the state holds living
    sessions only. The session has to name the RocksDB state store (``run.keyed_state``).
    """
    import pandas as pd
    from pyspark.sql.streaming import StatefulProcessor

    seconds = lambda c: F.unix_micros(F.col(c)) / F.lit(1e6)
    rows = presented.withWatermark(time, late).select(
        F.col(session).alias("session"), F.col(token).alias("token"), F.col(order).alias("ord"), F.col(time).alias("ts"),
        seconds(time).alias("t"), seconds(expires).alias("expires_t"),
        (F.lit(True) if available is None else F.coalesce(available, F.lit(False))).alias("available"),
        F.pmod(F.xxhash64(token), F.lit(TOKEN_PARTS)).cast("int").alias("part"),
    )
    types = {f.name: f.dataType.simpleString() for f in rows.schema}

    class Sessions(StatefulProcessor):
        def init(self, handle):
            self.handle = handle
            self.spent = handle.getMapState("spent", "part int", f"tokens array<{types['token']}>")
            self.burned = handle.getValueState("burned", "burned boolean")

        def handleInputRows(self, key, batches, timers):
            pdf = pd.concat(list(batches)).sort_values("ord")
            columns = {n: pdf[n].tolist() for n in pdf.columns}
            part_of, parts = dict(zip(columns["token"], columns["part"])), {}
            if self.spent.exists():
                parts = {p: list(self.spent.getValue((p,))[0]) for p in set(columns["part"]) if self.spent.containsKey((p,))}
            known = {k for tokens in parts.values() for k in tokens}
            was_burned = self.burned.exists()
            out = [[None] * len(pdf)]
            spent, burned = token_fold(columns, 0, len(pdf), (known, was_burned), out)
            grown = set()
            for k in set(spent) - known:
                grown.add(part_of[k])
                parts.setdefault(part_of[k], []).append(k)
            for p in grown:
                self.spent.updateValue((p,), (parts[p],))
            if burned and not was_burned:
                self.burned.update((True,))
            for at in list(self.handle.listTimers()):
                self.handle.deleteTimer(at)
            last = int(pdf["ts"].max().value // 1_000_000)
            self.handle.registerTimer(max(last, timers.getCurrentWatermarkInMs()) + idle_ms)
            yield pd.DataFrame({"session": columns["session"], "token": columns["token"], "ord": columns["ord"], "outcome": out[0]})

        def handleExpiredTimer(self, key, timers, expired):
            self.spent.clear()
            self.burned.clear()
            yield pd.DataFrame({"session": [], "token": [], "ord": [], "outcome": []})

        def close(self):
            pass

    return rows.groupBy("session").transformWithStateInPandas(
        statefulProcessor=Sessions(), outputStructType=f"session {types['session']}, token {types['token']}, ord {types['ord']}, outcome string",
        outputMode="append", timeMode="eventTime",
    )


def login_streams(attempts: DataFrame, email: str, ip: str, time: str, order: str, success: Column) -> tuple[DataFrame, DataFrame]:
    """The login policy as two streams of verdicts, by account and by address; a success clears the account's counter."""
    hits = attempts.withColumn("__ok", F.coalesce(success, F.lit(False)))
    parts = F.explode(F.when(F.col("__ok"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    doubled = hits.withColumn("__part", parts).withColumn("__seq", F.col(order) * 2 + F.col("__part"))
    limit, window = POLICY["login:email"]
    by_email = limit_stream(doubled, email, time, "__seq", limit, window, F.col("__part") == 1)
    limit, window = POLICY["login:ip"]
    return by_email, limit_stream(hits, ip, time, order, limit, window)


def flush_stream(
    events: DataFrame, machine: str, order: str, count: Column, time: str, late: str = "10 minutes", idle_ms: int = KEPT_MS,
) -> DataFrame:
    """What each usage event makes its machine send, and what stays pending."""
    rows = events.withWatermark(time, late).select(
        F.col(machine).alias("machine"), F.col(order).alias("ord"), count.cast("long").alias("count"), F.col(time).alias("ts"),
    )
    return stateful(rows, "machine", ["ord"], flush_fold, [("flushed", "long"), ("pending", "long")], ["machine", "ord"], "ts", idle_ms)


def windowed_counts(events: DataFrame, time: str, event: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Usage per tumbling window and event name."""
    return (
        events.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), event)
        .agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("window_start"), event, "n")
    )


def session_stream(shots: DataFrame, by: str, time: str, gap_seconds: int = 2700, late: str = "1 hour") -> DataFrame:
    """Events by time gaps on a stream: start, last shot and number of shots.

    Spark's session end includes the gap, so the last shot is reported instead.
    """
    gap = f"{gap_seconds} seconds"
    return (
        shots.withWatermark(time, late).groupBy(by, F.session_window(time, gap).alias("w"))
        .agg(F.min(time).alias("start_time"), F.max(time).alias("end_time"), F.count(F.lit(1)).alias("photos"))
        .select(by, "start_time", "end_time", "photos")
    )
