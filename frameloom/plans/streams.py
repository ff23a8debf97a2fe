"""Queries that run as real streams over the given event files."""

from __future__ import annotations

from pyspark.sql import functions as F

from frameloom.plans.entitlements import presented_columns  # also registers the batch twins first
from frameloom.plans.registry import ORACLES, query, table
from frameloom.session import scratch_dir
from frameloom.streaming import keyed, run


def events_stream(spark, d):
    rows = run.table_stream(table(spark, d, "events"), d, "events.parquet")
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def naive(df, *columns):
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in columns})


@query("ST1_rate_limit_stream", ORACLES["ST1_rate_limit"])
def rate_limit(spark, d):
    out = keyed.limit_stream(events_stream(spark, d), "user_id", "ts", "event_id", 3, 86400)
    done = run.drain(out, "limits")
    return done.select(F.col("key").alias("user_id"), F.col("ord").alias("event_id"), "allowed", "remaining", "retry_after")


@query("ST2_login_stream", ORACLES["ST2_login_policy"])
def logins(spark, d):
    rows = events_stream(spark, d).withColumn("ip", F.concat(F.lit("10.0.0."), (F.col("user_id") % 7).cast("string")))
    by_email, by_ip = keyed.login_streams(rows, "user_id", "ip", "ts", "event_id", F.col("event_type") == "purchase")
    email = run.drain(by_email, "logins").where("ord % 2 = 0").select(
        (F.col("ord") / 2).cast("long").alias("event_id"), F.col("allowed").alias("email_allowed"), F.col("remaining").alias("email_remaining")
    )
    ip = run.drain(by_ip, "logins").select(
        F.col("ord").alias("event_id"), F.col("allowed").alias("ip_allowed"), F.col("remaining").alias("ip_remaining")
    )
    return email.join(ip, "event_id")


@query(
    "ST9_state_sweep",
    """WITH l AS (SELECT user_id, max(ts) AS l FROM events GROUP BY user_id), w AS (SELECT max(ts) - INTERVAL 10 MINUTE AS w FROM events),
    k AS (SELECT count(*) AS users, count(*) FILTER (l + INTERVAL 2 DAY > w) AS kept FROM l, w)
    SELECT unnest(['limits', 'seats', 'totals']) AS state, users, kept FROM k""",
)
def sweep(spark, d):
    """Keys with state when the stream ends: users that were quiet for two days have none left."""
    idle, rows = 2 * 86_400_000, events_stream(spark, d)
    streams = {
        "limits": keyed.limit_stream(rows, "user_id", "ts", "event_id", 3, 3600, idle_ms=idle),
        "seats": keyed.seat_stream(rows.withColumn("action", F.lit("activate")), "user_id", "event_type", "action", "event_id", F.lit(2), "ts", idle_ms=idle),
        "totals": keyed.flush_stream(rows, "user_id", "event_id", F.col("event_id") % 6, "ts", idle_ms=idle),
    }
    users = table(spark, d, "events").agg(F.count_distinct("user_id")).first()[0]
    left = [(name, users, run.state_left(stream, "sweep")) for name, stream in streams.items()]
    return spark.createDataFrame(left, "state string, users long, kept long")


@query("ST3_seat_stream", ORACLES["ST3_seat_history"])
def seats(spark, d):
    e = F.col("event_type")
    action = F.when((e == "error") & (F.col("event_id") % 20 == 0), "revoke").when(e.isin("purchase", "error"), "deactivate").otherwise("activate")
    rows = events_stream(spark, d).withColumns({"device": F.col("event_id") % 5, "action": action})
    done = run.drain(keyed.seat_stream(rows, "user_id", "device", "action", "event_id", F.lit(2), "ts"), "seats")
    return done.select(F.col("ord").alias("event_id"), "verdict", "active_seats")


@query("ST4_token_stream", ORACLES["ST4_token_reuse"])
def tokens(spark, d):
    rows = events_stream(spark, d).select("event_id", "user_id", "ts", *presented_columns())
    rows = rows.withColumn("expires", F.col("expires").cast("timestamp"))
    out = keyed.token_stream(rows, "user_id", "token", "event_id", "ts", "expires", F.col("available"))
    with run.keyed_state(spark):
        return run.drain(out, "tokens").select(F.col("ord").alias("event_id"), "outcome")


@query("ST5_flush_stream", ORACLES["ST5_counter_flush"])
def flushes(spark, d):
    out = keyed.flush_stream(events_stream(spark, d), "user_id", "event_id", F.col("event_id") % 6, "ts")
    return run.drain(out, "flushes").select(F.col("machine").alias("user_id"), F.col("ord").alias("event_id"), "flushed", "pending")


# Every change of a window is reported; the last report of each counts, also behind the watermark.
@query("ST5_windowed_counts", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL")
def windowed(spark, d):
    out = keyed.windowed_counts(events_stream(spark, d), "ts", "event_type")
    return naive(run.drain_latest(out, "windows", ["window_start", "event_type"]), "window_start")


@query(
    "ST6_event_sessions",
    """WITH g AS (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER w) > 21600000000 THEN 1 ELSE 0 END AS opens FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    s AS (SELECT user_id, ts, sum(opens) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS seg FROM g),
    b AS (SELECT user_id, min(ts) AS start_time, max(ts) AS end_time, count(*) AS photos FROM s GROUP BY user_id, seg)
    SELECT * FROM b""",
)
def sessions(spark, d):
    out = keyed.session_stream(events_stream(spark, d), "user_id", "ts", 21600)
    return naive(run.drain_latest(out, "sessions", None), "start_time", "end_time")


@query("ST7_incremental_analysis", "SELECT source AS namespace, CAST(doc_id AS VARCHAR) AS path, n_chars AS size, len(string_split(text, ' ')) AS words FROM documents")
def incremental(spark, d):
    place = scratch_dir(spark, "analysis")

    def files():
        docs = run.table_stream(table(spark, d, "documents"), d, "documents.parquet")
        return docs.select(
            F.col("source").alias("namespace"), F.col("doc_id").cast("string").alias("path"), F.col("n_chars").alias("size"),
            F.lit(0).cast("long").alias("mtime_s"), "text",
        )

    def words(df):
        return df.withColumn("words", F.size(F.split("text", " ")).cast("long")).drop("text")

    run.analyse_new_files(files(), words, f"{place}/cache", f"{place}/progress")
    # The same files from a new stream: nothing is stale, so nothing is analysed twice.
    run.analyse_new_files(files(), words, f"{place}/cache", f"{place}/progress_again")
    return spark.read.parquet(f"{place}/cache").select("namespace", "path", "size", "words")


@query(
    "ST8_audit_append",
    """SELECT event_id, upper(event_type) AS action, concat('{"value":', user_id, ',"session_token":"[redacted]"}') AS metadata FROM events""",
)
def audit(spark, d):
    rows = events_stream(spark, d).select(
        "event_id", F.upper("event_type").alias("action"),
        F.concat(F.lit('{"value":'), F.col("user_id").cast("string"), F.lit(',"session_token":"'), F.md5("props"), F.lit('"}')).alias("metadata"),
    )
    return run.drain(run.append_audit(rows, "metadata"), "audit")


