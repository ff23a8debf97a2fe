"""Queries over licences, seats, sessions, ledgers, usage and keyed updates."""

from __future__ import annotations

from pyspark.sql import functions as F

from frameloom.functions import licence as L
from frameloom.functions.boxes import box_from_eyes, clip_boxes
from frameloom.functions.scalar import key_hash
from frameloom.operators import entitlements as E
from frameloom.operators import manifest as M
from frameloom.operators import selection as sel
from frameloom.plans import views as V
from frameloom.plans.registry import query, table, with_views

LIC = with_views(V.LICENCES)
ACT = with_views(V.LICENCES, V.ACTIVATIONS)
NOW = f"TIMESTAMP '{V.AS_OF}'"


def now():
    return F.lit(V.AS_OF).cast("timestamp_ntz")


# -- licence rules -------------------------------------------------------------------- #
VALID_SQL = f"status NOT IN ('REVOKED', 'SUSPENDED', 'PENDING') AND {NOW} >= starts AND coalesce({NOW} < expires, true)"
REASON_SQL = f"CASE status WHEN 'REVOKED' THEN 'revoked' WHEN 'SUSPENDED' THEN 'suspended' WHEN 'PENDING' THEN 'pending' ELSE CASE WHEN {NOW} < starts THEN 'not_started' WHEN {NOW} >= expires THEN 'expired' END END"


@query("P26_licence_valid_at", LIC + f"SELECT licence, {VALID_SQL} AS valid FROM licences")
def valid(spark, d):
    return V.licences(spark, d).select("licence", L.licence_valid_at(F.col("status"), F.col("starts"), F.col("expires"), now()).alias("valid"))


@query("P27_licence_reject_reason", LIC + f"SELECT licence, {REASON_SQL} AS reason FROM licences")
def reason(spark, d):
    return V.licences(spark, d).select("licence", L.licence_reject_reason(F.col("status"), F.col("starts"), F.col("expires"), now()).alias("reason"))


@query(
    "P28_client_licence_state",
    """WITH c AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 > 0 THEN concat('K', o_orderkey) ELSE '' END AS k, o_orderdate::DATE AS activated, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE (o_orderdate + INTERVAL 400 DAY)::DATE END AS expires,
      CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE (o_orderdate + INTERVAL 1 DAY * (o_orderkey % 60))::DATE END AS checked, (o_orderdate + INTERVAL 40 DAY)::DATE AS today FROM orders),
    s AS (SELECT *, date_diff('day', coalesce(checked, activated), today) AS since, greatest(0, 14 - date_diff('day', activated, today + CAST(-(o_orderkey % 50) AS INTEGER))) AS trial FROM c)
    SELECT o_orderkey, CASE WHEN k <> '' THEN CASE WHEN expires < today THEN 'expired' WHEN since > 21 THEN 'expired' WHEN since > 7 THEN 'grace' ELSE 'active' END WHEN trial > 0 THEN 'trial' ELSE 'trial_expired' END AS state,
    CASE WHEN k <> '' THEN CASE WHEN NOT coalesce(expires < today, false) AND since <= 21 AND since > 7 THEN 21 - since END WHEN trial > 0 THEN trial END AS days_left FROM s""",
)
def client_state(spark, d):
    k = F.col("o_orderkey")
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    df = table(spark, d, "orders").select(
        k, F.when(k % 3 > 0, F.concat(F.lit("K"), k.cast("string"))).otherwise("").alias("k"),
        F.to_date("o_orderdate").alias("activated"), F.to_date(F.col("o_orderdate") + F.expr("INTERVAL 40 DAYS")).alias("today"),
    )
    df = df.withColumns(
        {
            "expires": F.when(k % 5 == 0, F.lit("")).otherwise(day(F.date_add("activated", 400))),
            "checked": F.when(k % 4 == 0, F.lit("")).otherwise(day(F.date_add("activated", (k % 60).cast("int")))),
            "first_run": day(F.date_add("activated", (k % 50).cast("int"))),
        }
    )
    state = L.client_state(F.col("k"), F.col("activated"), F.col("expires"), F.col("checked"), F.col("first_run"), F.col("today"))
    return df.select(k, state.alias("s")).select("o_orderkey", "s.state", "s.days_left")


# Each event presents a token: its number is a fingerprint of the row.
TOKENS = """toks AS (SELECT event_id, user_id, CASE WHEN event_id % 3 = 0 THEN ts + INTERVAL 1 DAY END AS revoked_at, CASE WHEN event_id % 5 = 0 THEN event_id + 1 END AS replaced_by,
  ts + INTERVAL 1 DAY * (event_id % 40) AS expires, CASE WHEN user_id % 4 = 0 THEN 'DISABLED' ELSE 'ACTIVE' END AS user_status FROM events)"""
MOMENT = "TIMESTAMP '2024-01-20'"


def tokens(spark, d):
    k = F.col("event_id")
    return table(spark, d, "events").select(
        k, "user_id", F.when(k % 3 == 0, F.col("ts") + F.expr("INTERVAL 1 DAY")).alias("revoked_at"), F.when(k % 5 == 0, k + 1).alias("replaced_by"),
        (F.col("ts") + F.make_dt_interval((k % 40).cast("int"))).alias("expires"), F.when(F.col("user_id") % 4 == 0, "DISABLED").otherwise("ACTIVE").alias("user_status"),
    )


@query(
    "P29_token_outcome",
    with_views(TOKENS) + f"""SELECT e.event_id, coalesce(revoked_at IS NULL AND replaced_by IS NULL AND {MOMENT} < expires, false) AS usable, CASE WHEN t.event_id IS NULL THEN 'unknown' WHEN replaced_by IS NOT NULL THEN 'reused'
    WHEN revoked_at IS NOT NULL THEN 'revoked' WHEN {MOMENT} >= expires THEN 'expired' WHEN user_status <> 'ACTIVE' THEN 'user_unavailable' ELSE 'ok' END AS outcome FROM events e LEFT JOIN toks t ON t.event_id = CASE WHEN e.event_id % 7 = 0 THEN -1 - e.event_id ELSE e.event_id END""",
)
def token_outcome(spark, d):
    t = tokens(spark, d).withColumn("known", F.lit(True))
    moment = F.lit("2024-01-20").cast("timestamp_ntz")
    # Every seventh presentation shows a token that was never given out.
    shown = table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 7 == 0, -1 - F.col("event_id")).otherwise(F.col("event_id")).alias("shown"))
    joined = shown.join(t.withColumnRenamed("event_id", "shown"), "shown", "left")
    usable = L.token_usable_at(F.col("revoked_at"), F.col("replaced_by"), F.col("expires"), moment) & F.col("known")
    outcome = L.token_outcome(F.col("known"), F.col("replaced_by"), F.col("revoked_at"), F.col("expires"), F.col("user_status") == "ACTIVE", moment)
    return joined.select("event_id", F.coalesce(usable, F.lit(False)).alias("usable"), outcome.alias("outcome"))


ALLOWED = ("click", "view", "purchase", "signup")


def usage(spark, d):
    return table(spark, d, "events").select(
        "event_id", F.col("user_id").alias("machine"), F.col("event_type").alias("event"),
        (F.col("event_id") % 5 - 1).alias("count"), (F.col("user_id") % 6 > 0).alias("consent"),
    )


USAGE = "usage AS (SELECT event_id, user_id AS machine, event_type AS event, event_id % 5 - 1 AS count, user_id % 6 > 0 AS consent FROM events)"
KNOWN = "event IN ('click', 'view', 'purchase', 'signup')"


@query(
    "P30_event_allow_list",
    with_views(USAGE) + f"SELECT event_id, event, greatest(count, 0) AS count, true AS accepted FROM usage WHERE {KNOWN} AND consent UNION ALL SELECT event_id, event, count, false FROM usage WHERE NOT {KNOWN}",
)
def allow_list(spark, d):
    good, bad = E.allow_listed(usage(spark, d), "event", "count", "consent", ALLOWED)
    return good.withColumn("accepted", F.lit(True)).unionByName(bad.withColumn("accepted", F.lit(False))).select(
        "event_id", "event", F.col("count").cast("long").alias("count"), "accepted"
    )


@query("A12_usage_counts", with_views(USAGE) + f"SELECT machine, event, CAST(sum(greatest(count, 0)) AS BIGINT) AS count FROM usage WHERE {KNOWN} AND consent GROUP BY machine, event")
def usage_counts(spark, d):
    good, _ = E.allow_listed(usage(spark, d), "event", "count", "consent", ALLOWED)
    return E.usage_counts(good, "machine", "event", "count")


@query(
    "A12_usage_payload",
    with_views(USAGE) + f"""SELECT machine, string_agg(concat(event, '=', n), ',' ORDER BY event) AS counts, CAST(sum(n) AS BIGINT) AS total FROM (SELECT machine, event, CAST(sum(greatest(count, 0)) AS BIGINT) AS n FROM usage WHERE {KNOWN} AND consent GROUP BY machine, event) GROUP BY machine""",
)
def usage_payload(spark, d):
    p = E.usage_payload(usage_counts(spark, d), "machine", "event", "count")
    text = F.array_join(F.transform(F.array_sort(F.map_keys("counts")), lambda k: F.concat(k, F.lit("="), F.col("counts")[k].cast("string"))), ",")
    return p.select("machine", text.alias("counts"), "total")


# -- listings ---------------------------------------------------------------------------- #
@query(
    "J10_licences_with_owner",
    LIC + "SELECT licence, c_name AS owner_name, status FROM licences JOIN customer ON c_custkey = owner WHERE status = 'ACTIVE' ORDER BY starts DESC, licence LIMIT 100 OFFSET 20",
)
def with_owner(spark, d):
    joined = V.licences(spark, d).join(table(spark, d, "customer"), F.col("owner") == F.col("c_custkey"))
    wanted = sel.optional_filters(joined, {"status": "ACTIVE", "owner": None})
    return sel.page(wanted, [F.col("starts").desc(), F.col("licence")], 100, 20).select("licence", F.col("c_name").alias("owner_name"), "status")


SEATS = ", seats AS (SELECT licence, count(*) AS active_devices FROM activations WHERE status = 'ACTIVE' GROUP BY licence), listed AS (SELECT l.*, coalesce(s.active_devices, 0) AS active_devices FROM licences l LEFT JOIN seats s ON s.licence = l.licence)"


def listed(spark, d):
    return E.licences_with_seats(V.licences(spark, d), V.activations(spark, d), "licence")


@query("J11_active_seats", ACT + SEATS + "SELECT licence, active_devices FROM listed")
def active_seats(spark, d):
    return listed(spark, d).select("licence", "active_devices")


@query("J12_licence_devices", ACT + "SELECT licence, device, s_name AS device_name, status, activated_at FROM activations JOIN supplier ON s_suppkey = device")
def licence_devices(spark, d):
    devices = table(spark, d, "supplier").select(F.col("s_suppkey").alias("device"), F.col("s_name").alias("device_name"))
    out = E.licence_devices(V.activations(spark, d), devices, "device").select("licence", "device", "device_name", "status", "activated_at")
    return out.orderBy("licence", F.col("activated_at").desc())


USERS = "users AS (SELECT c_custkey AS user, c_name AS name, CASE WHEN c_custkey % 9 = 0 THEN 'DISABLED' WHEN c_custkey % 10 = 0 THEN 'PENDING' ELSE 'ACTIVE' END AS status FROM customer)"


def users(spark, d):
    k = F.col("c_custkey")
    return table(spark, d, "customer").select(
        k.alias("user"), F.col("c_name").alias("name"), F.when(k % 9 == 0, "DISABLED").when(k % 10 == 0, "PENDING").otherwise("ACTIVE").alias("status")
    )


@query(
    "A15_overview",
    with_views(V.LICENCES, V.ACTIVATIONS, USERS) + SEATS + """SELECT (SELECT count(*) FROM users) AS users, (SELECT count(*) FROM users WHERE status = 'ACTIVE') AS active_users,
    count(*) AS licences, count(*) FILTER (status = 'ACTIVE') AS active_licences, CAST(sum(active_devices) AS BIGINT) AS active_devices FROM listed""",
)
def overview(spark, d):
    return E.overview(users(spark, d), listed(spark, d))


@query(
    "A16_total_and_page",
    with_views(USERS) + "SELECT user, name, (SELECT count(*) FROM users WHERE status = 'ACTIVE') AS total FROM users WHERE status = 'ACTIVE' ORDER BY name DESC, user LIMIT 20 OFFSET 40",
)
def total_and_page(spark, d):
    active = sel.optional_filters(users(spark, d), {"status": "ACTIVE"})
    return E.total_and_page(active, [F.col("name").desc(), F.col("user")], 20, 40).select("user", "name", "total")


# A request validates one activation row: sometimes with a foreign user, an unknown key or a blank device.
REQUESTS = """reqs AS (SELECT concat(licence, '-', line, '-', part, '-', CAST(round(price * 100) AS BIGINT)) AS request, CASE WHEN part % 6 = 0 THEN -1 ELSE o_custkey END AS user,
  CASE WHEN part % 11 = 0 THEN '' WHEN part % 13 = 0 THEN 'nokey' ELSE CAST(licence AS VARCHAR) END AS key, CASE WHEN part % 17 = 0 THEN ' ' WHEN part % 19 = 0 THEN 'fp?' ELSE concat('fp', device) END AS fp FROM activations JOIN orders ON o_orderkey = licence)"""


@query(
    "J13_validate_seats",
    ACT + ", " + REQUESTS + f""", devs AS (SELECT DISTINCT o_custkey AS user, concat('fp', device) AS fp, device, device % 23 = 0 AS revoked FROM activations JOIN orders ON o_orderkey = licence),
    live AS (SELECT DISTINCT licence, device FROM activations WHERE status = 'ACTIVE'), j AS (SELECT q.*, l.licence, l.owner, {REASON_SQL} AS reason, dv.device, dv.revoked, live.device AS act
      FROM reqs q LEFT JOIN licences l ON CAST(l.licence AS VARCHAR) = q.key LEFT JOIN devs dv ON dv.user = q.user AND dv.fp = trim(q.fp) LEFT JOIN live ON live.licence = l.licence AND live.device = dv.device)
    SELECT request, CASE WHEN key = '' THEN 'no_key' WHEN licence IS NULL THEN 'unknown_key' WHEN owner <> user THEN 'wrong_owner' WHEN reason IS NOT NULL THEN reason WHEN trim(fp) = '' THEN 'no_fingerprint'
      WHEN device IS NULL THEN 'unknown_device' WHEN revoked THEN 'device_revoked' WHEN act IS NULL THEN 'not_activated' ELSE 'ok' END AS verdict FROM j""",
)
def validate_seats(spark, d):
    act = V.activations(spark, d)
    owners = table(spark, d, "orders").select(F.col("o_orderkey").alias("licence"), F.col("o_custkey").alias("user"))
    owned = act.join(owners, "licence")
    part = F.col("part")
    raw = F.when(part % 11 == 0, "").when(part % 13 == 0, "nokey").otherwise(F.col("licence").cast("string"))
    requests = owned.select(
        F.concat_ws("-", "licence", "line", "part", F.round(F.col("price") * 100).cast("long")).alias("request"),
        F.when(part % 6 == 0, F.lit(-1).cast("long")).otherwise(F.col("user")).alias("user"), key_hash(raw).alias("key_hash"),
        F.when(part % 17 == 0, " ").when(part % 19 == 0, "fp?").otherwise(F.concat(F.lit("fp"), F.col("device").cast("string"))).alias("fingerprint"),
    )
    lic = V.licences(spark, d).withColumn("key_hash", key_hash(F.col("licence").cast("string")))
    dev = owned.select("user", F.concat(F.lit("fp"), F.col("device").cast("string")).alias("fingerprint"), "device").distinct().withColumn(
        "status", F.when(F.col("device") % 23 == 0, "REVOKED").otherwise("ACTIVE")
    )
    return E.validate_seats(requests, lic, dev, act, now()).select("request", "verdict")


@query(
    "J14_uniqueness_check",
    """WITH old AS (SELECT DISTINCT p_brand, p_type FROM part WHERE p_partkey % 4 = 0), inc AS (SELECT p_partkey, p_brand, p_type FROM part WHERE p_partkey % 4 > 0)
    SELECT p_partkey, o.p_brand IS NULL AND p_partkey = min(p_partkey) OVER (PARTITION BY i.p_brand, i.p_type) AS accepted FROM inc i LEFT JOIN old o ON o.p_brand = i.p_brand AND o.p_type = i.p_type""",
)
def uniqueness(spark, d):
    part = table(spark, d, "part")
    good, bad = E.unique_inserts(part.filter("p_partkey % 4 = 0"), part.filter("p_partkey % 4 > 0"), ["p_brand", "p_type"], "p_partkey")
    return good.select("p_partkey", F.lit(True).alias("accepted")).unionByName(bad.select("p_partkey", F.lit(False).alias("accepted")))


# -- ledgers ------------------------------------------------------------------------------- #
LEDGER = with_views(V.LEDGER)


@query("A13_credit_balance", LEDGER + "SELECT user_id, CAST(sum(amount) AS BIGINT) AS balance FROM ledger GROUP BY user_id")
def balance(spark, d):
    return E.balances(V.ledger(spark, d), "user_id", "amount")


@query("W5_running_balance", LEDGER + "SELECT event_id, CAST(sum(amount) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS balance_after FROM ledger")
def running_balance(spark, d):
    return E.running_balance(V.ledger(spark, d), "user_id", "amount", ["ts", "event_id"]).select("event_id", "balance_after")


@query(
    "W6_idempotent_ledger",
    LEDGER + "SELECT event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, reference ORDER BY ts, event_id) AS r FROM ledger) WHERE reference IS NULL OR r = 1",
)
def idempotent(spark, d):
    return E.first_per_reference(V.ledger(spark, d), "user_id", "reference", ["ts", "event_id"]).select("event_id")


@query(
    "A14_reservations",
    f"""WITH r AS (SELECT o_custkey AS user, CAST(round(o_totalprice) AS BIGINT) AS amount, CASE o_orderstatus WHEN 'O' THEN 'OPEN' WHEN 'F' THEN 'COMMITTED' ELSE 'RELEASED' END AS status, o_orderdate + INTERVAL 60 DAY AS expires_at FROM orders)
    SELECT user, CAST(coalesce(sum(amount) FILTER (status = 'OPEN' AND expires_at > {NOW}), 0) AS BIGINT) AS held, CAST(coalesce(sum(amount) FILTER (status = 'OPEN' AND expires_at <= {NOW}), 0) AS BIGINT) AS released,
    count(*) FILTER (status = 'OPEN' AND expires_at <= {NOW}) AS expired_count, CAST(coalesce(sum(amount) FILTER (status = 'COMMITTED'), 0) AS BIGINT) AS committed FROM r GROUP BY user""",
)
def reservations(spark, d):
    s = F.col("o_orderstatus")
    r = table(spark, d, "orders").select(
        F.col("o_custkey").alias("user"), F.round("o_totalprice").cast("long").alias("amount"),
        F.when(s == "O", "OPEN").when(s == "F", "COMMITTED").otherwise("RELEASED").alias("status"),
        (F.col("o_orderdate") + F.expr("INTERVAL 60 DAYS")).alias("expires_at"),
    )
    return E.reservation_totals(r, "user", now())


# -- seats and releases ---------------------------------------------------------------------- #
SEAT_ORDER = "activated_at, line, part, price"


@query(
    "W7_seat_admission",
    with_views(V.ACTIVATIONS) + f""", f AS (SELECT licence, device, min(({SEAT_ORDER})) AS first FROM activations GROUP BY licence, device), s AS (SELECT *, row_number() OVER (PARTITION BY licence ORDER BY first, device) AS seat FROM f)
    SELECT a.licence, a.device, a.line, a.part, CASE WHEN seat > 2 THEN 'limit' WHEN ({SEAT_ORDER}) = first THEN 'activated' ELSE 'reused' END AS verdict FROM activations a JOIN s ON s.licence = a.licence AND s.device = a.device""",
)
def seat_admission(spark, d):
    return E.admit_seats(V.activations(spark, d), "licence", "device", SEAT_ORDER.split(", "), F.lit(2)).select("licence", "device", "line", "part", "verdict")


@query(
    "W9_previous_activation",
    with_views(V.ACTIVATIONS) + "SELECT licence, device, part, deactivated_at FROM (SELECT *, row_number() OVER (PARTITION BY licence, device ORDER BY deactivated_at DESC, part DESC, price DESC) AS r FROM activations WHERE status = 'DEACTIVATED') WHERE r = 1",
)
def previous_activation(spark, d):
    act = V.activations(spark, d).withColumn("tie", F.struct("part", "price"))
    return E.previous_activation(act, ["licence", "device"], "deactivated_at", "tie").select("licence", "device", "part", "deactivated_at")


# Every seat asks again 60 days later, and the customer of every order asks with a device of their own.
SEAT_REQUESTS = """acts AS (SELECT concat_ws('-', licence, device, line, part, CAST(round(price * 100) AS BIGINT)) AS activation, licence, device, status, activated_at, deactivated_at FROM activations),
  asks AS (SELECT concat('again-', activation) AS seq, licence, device, activated_at + INTERVAL 60 DAY AS moment FROM acts
    UNION ALL SELECT concat('own-', o_orderkey), o_orderkey, -o_custkey, o_orderdate + INTERVAL 90 DAY FROM orders),
  holders AS (SELECT DISTINCT licence, device FROM acts WHERE status = 'ACTIVE'), used AS (SELECT licence, count(*) AS used FROM acts WHERE status = 'ACTIVE' GROUP BY licence),
  firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY licence, device ORDER BY moment, seq) AS r FROM asks) WHERE r = 1),
  seats AS (SELECT f.*, h.device IS NOT NULL AS holds, coalesce(used, 0) AS used, sum(CASE WHEN h.device IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY f.licence ORDER BY f.moment, f.seq) AS seat
    FROM firsts f LEFT JOIN holders h ON h.licence = f.licence AND h.device = f.device LEFT JOIN used u ON u.licence = f.licence),
  before AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY licence, device ORDER BY deactivated_at DESC, activation DESC) AS r FROM acts WHERE status = 'DEACTIVATED') WHERE r = 1),
  given AS (SELECT s.*, b.activation AS previous, CASE WHEN holds THEN 'reused' WHEN used + seat > 4 THEN 'limit' WHEN b.activation IS NOT NULL THEN 'reactivated' ELSE 'created' END AS given
    FROM seats s LEFT JOIN before b ON b.licence = s.licence AND b.device = s.device)"""


def activated(spark, d):
    act = V.activations(spark, d)
    name = F.concat_ws("-", "licence", "device", "line", "part", F.round(F.col("price") * 100).cast("long"))
    acts = act.select(name.alias("activation"), "licence", "device", "status", "activated_at", "deactivated_at")
    again = acts.select(
        F.concat(F.lit("again-"), "activation").alias("seq"), "licence", "device", (F.col("activated_at") + F.expr("INTERVAL 60 DAYS")).alias("at")
    )
    own = table(spark, d, "orders").select(
        F.concat(F.lit("own-"), F.col("o_orderkey").cast("string")).alias("seq"), F.col("o_orderkey").alias("licence"), (-F.col("o_custkey")).alias("device"),
        (F.col("o_orderdate") + F.expr("INTERVAL 90 DAYS")).alias("at"),
    )
    return E.activate_seats(again.unionByName(own), acts, ["at"], F.lit(4), F.concat(F.lit("new-"), "seq"))


@query(
    "W9_reactivate_seats",
    with_views(V.ACTIVATIONS, SEAT_REQUESTS) + """SELECT a.activation, CASE WHEN g.previous IS NULL THEN a.status ELSE 'ACTIVE' END AS status, CASE WHEN g.previous IS NULL THEN a.activated_at ELSE g.moment END AS activated_at,
      CASE WHEN g.previous IS NULL THEN a.deactivated_at END AS deactivated_at FROM acts a LEFT JOIN given g ON g.previous = a.activation AND g.given = 'reactivated'
    UNION ALL SELECT concat('new-', seq), 'ACTIVE', moment, NULL FROM given WHERE given = 'created'""",
)
def reactivate_seats(spark, d):
    return activated(spark, d)["activations"].select("activation", "status", "activated_at", "deactivated_at")


@query(
    "W9_activation_verdicts",
    with_views(V.ACTIVATIONS, SEAT_REQUESTS) + """SELECT a.seq, CASE WHEN g.seq = a.seq OR g.given = 'limit' THEN g.given ELSE 'reused' END AS verdict FROM asks a JOIN given g ON g.licence = a.licence AND g.device = a.device""",
)
def activation_verdicts(spark, d):
    return activated(spark, d)["verdicts"].select("seq", "verdict")


RELEASES = "releases AS (SELECT o_orderkey AS release, o_orderpriority AS channel, o_custkey % 3 AS platform, CASE o_orderstatus WHEN 'O' THEN 'PUBLISHED' WHEN 'F' THEN 'DRAFT' ELSE 'YANKED' END AS status, CASE WHEN o_orderstatus <> 'F' THEN o_orderdate END AS published_at, CAST(NULL AS VARCHAR) AS notes FROM orders)"


def releases(spark, d):
    s = F.col("o_orderstatus")
    return table(spark, d, "orders").select(
        F.col("o_orderkey").alias("release"), F.col("o_orderpriority").alias("channel"), (F.col("o_custkey") % 3).alias("platform"),
        F.when(s == "O", "PUBLISHED").when(s == "F", "DRAFT").otherwise("YANKED").alias("status"), F.when(s != "F", F.col("o_orderdate")).alias("published_at"),
        F.lit(None).cast("string").alias("notes"),
    )


@query("W8_current_release", with_views(RELEASES) + "SELECT platform, channel, release, published_at FROM (SELECT *, row_number() OVER (PARTITION BY platform, channel ORDER BY published_at DESC, release DESC) AS r FROM releases WHERE status = 'PUBLISHED') WHERE r = 1")
def current_release(spark, d):
    return E.current_releases(releases(spark, d), ["platform", "channel"], "published_at", "release").select("platform", "channel", "release", "published_at")


@query(
    "A17_revoked_counts",
    with_views(TOKENS) + "SELECT c.user_id, count(t.event_id) AS revoked FROM (SELECT DISTINCT user_id FROM events WHERE event_type = 'error') c LEFT JOIN toks t ON t.user_id = c.user_id AND t.revoked_at IS NULL GROUP BY c.user_id",
)
def revoked_counts(spark, d):
    commands = table(spark, d, "events").filter("event_type = 'error'").select("user_id")
    return M.revoked_counts(tokens(spark, d), "user_id", "revoked_at", commands)


# A login is a user's day; every error is answered with a logout, some with a token that was never given out.
LOGOUTS = """sess AS (SELECT event_id AS token, user_id * 1000 + dayofyear(ts) AS session, revoked_at FROM toks JOIN events USING (event_id, user_id)),
  logouts AS (SELECT event_id AS seq, CASE WHEN event_id % 7 = 0 THEN -1 - event_id ELSE event_id END AS token, ts AS moment FROM events WHERE event_type = 'error'),
  firsts AS (SELECT session, min(seq) AS seq, arg_min(moment, seq) AS moment FROM logouts JOIN sess USING (token) GROUP BY session),
  live AS (SELECT session, count(*) AS n FROM sess WHERE revoked_at IS NULL GROUP BY session)"""


def logged_out(spark, d):
    events = table(spark, d, "events").select("event_id", "user_id", "ts", "event_type")
    shown = F.when(F.col("event_id") % 7 == 0, -1 - F.col("event_id")).otherwise(F.col("event_id"))
    logouts = events.filter("event_type = 'error'").select(F.col("event_id").alias("seq"), shown.alias("token"), F.col("ts").alias("at"))
    session = (F.col("user_id") * 1000 + F.dayofyear("ts")).alias("session")
    sess = events.select(
        F.col("event_id").alias("token"), session, F.when(F.col("event_id") % 3 == 0, F.col("ts") + F.expr("INTERVAL 1 DAY")).alias("revoked_at")
    )
    return M.end_sessions(sess.withColumn("revoked_reason", F.when(F.col("revoked_at").isNotNull(), "rotated")), logouts)


@query(
    "A17_session_logout",
    with_views(TOKENS, LOGOUTS) + """SELECT s.token, coalesce(s.revoked_at, f.moment) AS revoked_at, CASE WHEN s.revoked_at IS NOT NULL THEN 'rotated' WHEN f.seq IS NOT NULL THEN 'logout' END AS revoked_reason
    FROM sess s LEFT JOIN firsts f USING (session)""",
)
def session_logout(spark, d):
    return logged_out(spark, d)["tokens"].select("token", "revoked_at", "revoked_reason")


@query(
    "A17_logout_outcome",
    with_views(TOKENS, LOGOUTS) + """SELECT l.seq, coalesce(n, 0)::BIGINT AS revoked, coalesce(n, 0) > 0 AS ended FROM logouts l LEFT JOIN firsts f ON f.seq = l.seq LEFT JOIN live USING (session)""",
)
def logout_outcome(spark, d):
    return logged_out(spark, d)["outcomes"].select("seq", "revoked", "ended")


# -- sequences ----------------------------------------------------------------------------------- #
LIMITER = """hits AS (SELECT {key} AS key, event_id, epoch_us(ts) / 1e6 AS t, row_number() OVER (PARTITION BY {key} ORDER BY ts, event_id) AS n, {reset} AS reset FROM events),
  walk AS (SELECT key, 0::BIGINT AS n, 0::BIGINT AS cnt, NULL::DOUBLE AS start, NULL::BIGINT AS event_id, NULL::DOUBLE AS t FROM (SELECT DISTINCT key FROM hits)
    UNION ALL SELECT w.key, h.n, CASE WHEN h.reset THEN 0 WHEN w.start IS NULL OR w.cnt = 0 OR h.t - w.start >= {win} THEN 1 ELSE w.cnt + 1 END,
      CASE WHEN h.reset THEN NULL WHEN w.start IS NULL OR w.cnt = 0 OR h.t - w.start >= {win} THEN h.t ELSE w.start END, h.event_id, h.t
    FROM walk w JOIN hits h ON h.key = w.key AND h.n = w.n + 1)"""


@query(
    "ST1_rate_limit",
    "WITH RECURSIVE " + LIMITER.format(key="user_id", reset="false", win="86400") + """ SELECT key AS user_id, event_id, cnt <= 3 AS allowed, greatest(0, 3 - cnt) AS remaining, CAST(greatest(1, trunc(86400 - (t - start))) AS BIGINT) AS retry_after FROM walk WHERE n > 0""",
)
def rate_limit(spark, d):
    ev = table(spark, d, "events")
    t = F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6)
    return E.rate_limit(ev, "user_id", t, "event_id", 3, 86400)


# A login attempt per event: the user is the account, one of seven addresses its origin.
@query(
    "ST2_login_policy",
    "WITH RECURSIVE a AS (SELECT event_id, epoch_us(ts) / 1e6 AS t, user_id, concat('10.0.0.', user_id % 7) AS ip, event_type = 'purchase' AS ok FROM events), "
    + """e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS n FROM a), i AS (SELECT *, row_number() OVER (PARTITION BY ip ORDER BY t, event_id) AS n FROM a),
    we AS (SELECT user_id, 0::BIGINT AS n, 0::BIGINT AS cnt, 0e0 AS start, NULL::BIGINT AS event_id, false AS ok FROM (SELECT DISTINCT user_id FROM a) UNION ALL
      SELECT w.user_id, e.n, CASE WHEN w.ok OR w.cnt = 0 OR e.t - w.start >= 300 THEN 1 ELSE w.cnt + 1 END, CASE WHEN w.ok OR w.cnt = 0 OR e.t - w.start >= 300 THEN e.t ELSE w.start END, e.event_id, e.ok FROM we w JOIN e ON e.user_id = w.user_id AND e.n = w.n + 1),
    wi AS (SELECT ip, 0::BIGINT AS n, 0::BIGINT AS cnt, 0e0 AS start, NULL::BIGINT AS event_id FROM (SELECT DISTINCT ip FROM a) UNION ALL
      SELECT w.ip, i.n, CASE WHEN w.cnt = 0 OR i.t - w.start >= 300 THEN 1 ELSE w.cnt + 1 END, CASE WHEN w.cnt = 0 OR i.t - w.start >= 300 THEN i.t ELSE w.start END, i.event_id FROM wi w JOIN i ON i.ip = w.ip AND i.n = w.n + 1)
    SELECT we.event_id, we.cnt <= 5 AS email_allowed, greatest(0, 5 - we.cnt) AS email_remaining, wi.cnt <= 20 AS ip_allowed, greatest(0, 20 - wi.cnt) AS ip_remaining FROM we JOIN wi ON wi.event_id = we.event_id""",
)
def login_policy(spark, d):
    ev = table(spark, d, "events").withColumn("ip", F.concat(F.lit("10.0.0."), (F.col("user_id") % 7).cast("string")))
    t = F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6)
    out = E.login_verdicts(ev, "user_id", "ip", t, "event_id", F.col("event_type") == "purchase")
    return out.select("event_id", "email_allowed", "email_remaining", "ip_allowed", "ip_remaining")


# Seat events of a licence (a user): the device is one of five, errors revoke now and then.
SEAT_EVENTS = """se AS (SELECT event_id, user_id AS licence, event_id % 5 AS device, CASE WHEN event_type = 'error' AND event_id % 20 = 0 THEN 'revoke' WHEN event_type IN ('purchase', 'error') THEN 'deactivate' ELSE 'activate' END AS action FROM events)"""


def seat_events(spark, d):
    e = F.col("event_type")
    action = F.when((e == "error") & (F.col("event_id") % 20 == 0), "revoke").when(e.isin("purchase", "error"), "deactivate").otherwise("activate")
    return table(spark, d, "events").select("event_id", F.col("user_id").alias("licence"), (F.col("event_id") % 5).alias("device"), action.alias("action"))


SEAT_WALK = SEAT_EVENTS + """, o AS (SELECT *, row_number() OVER (PARTITION BY licence ORDER BY event_id) AS n FROM se),
  w AS (SELECT licence, 0::BIGINT AS n, []::BIGINT[] AS act, false AS dead, NULL::BIGINT AS event_id, NULL::VARCHAR AS verdict FROM (SELECT DISTINCT licence FROM se) UNION ALL
    SELECT w.licence, o.n, CASE WHEN o.action = 'revoke' THEN [] WHEN o.action = 'deactivate' THEN list_filter(w.act, lambda x: x <> o.device) WHEN w.dead OR list_contains(w.act, o.device) OR len(w.act) >= 2 THEN w.act ELSE list_append(w.act, o.device) END,
      w.dead OR o.action = 'revoke', o.event_id,
      CASE WHEN o.action = 'revoke' THEN CASE WHEN w.dead THEN 'already_revoked' ELSE 'revoked' END WHEN o.action = 'deactivate' THEN CASE WHEN list_contains(w.act, o.device) THEN 'released' ELSE 'ignored' END
        WHEN w.dead THEN 'refused' WHEN list_contains(w.act, o.device) THEN 'reused' WHEN len(w.act) >= 2 THEN 'limit' ELSE 'activated' END
    FROM w JOIN o ON o.licence = w.licence AND o.n = w.n + 1)"""


@query("ST3_seat_history", "WITH RECURSIVE " + SEAT_WALK + " SELECT event_id, verdict, len(act) AS active_seats FROM w WHERE n > 0")
def seat_history(spark, d):
    return E.seat_history(seat_events(spark, d), "licence", "device", "action", "event_id", F.lit(2)).select("event_id", "verdict", "active_seats")


# A session (user) presents numbered tokens; a repeat of a spent one burns the session.
PRESENTED = """pr AS (SELECT event_id, user_id, event_id // 3 AS token, ts, TIMESTAMP '2024-01-01' + INTERVAL 1 DAY * (5 + user_id % 30) AS expires, user_id % 11 > 0 OR event_id % 2 = 0 AS available FROM events),
  bur AS (SELECT *, min(event_id) OVER (PARTITION BY user_id, token) AS first_id, row_number() OVER (PARTITION BY user_id, token ORDER BY event_id) AS k, first_value(ts) OVER (PARTITION BY user_id, token ORDER BY event_id) < expires AS fresh,
    first_value(available) OVER (PARTITION BY user_id, token ORDER BY event_id) AS first_ok FROM pr),
  b AS (SELECT user_id, min(event_id) AS burn FROM bur WHERE fresh AND (k >= 2 AND first_ok OR k = 1 AND NOT first_ok) GROUP BY user_id)"""


def presented(spark, d):
    # Few users meet a token twice by chance, so three consecutive events share one.
    return table(spark, d, "events").select("event_id", "user_id", "ts", *presented_columns())


def presented_columns():
    start = F.lit("2024-01-01").cast("timestamp_ntz")
    return (
        F.floor(F.col("event_id") / 3).alias("token"), (start + F.make_dt_interval((5 + F.col("user_id") % 30).cast("int"))).alias("expires"),
        ((F.col("user_id") % 11 > 0) | (F.col("event_id") % 2 == 0)).alias("available"),
    )


@query(
    "ST4_token_reuse",
    with_views(PRESENTED) + """SELECT event_id, CASE WHEN fresh AND first_ok AND (burn IS NULL OR first_id < burn) AND event_id > first_id THEN 'reused' WHEN event_id > burn THEN 'revoked' WHEN ts >= expires THEN 'expired' WHEN NOT available THEN 'user_unavailable' ELSE 'ok' END AS outcome
    FROM bur LEFT JOIN b ON b.user_id = bur.user_id""",
)
def token_reuse(spark, d):
    return E.token_history(presented(spark, d), "user_id", "token", "event_id", "ts", "expires", "available").select("event_id", "outcome")


FLUSH = """WITH RECURSIVE c AS (SELECT event_id, user_id, event_id % 6 AS n, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events),
  w AS (SELECT user_id, 0::BIGINT AS r, 0::BIGINT AS pending, NULL::BIGINT AS event_id, 0::BIGINT AS flushed FROM (SELECT DISTINCT user_id FROM events) UNION ALL
    SELECT w.user_id, c.r, CASE WHEN w.pending + c.n >= 25 THEN 0 ELSE w.pending + c.n END, c.event_id, CASE WHEN w.pending + c.n >= 25 THEN w.pending + c.n ELSE 0 END FROM w JOIN c ON c.user_id = w.user_id AND c.r = w.r + 1)
  SELECT user_id, event_id, flushed, pending FROM w WHERE r > 0"""


@query("ST5_counter_flush", FLUSH)
def counter_flush(spark, d):
    ev = table(spark, d, "events").withColumn("n", F.col("event_id") % 6)
    return E.counter_flushes(ev, "user_id", "event_id", "n")


# -- keyed updates ---------------------------------------------------------------------------------- #
ASSETS = """assets AS (SELECT lpad(CAST(d.doc_id AS VARCHAR), 9, '0') AS path, lpad(CAST(d.doc_id AS VARCHAR), 9, '0') AS linked_path, CASE WHEN toxic = 1 OR quality = 0 THEN 'needed' ELSE 'none' END AS retouch_status FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)"""


def path_of(c):
    return F.lpad(F.col(c).cast("string"), 9, "0")


def assets(spark, d):
    flagged = table(spark, d, "labels").filter("toxic = 1 OR quality = 0").select(path_of("doc_id").alias("path"))
    return M.asset_list(table(spark, d, "documents").select(path_of("doc_id").alias("path")), flagged)


@query("M1_asset_list", with_views(ASSETS) + "SELECT * FROM assets")
def asset_list(spark, d):
    return assets(spark, d)


RETOUCH = """cmds AS (SELECT event_id AS seq, lpad(CAST(event_id % 1200 AS VARCHAR), 9, '0') AS path, CASE event_id % 4 WHEN 0 THEN 'done' WHEN 1 THEN 'needed' WHEN 2 THEN 'none' ELSE 'shiny' END AS status FROM events)"""


def retouch_commands(spark, d):
    states = F.lit(["done", "needed", "none", "shiny"])
    return table(spark, d, "events").select(
        F.col("event_id").alias("seq"), F.lpad((F.col("event_id") % 1200).cast("string"), 9, "0").alias("path"),
        F.get(states, (F.col("event_id") % 4).cast("int")).alias("status"),
    )


@query(
    "M2_set_retouch",
    with_views(ASSETS, RETOUCH) + """, best AS (SELECT path, arg_max(status, seq) AS status FROM cmds WHERE status <> 'shiny' GROUP BY path)
    SELECT a.path, coalesce(b.status, a.retouch_status) AS status, CAST(NULL AS VARCHAR) AS reason FROM assets a LEFT JOIN best b ON b.path = a.path
    UNION ALL SELECT c.path, c.status, CASE WHEN c.status = 'shiny' THEN 'unknown_status' ELSE 'unknown_path' END FROM cmds c LEFT JOIN assets a ON a.path = c.path WHERE c.status = 'shiny' OR a.path IS NULL""",
)
def set_retouch(spark, d):
    done, bad = M.set_retouch(assets(spark, d), retouch_commands(spark, d), "seq")
    return done.select("path", F.col("retouch_status").alias("status"), F.lit(None).cast("string").alias("reason")).unionByName(bad.select("path", "status", "reason"))


@query(
    "M3_relink",
    with_views(ASSETS, RETOUCH) + """SELECT a.path, coalesce(b.link, a.linked_path) AS linked_path FROM assets a LEFT JOIN (SELECT path, concat('retouched/', max(seq)) AS link FROM cmds GROUP BY path) b ON b.path = a.path""",
)
def relink(spark, d):
    links = retouch_commands(spark, d).withColumn("new_link", F.concat(F.lit("retouched/"), F.col("seq").cast("string")))
    return M.relink(assets(spark, d), links, "seq")[0].select("path", "linked_path")


@query("M4_pending_retouch", with_views(ASSETS) + "SELECT path FROM assets WHERE retouch_status = 'needed'")
def pending(spark, d):
    return M.pending_retouch(assets(spark, d)).select("path")


@query(
    "M5_flat_placements",
    """WITH p AS (SELECT o_orderkey AS spread, unnest([0, 1, 2]) AS i, o_custkey FROM orders), z AS (SELECT *, (spread + i * 2) % 3 AS z_index FROM p)
    SELECT spread, CAST(row_number() OVER (PARTITION BY spread ORDER BY z_index, i) - 1 AS INTEGER) AS layer, concat(spread, '/', i) AS path, CAST(i * 100 AS BIGINT) AS frame_x, o_custkey AS frame_w, i / 10e0 AS crop_x, z_index FROM z""",
)
def placements(spark, d):
    one = lambda i: F.struct(
        F.concat(F.col("o_orderkey").cast("string"), F.lit("/"), i.cast("string")).alias("path"),
        F.array(i * 100, F.lit(0), F.col("o_custkey"), F.lit(50)).cast("array<long>").alias("frame_px"),
        F.array(i / 10.0, F.lit(0.0), F.lit(1.0), F.lit(1.0)).alias("crop"), ((F.col("o_orderkey") + i * 2) % 3).cast("int").alias("z_index"),
    )
    sp = table(spark, d, "orders").select(F.col("o_orderkey").alias("spread"), F.transform(F.lit([0, 1, 2]), one).alias("placements"))
    flat = M.flat_placements(sp, "placements", ["spread"])
    return flat.select("spread", "layer", "path", "frame_x", "frame_w", "crop_x", "z_index")


@query(
    "M6_label_cluster",
    """WITH cl AS (SELECT DISTINCT label AS cluster, CASE WHEN label % 2 = 0 THEN 'friend' END AS label FROM embeddings), cmd AS (SELECT event_id AS seq, CAST(event_id % 12 AS INTEGER) AS cluster, CASE WHEN event_type = 'error' THEN NULL ELSE event_type END AS label, 'bride' AS side FROM events),
    last AS (SELECT cluster, arg_max(struct_pack(l := label), seq) AS s FROM cmd GROUP BY cluster)
    SELECT cl.cluster, CASE WHEN l.cluster IS NOT NULL THEN l.s.l ELSE cl.label END AS label, CASE WHEN l.s.l IS NOT NULL THEN 'bride' END AS side, (SELECT count(*) FROM cmd WHERE cluster NOT IN (SELECT cluster FROM cl)) AS rejected FROM cl LEFT JOIN last l ON l.cluster = cl.cluster""",
)
def label_cluster(spark, d):
    cl = table(spark, d, "embeddings").select(F.col("label").alias("cluster")).distinct().select(
        "cluster", F.when(F.col("cluster") % 2 == 0, "friend").alias("label"), F.lit(None).cast("string").alias("side")
    )
    cmd = table(spark, d, "events").select(
        F.col("event_id").alias("seq"), (F.col("event_id") % 12).cast("int").alias("cluster"),
        F.when(F.col("event_type") != "error", F.col("event_type")).alias("label"), F.lit("bride").alias("side"),
    )
    out, bad = M.label_clusters(cl, cmd, ["cluster"], "seq")
    return out.withColumn("rejected", bad.agg(F.count(F.lit(1)).alias("n")).scalar())


COMMANDS = """cmds AS (SELECT event_id AS seq, CASE event_type WHEN 'click' THEN 'suspend' WHEN 'view' THEN 'revoke' WHEN 'purchase' THEN 'disable' WHEN 'signup' THEN 'publish' ELSE CASE WHEN event_id % 2 = 0 THEN 'enable' ELSE 'yank' END END AS command,
  event_id % 1500 AS target_id, ts AS happened, user_id AS actor FROM events),
  ok AS (SELECT *, CASE command WHEN 'suspend' THEN 'license' WHEN 'revoke' THEN 'license' WHEN 'disable' THEN 'user' WHEN 'enable' THEN 'user' ELSE 'release' END AS target_type,
    CASE command WHEN 'suspend' THEN 'SUSPENDED' WHEN 'revoke' THEN 'REVOKED' WHEN 'disable' THEN 'DISABLED' WHEN 'enable' THEN 'ACTIVE' WHEN 'publish' THEN 'PUBLISHED' ELSE 'YANKED' END AS to_status FROM cmds WHERE NOT (command = 'disable' AND target_id = actor)),
  hit AS (SELECT * FROM ok WHERE (target_type = 'license' AND target_id IN (SELECT o_orderkey FROM orders)) OR (target_type = 'user' AND target_id IN (SELECT c_custkey FROM customer)) OR (target_type = 'release' AND target_id IN (SELECT o_orderkey FROM orders))),
  finals AS (SELECT target_type, target_id, arg_max(to_status, seq) AS to_status FROM hit GROUP BY target_type, target_id)"""


def commands(spark, d):
    e, k = F.col("event_type"), F.col("event_id")
    name = F.when(e == "click", "suspend").when(e == "view", "revoke").when(e == "purchase", "disable").when(e == "signup", "publish").otherwise(
        F.when(k % 2 == 0, "enable").otherwise("yank")
    )
    return table(spark, d, "events").select(k.alias("seq"), name.alias("command"), (k % 1500).alias("target_id"), F.col("ts").alias("at"), F.col("user_id").alias("actor"))


def applied(spark, d):
    sessions = tokens(spark, d).select(F.col("event_id").alias("session"), F.col("user_id").alias("user"), "revoked_at")
    return M.apply_commands(commands(spark, d), V.licences(spark, d), V.activations(spark, d), users(spark, d), sessions, releases(spark, d))


M7 = with_views(V.LICENCES, V.ACTIVATIONS, USERS, RELEASES, TOKENS, COMMANDS)


@query(
    "M7_licence_status",
    M7 + """, rev AS (SELECT target_id, arg_max(happened, seq) AS revoked_at FROM hit WHERE command = 'revoke' GROUP BY target_id)
    SELECT licence, coalesce(to_status, status) AS status, revoked_at FROM licences LEFT JOIN finals f ON f.target_type = 'license' AND f.target_id = licence LEFT JOIN rev ON rev.target_id = licence""",
)
def licence_status(spark, d):
    return applied(spark, d)["licences"].select("licence", "status", "revoked_at")


DEVICES = "devs AS (SELECT s_suppkey AS device, 'ACTIVE' AS status, NULL::TIMESTAMP AS deactivated_at FROM supplier)"
CLOSE = "cl AS (SELECT event_id AS seq, event_id % 1500 AS licence, user_id % 10 AS device, ts AS happened, user_id AS actor FROM events)"
CLOSED = with_views(V.ACTIVATIONS, DEVICES, CLOSE) + """, firsts AS (SELECT licence, device, min(seq) AS seq, arg_min(happened, seq) AS happened, arg_min(actor, seq) AS actor FROM cl GROUP BY licence, device),
  done AS (SELECT * FROM firsts WHERE (licence, device) IN (SELECT licence, device FROM activations WHERE status = 'ACTIVE'))"""


def device_commands(spark, d):
    cmds = table(spark, d, "events").select(
        F.col("event_id").alias("seq"), (F.col("event_id") % 1500).alias("licence"), (F.col("user_id") % 10).alias("device"), F.col("ts").alias("at"), F.col("user_id").alias("actor")
    )
    devices = table(spark, d, "supplier").select(
        F.col("s_suppkey").alias("device"), F.lit("ACTIVE").alias("status"), F.lit(None).cast("timestamp_ntz").alias("deactivated_at")
    )
    return M.deactivate_devices(cmds, V.activations(spark, d), devices)


@query("M7_closed_devices", CLOSED + " SELECT v.device, CASE WHEN x.happened IS NULL THEN status ELSE 'DEACTIVATED' END AS status, x.happened AS deactivated_at FROM devs v LEFT JOIN (SELECT device, arg_max(happened, seq) AS happened FROM done GROUP BY device) x ON x.device = v.device")
def closed_devices(spark, d):
    return device_commands(spark, d)["devices"]


@query(
    "M7_closed_device_seats",
    CLOSED + """ SELECT a.licence, a.device, part, CASE WHEN a.status = 'ACTIVE' AND x.seq IS NOT NULL THEN 'DEACTIVATED' ELSE a.status END AS status,
    CASE WHEN a.status = 'ACTIVE' AND x.seq IS NOT NULL THEN x.happened ELSE deactivated_at END AS deactivated_at FROM activations a LEFT JOIN done x ON x.licence = a.licence AND x.device = a.device""",
)
def closed_device_seats(spark, d):
    return device_commands(spark, d)["activations"].select("licence", "device", "part", "status", "deactivated_at")


@query("M7_device_audit", CLOSED + """ SELECT seq, actor, concat('{"license_id":"', licence, '","device_id":"', device, '"}') AS metadata FROM done""")
def device_audit(spark, d):
    return device_commands(spark, d)["audit"].select("seq", "actor", "metadata")


@query(
    "M7_closed_seats",
    M7 + """, shut AS (SELECT target_id, min(happened) AS happened FROM hit WHERE command = 'revoke' GROUP BY target_id)
    SELECT licence, device, part, CASE WHEN status = 'ACTIVE' AND s.happened IS NOT NULL THEN 'DEACTIVATED' ELSE status END AS status, CASE WHEN status = 'ACTIVE' AND s.happened IS NOT NULL THEN s.happened ELSE deactivated_at END AS deactivated_at FROM activations LEFT JOIN shut s ON s.target_id = licence""",
)
def closed_seats(spark, d):
    return applied(spark, d)["activations"].select("licence", "device", "part", "status", "deactivated_at")


@query("M7_user_status", M7 + "SELECT user, coalesce(to_status, status) AS status FROM users LEFT JOIN finals ON target_type = 'user' AND target_id = user")
def user_status(spark, d):
    return applied(spark, d)["users"].select("user", "status")


@query(
    "M7_revoked_sessions",
    M7 + ", off AS (SELECT target_id, min(happened) AS happened FROM hit WHERE command = 'disable' GROUP BY target_id) SELECT event_id AS session, coalesce(revoked_at, happened) AS revoked_at FROM toks LEFT JOIN off ON target_id = user_id",
)
def revoked_sessions(spark, d):
    return applied(spark, d)["sessions"].select("session", "revoked_at")


@query(
    "M7_release_status",
    M7 + ", pub AS (SELECT target_id, arg_max(happened, seq) AS happened FROM hit WHERE command = 'publish' GROUP BY target_id) SELECT release, coalesce(to_status, status) AS status, coalesce(happened, published_at) AS published_at FROM releases LEFT JOIN finals f ON f.target_type = 'release' AND f.target_id = release LEFT JOIN pub ON pub.target_id = release",
)
def release_status(spark, d):
    return applied(spark, d)["releases"].select("release", "status", "published_at")


@query(
    "M7_audit_rows",
    M7 + """SELECT seq, actor, CASE command WHEN 'suspend' THEN 'LICENSE_SUSPENDED' WHEN 'revoke' THEN 'LICENSE_REVOKED' WHEN 'disable' THEN 'USER_DISABLED' WHEN 'enable' THEN 'USER_ENABLED' WHEN 'publish' THEN 'RELEASE_PUBLISHED' ELSE 'RELEASE_YANKED' END AS action, target_type, target_id,
    CASE WHEN command = 'disable' THEN concat('{"sessions_revoked":', CASE WHEN seq = o.one THEN coalesce(l.n, 0) ELSE 0 END, '}') WHEN target_type = 'release' THEN concat('{"version":"', r.release, '","channel":"', r.channel, '"}') END AS metadata
    FROM hit LEFT JOIN (SELECT target_id AS user, arg_min(seq, (happened, seq)) AS one FROM hit WHERE command = 'disable' GROUP BY 1) o ON o.user = target_id AND target_type = 'user'
    LEFT JOIN (SELECT user_id, count(*) AS n FROM toks WHERE revoked_at IS NULL GROUP BY 1) l ON l.user_id = target_id LEFT JOIN releases r ON r.release = target_id AND target_type = 'release'""",
)
def audit_rows(spark, d):
    return applied(spark, d)["audit"].select("seq", "actor", "action", "target_type", "target_id", "metadata")


CHANGES = "ch AS (SELECT event_id AS release, CASE WHEN event_id % 2 = 0 THEN event_type END AS channel, CASE WHEN event_id % 3 = 0 THEN props END AS notes FROM events)"


def changes(spark, d):
    k = F.col("event_id")
    return table(spark, d, "events").select(k.alias("release"), F.when(k % 2 == 0, F.col("event_type")).alias("channel"), F.when(k % 3 == 0, F.col("props")).alias("notes"))


@query("M8_partial_update", with_views(RELEASES, CHANGES) + "SELECT r.release, coalesce(c.channel, r.channel) AS channel, coalesce(c.notes, r.notes) AS notes FROM releases r LEFT JOIN ch c ON c.release = r.release")
def partial_update(spark, d):
    return M.partial_update(releases(spark, d), changes(spark, d), "release", ["notes", "channel"])[0].select("release", "channel", "notes")


@query(
    "M8_update_audit",
    with_views(RELEASES, CHANGES) + "SELECT release, concat_ws(',', CASE WHEN channel IS NOT NULL THEN 'channel' END, CASE WHEN notes IS NOT NULL THEN 'notes' END) AS fields FROM ch WHERE release IN (SELECT release FROM releases) AND (channel IS NOT NULL OR notes IS NOT NULL)",
)
def update_audit(spark, d):
    audit = M.partial_update(releases(spark, d), changes(spark, d), "release", ["notes", "channel"])[1]
    return audit.select("release", F.array_join("fields", ",").alias("fields"))


OVERRIDES = """prior AS (SELECT doc_id AS path, CASE quality WHEN 1 THEN 'BestShots' ELSE 'Blurry' END AS category FROM labels WHERE doc_id % 2 = 0),
  fresh AS (SELECT doc_id AS path, CASE toxic WHEN 1 THEN 'Duplicates' ELSE 'Review' END AS category FROM labels WHERE doc_id % 3 = 0),
  merged AS (SELECT coalesce(f.path, p.path) AS path, coalesce(f.category, p.category) AS category FROM prior p FULL JOIN fresh f ON f.path = p.path)"""


def overrides(spark, d):
    lab = table(spark, d, "labels")
    prior = lab.filter("doc_id % 2 = 0").select(F.col("doc_id").alias("path"), F.when(F.col("quality") == 1, "BestShots").otherwise("Blurry").alias("category"))
    fresh = lab.filter("doc_id % 3 = 0").select(F.col("doc_id").alias("path"), F.when(F.col("toxic") == 1, "Duplicates").otherwise("Review").alias("category"))
    return M.merge_overrides(prior, fresh)


@query("J7_merge_overrides", with_views(OVERRIDES) + "SELECT path, category FROM merged")
def merge_overrides(spark, d):
    return overrides(spark, d)


@query(
    "J6_apply_overrides",
    with_views(OVERRIDES) + """SELECT doc_id AS path, coalesce(m.category, 'Review') AS category, CASE WHEN m.path IS NULL THEN n_chars > 3000 ELSE m.category = 'BestShots' END AS is_best_shot,
    CASE WHEN m.path IS NULL THEN n_chars < 100 ELSE m.category = 'Duplicates' END AS is_duplicate FROM documents LEFT JOIN merged m ON m.path = doc_id""",
)
def apply_overrides(spark, d):
    recs = table(spark, d, "documents").select(
        F.col("doc_id").alias("path"), F.lit("Review").alias("category"), (F.col("n_chars") > 3000).alias("is_best_shot"), (F.col("n_chars") < 100).alias("is_duplicate")
    )
    return M.apply_overrides(recs, overrides(spark, d))


@query(
    "J8_face_sources",
    with_views(V.MEDIA, V.BOXED, V.BOXROWS, V.CLIPPED) + """, counts AS (SELECT path, count(*) AS n, sum(x) AS sx FROM boxrows GROUP BY path),
    lm AS (SELECT path, x, i, x + 0.01e0 AS lx, y AS ly, x + 0.05e0 AS rx FROM boxrows WHERE l_linenumber % 2 = 0),
    pick AS (SELECT path, CASE WHEN i % 2 = 1 AND least(1e0, (lx + rx) / 2e0 + (rx - lx) * 1.1e0) > greatest(0e0, (lx + rx) / 2e0 - (rx - lx) * 1.1e0) AND least(1e0, ly + (rx - lx) * 2.6e0) > greatest(0e0, ly - (rx - lx) * 1.5e0)
       THEN greatest(0e0, (lx + rx) / 2e0 - (rx - lx) * 1.1e0) ELSE x END AS fx FROM lm),
    brain AS (SELECT path, count(*) AS n, sum(fx) AS sx FROM pick GROUP BY path), cached AS (SELECT path, count(*) AS n, sum(x) AS sx FROM clipped WHERE l_linenumber % 3 > 0 GROUP BY path)
    SELECT m.path, coalesce(b.n, c.n) AS faces, round(coalesce(b.sx, c.sx), 6) AS x_sum FROM media m LEFT JOIN brain b ON b.path = m.path LEFT JOIN cached c ON c.path = m.path WHERE coalesce(b.n, c.n) > 0""",
)
def face_sources(spark, d):
    df = V.boxed(spark, d)

    def eyes(b, i):
        head = box_from_eyes(b["x"] + 0.01, b["y"], b["x"] + 0.05, b["y"])
        return F.when(i % 2 == 0, head)

    brains = df.filter("l_linenumber % 2 = 0").select("path", "boxes", F.transform("boxes", eyes).alias("landmark_boxes"))
    cached = df.filter("l_linenumber % 3 > 0").select("path", clip_boxes("boxes").alias("regions"))
    out = M.face_boxes(df.select("path"), brains, cached)
    return out.select("path", F.size("faces").cast("long").alias("faces"), F.round(F.aggregate("faces", F.lit(0.0), lambda s, b: s + b["x"]), 6).alias("x_sum"))


