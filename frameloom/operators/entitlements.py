"""Licences, seats, sessions, releases, ledgers and usage over relational tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frameloom.functions.licence import licence_reject_reason
from frameloom.operators.ordered import OrderedGroups, first_row, hot_groups, top_n
from frameloom.operators.slots import fold_slots

# The closed vocabulary of usage events.
USAGE_EVENTS = (
    "app_launched", "mode_album", "mode_passport", "mode_collage", "album_built", "album_exported",
    "passport_sheet_exported", "passport_beautify_used", "collage_built", "collage_exported",
    "collage_auto_build_used", "collage_shape_used", "preset_saved", "crash",
)
FLUSH_AT = 25
# Numbers over which rows that match nothing are dealt.
DEALS = 8_192


# -- listings ------------------------------------------------------------------- #
def active_seats(activations: DataFrame, licence: str) -> DataFrame:
    """Active activations per licence, counted once for all licences."""
    return activations.filter(F.col("status") == "ACTIVE").groupBy(licence).agg(F.count(F.lit(1)).alias("active_devices"))


def licences_with_seats(licences: DataFrame, activations: DataFrame, licence: str) -> DataFrame:
    return licences.join(active_seats(activations, licence), licence, "left").withColumn(
        "active_devices", F.coalesce("active_devices", F.lit(0)).cast("long")
    )


def licence_devices(activations: DataFrame, devices: DataFrame, device: str) -> DataFrame:
    return activations.join(devices, device)


def overview(users: DataFrame, licences: DataFrame) -> DataFrame:
    """One row: users, active users, licences, active licences, active devices."""
    left = users.agg(
        F.count(F.lit(1)).alias("users"), F.count_if(F.col("status") == "ACTIVE").alias("active_users")
    )
    right = licences.agg(
        F.count(F.lit(1)).alias("licences"),
        F.count_if(F.col("status") == "ACTIVE").alias("active_licences"),
        F.coalesce(F.sum("active_devices"), F.lit(0)).cast("long").alias("active_devices"),
    )
    return left.withColumn("__one", F.lit(1)).join(right.withColumn("__one", F.lit(1)), "__one").drop("__one")


def total_and_page(df: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """One page with the total under the same filter on every row."""
    total = df.agg(F.count(F.lit(1)).alias("n"))
    return df.orderBy(*order).offset(offset).limit(limit).withColumn("total", total.scalar())


def unique_inserts(existing: DataFrame, incoming: DataFrame, keys: Sequence[str], order: str) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) rows: a key that exists, or came earlier in the batch, is rejected."""
    keys = list(keys)
    first = incoming.groupBy(*keys).agg(F.min(order).alias("__first"))
    known = existing.select(*keys).distinct().withColumn("__known", F.lit(True))
    judged = incoming.join(first, keys, "left").join(known, keys, "left").withColumn(
        "__ok", F.col("__known").isNull() & (F.col(order) == F.col("__first"))
    )
    return (
        judged.filter("__ok").select(*incoming.columns),
        judged.filter("NOT __ok").select(*incoming.columns),
    )


# -- licence checks --------------------------------------------------------------- #
def _dealt_left_join(left: DataFrame, right: DataFrame, keys: list[str], lost: Column) -> DataFrame:
    """Left join in which the rows that ``lost`` marks match nothing and spread over all partitions by ``__row``.

    Both sides also join on a hash of the keys; lost rows bring their own. A constant there would be folded away and
    the rows would meet under null again.
    """
    types = {k: right.schema[k].dataType.simpleString() for k in keys}
    own = _deal(*[F.col(k).try_cast(types[k]) for k in keys])
    left = left.withColumn("__deal", F.when(F.coalesce(lost, F.lit(False)), F.col("__row")).otherwise(own))
    return left.join(right.withColumn("__deal", _deal(*keys)), [*keys, "__deal"], "left").drop("__deal")


def _deal(*columns: Column | str) -> Column:
    """A small number from a hash, which spreads rows as well as the whole hash and packs better."""
    return F.pmod(F.xxhash64(*columns), F.lit(DEALS)).cast("int")


def _packed(key: str) -> Column:
    """A text key as bytes, lower-case hex at half its length; a first byte tells the two forms apart, so keys stay distinct."""
    text = F.col(key).cast("string")
    return F.when(text.rlike("^([0-9a-f]{2})+$"), F.concat(F.lit(b"\x01"), F.unhex(text))).otherwise(F.concat(F.lit(b"\x00"), text.cast("binary")))


def validate_seats(
    requests: DataFrame, licences: DataFrame, devices: DataFrame, activations: DataFrame, moment: Column,
) -> DataFrame:
    """Requests with ``verdict``: the first check that fails, or ok.

    requests (request, user, key_hash, fingerprint), licences (licence, owner, key_hash, status, starts,
    expires), devices (device, user, fingerprint, status), activations (licence, device, status).
    """
    lic = licences.select(
        _packed("key_hash").alias("__key"), "licence", "owner", F.col("status").alias("l_status"), "starts", "expires"
    )
    dev = devices.select("user", "fingerprint", "device", F.col("status").alias("d_status"))
    act = activations.filter(F.col("status") == "ACTIVE").select("licence", "device").distinct().withColumn("active", F.lit(True))
    # Rows that can match nothing any more (no key, no print, unknown licence) are dealt out instead of meeting under null.
    asked = requests.withColumn("fingerprint", F.trim(F.coalesce("fingerprint", F.lit("")))).withColumns(
        {"__row": _deal(*requests.columns), "__key": F.when(F.col("key_hash") != "", _packed("key_hash")), "__no_key": F.coalesce("key_hash", F.lit("")) == ""}
    )
    joined = _dealt_left_join(asked, lic, ["__key"], F.col("__no_key"))
    reason = licence_reject_reason(F.col("l_status"), F.col("starts"), F.col("expires"), moment)
    # A request is judged as soon as it can be; then it takes neither the licence nor its keys along.
    settled = (
        F.when(F.col("__no_key"), "no_key")
        .when(F.col("licence").isNull(), "unknown_key")
        .when(~F.col("owner").eqNullSafe(F.col("user")), "wrong_owner")
        .when(reason.isNotNull(), reason)
        .when(F.col("fingerprint") == "", "no_fingerprint")
    )
    joined = joined.withColumn("__settled", settled)
    is_open = F.col("__settled").isNull()
    joined = joined.select(
        *requests.columns, "__row", "__settled", F.when(is_open, F.col("licence")).alias("licence"),
        F.when(is_open, F.col("user")).alias("__user"), F.when(is_open, F.col("fingerprint")).alias("__print"),
    )
    dev = dev.withColumnsRenamed({"user": "__user", "fingerprint": "__print"})
    joined = _dealt_left_join(joined, dev, ["__user", "__print"], ~is_open)
    settled = F.when(F.col("device").isNull(), "unknown_device").when(F.col("d_status") == "REVOKED", "device_revoked")
    joined = joined.withColumn("__settled", F.coalesce("__settled", settled)).select(
        *requests.columns, "__row", "__settled", *(F.when(is_open, F.col(c)).alias(c) for c in ("licence", "device"))
    )
    joined = _dealt_left_join(joined, act, ["licence", "device"], ~is_open)
    verdict = F.coalesce("__settled", F.when(F.col("active").isNull(), "not_activated").otherwise("ok"))
    return joined.select(*requests.columns, verdict.alias("verdict"))


def admit_seats(requests: DataFrame, licence: str, device: str, order: Sequence[str], limit: Column) -> DataFrame:
    """Activation requests with ``verdict``: activated, reused or limit.

    Without deactivations the active devices are the first ``limit`` distinct ones, so the rank of
    a device's first request decides and no request has to wait for another. ``limit`` may differ
    per row of a licence; its value at the first request of the device counts.
    """
    at = F.struct(*order)
    # One smallest row carries order and limit; a licence has no more devices than requests, so those are counted.
    firsts = requests.groupBy(licence, device).agg(F.min(F.struct(at.alias("at"), limit.alias("limit"))).alias("__one"), F.count(F.lit(1)).alias("__n"))
    firsts = firsts.select(licence, device, F.col("__one.at").alias("__at"), F.col("__one.limit").alias("__limit"), "__n")
    hot = hot_groups(requests, [licence])
    seats = OrderedGroups(firsts, [licence], [F.col("__at"), F.col(device)], hot=hot).position("__seat").df
    # A request that is the only one of its device is the first, so only the others need its order.
    seats = seats.select(
        licence, device, (F.col("__seat") >= F.col("__limit")).alias("__over"), (F.col("__n") == 1).alias("__only"),
        F.when(F.col("__n") > 1, F.col("__at")).alias("__first"),
    )
    joined = requests.join(seats, [licence, device])
    verdict = (
        F.when(F.col("__over"), "limit")
        .when(F.col("__only") | (at == F.col("__first")), "activated")
        .otherwise("reused")
    )
    return joined.select(*requests.columns, verdict.alias("verdict"))


def previous_activation(activations: DataFrame, keys: Sequence[str], ended: str, tie: str) -> DataFrame:
    """The latest deactivated row per (licence, device): the one to reactivate."""
    gone = activations.filter(F.col("status") == "DEACTIVATED")
    return first_row(gone, list(keys), F.struct(ended, tie), largest=True)


def activate_seats(
    requests: DataFrame, activations: DataFrame, order: Sequence[str], limit: Column, new_id: Column,
) -> dict[str, DataFrame]:
    """Give seats to a batch of requests; the latest deactivated row of a device opens again before a new one is made.

    requests (seq, licence, device, at), ``seq`` unique; activations (activation, licence, device, status, activated_at,
    deactivated_at). Verdicts: reused (the device holds a seat, or got one earlier in the batch), reactivated, created,
    limit, and refused where licence or device is null. ``limit`` and ``new_id`` are columns of the device's first
    request. Seats held before count, one a row. Returns activations, verdicts and audit; the audit names no refusals.
    """
    keys = ["licence", "device"]
    asked = requests.filter(F.col("licence").isNotNull() & F.col("device").isNotNull())
    active = activations.filter(F.col("status") == "ACTIVE")
    holders = active.select(*keys).distinct().withColumn("__holds", F.lit(True))
    used = active.groupBy("licence").agg(F.count(F.lit(1)).alias("__used"))
    # What orders the requests is aggregated once and the rest beside it; ``limit`` and ``new_id`` are read off the first afterwards.
    placed = list(dict.fromkeys([*order, "seq"]))
    rest = [c for c in requests.columns if c not in {*keys, *placed}]
    at = F.struct(*placed)
    others = [F.min_by(F.struct(*rest), at).alias("__rest")] if rest else []
    first = asked.groupBy(*keys).agg(F.min(at).alias("__first"), F.count(F.lit(1)).alias("__n"), *others)
    ended = activations.filter((F.col("status") == "DEACTIVATED") & F.col("licence").isNotNull())
    before = ended.groupBy(*keys).agg(F.max(F.struct("deactivated_at", "activation"))["activation"].alias("__previous"))
    # All that is known of a device is joined before the rows move to their licences, and nothing of it after that.
    known = first.join(holders, keys, "left").join(before, keys, "left").join(used, "licence", "left")
    known = known.withColumn("__holds", F.coalesce("__holds", F.lit(False)))
    # A licence has no more devices than requests, so those are counted.
    seats = OrderedGroups(known, ["licence"], [F.col("__first"), F.col("device")], hot=hot_groups(asked, ["licence"]))
    seats = seats.running_sum((~F.col("__holds")).cast("int"), "__seat").df
    seats = seats.select(
        *keys, *(F.col("__first")[c].alias(c) for c in placed if c not in keys), *(F.col("__rest")[c].alias(c) for c in rest),
        "__n", "__holds", "__previous", "__used", "__seat",
    ).withColumns({"__limit": limit, "__id": new_id})
    given = (
        F.when(F.col("__holds"), "reused")
        .when(F.coalesce("__used", F.lit(0)) + F.col("__seat") > F.col("__limit"), "limit")
        .when(F.col("__previous").isNotNull(), "reactivated")
        .otherwise("created")
    )
    seats = seats.withColumn("__given", given)
    # A request that is the only one of its device is the first, so only the others need its name.
    judged = asked.join(seats.select(*keys, "__given", F.when(F.col("__n") > 1, F.col("seq")).alias("__seq")), keys)
    is_first = F.col("__seq").isNull() | (F.col("__seq") == F.col("seq"))
    verdict = F.when(is_first | (F.col("__given") == "limit"), F.col("__given")).otherwise("reused")
    verdicts = judged.select(*requests.columns, verdict.alias("verdict"))
    opened = seats.filter(F.col("__given") == "reactivated").select(F.col("__previous").alias("activation"), F.col("at").alias("__at"))
    hit = F.col("__at").isNotNull()
    # Only a deactivated row can open again: the others stay where they are.
    gone = F.coalesce(F.col("status") == "DEACTIVATED", F.lit(False))
    changed = activations.filter(gone).join(opened, "activation", "left").withColumns({
        "status": F.when(hit, "ACTIVE").otherwise(F.col("status")),
        "activated_at": F.when(hit, F.col("__at")).otherwise(F.col("activated_at")),
        "deactivated_at": F.when(~hit, F.col("deactivated_at")),
    }).select(*activations.columns).unionByName(activations.filter(~gone))
    made = seats.filter(F.col("__given") == "created").select(
        F.col("__id").alias("activation"), *keys, F.lit("ACTIVE").alias("status"), F.col("at").alias("activated_at")
    )
    action = F.when(F.col("verdict") == "reused", "LICENSE_ACTIVATION_REUSED").otherwise("LICENSE_ACTIVATED")
    audit = verdicts.filter(F.col("verdict") != "limit").select(
        "seq", action.alias("action"), F.lit("license").alias("target_type"), F.col("licence").cast("string").alias("target_id"), "at"
    )
    refused = requests.filter(F.col("licence").isNull() | F.col("device").isNull()).withColumn("verdict", F.lit("refused"))
    return {
        "activations": changed.unionByName(made, allowMissingColumns=True),
        "verdicts": verdicts.unionByName(refused), "audit": audit,
    }


def current_releases(releases: DataFrame, by: Sequence[str], published: str, tie: str) -> DataFrame:
    """The latest published release per group; drafts and yanked ones never count."""
    live = releases.filter((F.col("status") == "PUBLISHED") & F.col(published).isNotNull())
    return first_row(live, list(by), F.struct(published, tie), largest=True)


# -- ledgers ------------------------------------------------------------------------ #
def first_per_reference(ledger: DataFrame, user: str, reference: str, order: Sequence[str]) -> DataFrame:
    """Keep the first row per (user, reference); rows without a reference all stay."""
    named = ledger.filter(F.col(reference).isNotNull())
    once = first_row(named, [user, reference], F.struct(*order)).select(*ledger.columns)
    return once.unionByName(ledger.filter(F.col(reference).isNull()))


def running_balance(ledger: DataFrame, user: str, amount: str, order: Sequence[str], hot_rows: int | None = None) -> DataFrame:
    walk = OrderedGroups(ledger, [user], [F.col(c) for c in order], hot_rows)
    return walk.running_sum(F.col(amount), "balance_after").df


def balances(ledger: DataFrame, user: str, amount: str) -> DataFrame:
    return ledger.groupBy(user).agg(F.sum(amount).alias("balance"))


def reservation_totals(reservations: DataFrame, user: str, moment: Column) -> DataFrame:
    """Open holds per user and those that have run out at ``moment``."""
    is_open = F.col("status") == "OPEN"
    over = is_open & (F.col("expires_at") <= moment)

    def summed(test: Column) -> Column:
        return F.coalesce(F.sum(F.when(test, F.col("amount"))), F.lit(0)).cast("long")

    return reservations.groupBy(user).agg(
        summed(is_open & ~over).alias("held"), summed(over).alias("released"),
        F.count_if(over).alias("expired_count"), summed(F.col("status") == "COMMITTED").alias("committed"),
    )


# -- usage --------------------------------------------------------------------------- #
def allow_listed(events: DataFrame, event: str, count: str, consent: str, allowed: Sequence[str] = USAGE_EVENTS) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected): unknown names are rejected, rows without consent are dropped, counts are >= 0."""
    known = F.col(event).isin(*allowed)
    accepted = events.filter(known & F.coalesce(F.col(consent), F.lit(False))).withColumn(
        count, F.greatest(F.col(count), F.lit(0))
    )
    return accepted, events.filter(~F.coalesce(known, F.lit(False)))


def usage_counts(events: DataFrame, machine: str, event: str, count: str) -> DataFrame:
    return events.groupBy(machine, event).agg(F.sum(count).cast("long").alias("count"))


def usage_payload(counts: DataFrame, machine: str, event: str, count: str) -> DataFrame:
    """One row per machine with a map of its counts; the vocabulary bounds the map."""
    entries = F.sort_array(F.collect_list(F.struct(F.col(event), F.col(count))))
    return counts.groupBy(machine).agg(F.map_from_entries(entries).alias("counts"), F.sum(count).cast("long").alias("total"))


# -- sequential rules ------------------------------------------------------------------- #
def limiter_fold(limit: int, window: float) -> Callable:
    """Hits of one key: how many stand in the open window, and when it opened."""

    def fold(columns, start, stop, opened, out):
        hits, since = opened or (0, 0.0)
        for i in range(start, stop):
            t = columns["t"][i]
            if columns["reset"][i]:
                hits, since, verdict = 0, 0.0, (True, limit, 0)
            else:
                if not hits or t - since >= window:
                    hits, since = 0, t
                hits += 1
                verdict = (hits <= limit, max(0, limit - hits), max(1, int(window - (t - since))))
            if out:
                out[0][i], out[1][i], out[2][i] = verdict
        return [hits, since] if hits else None

    return fold


def rate_limit(hits: DataFrame, key: str, time: Column, order: str, limit: int, window: float, reset: Column | None = None) -> DataFrame:
    """Verdict per hit: columns key, order, allowed, remaining, retry_after.

    A busy key is read in slots, with or without pauses; a slot forgets its entry at the first pause of a window or
    where the windows from two entries open at one hit.
    """
    import pyarrow as pa

    rows = hits.select(
        F.col(key).alias("key"), F.col(order).alias("ord"), time.cast("double").alias("t"),
        (F.lit(False) if reset is None else F.coalesce(reset, F.lit(False))).alias("reset"),
    )
    fields = [("allowed", pa.bool_()), ("remaining", pa.int64()), ("retry_after", pa.int64())]
    done = fold_slots(rows, ["key"], ["t", "ord"], limiter_fold(limit, window), fields)
    return done.select(F.col("key").alias(key), F.col("ord").alias(order), *(n for n, _ in fields))


# Scope, limit and window of the login policy; the address gets four times as much.
POLICY = {"login:email": (5, 300), "login:ip": (20, 300), "refresh": (30, 300)}


def login_verdicts(attempts: DataFrame, email: str, ip: str, time: Column, order: str, success: Column) -> DataFrame:
    """Attempts with both verdicts; a successful login clears the address book entry, not the IP."""
    hits = attempts.withColumn("__ok", success)
    # A success counts as a hit first and clears the counter right after it.
    doubled = hits.withColumn("__part", F.explode(F.when(F.col("__ok"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    doubled = doubled.withColumn("__seq", F.col(order) * 2 + F.col("__part"))
    limit, window = POLICY["login:email"]
    by_email = rate_limit(doubled, email, time, "__seq", limit, window, F.col("__part") == 1)
    by_email = by_email.filter(F.col("__seq") % 2 == 0).select(
        (F.col("__seq") / 2).cast("long").alias(order), F.col("allowed").alias("email_allowed"), F.col("remaining").alias("email_remaining")
    )
    limit, window = POLICY["login:ip"]
    by_ip = rate_limit(hits, ip, time, order, limit, window).select(
        F.col(order), F.col("allowed").alias("ip_allowed"), F.col("remaining").alias("ip_remaining")
    )
    return attempts.join(by_email, order).join(by_ip, order)


def seat_fold(columns, start, stop, state, out):
    """Seats of one licence: active devices in order of activation, and whether it was revoked."""
    active, revoked = state or ([], False)
    active = dict.fromkeys(active)
    for i in range(start, stop):
        action, device = columns["action"][i], columns["device"][i]
        if action == "revoke":
            verdict = "already_revoked" if revoked else "revoked"
            active, revoked = {}, True
        elif action == "deactivate":
            verdict = "released" if device in active else "ignored"
            active.pop(device, None)
        elif revoked:
            verdict = "refused"
        elif device in active:
            verdict = "reused"
        elif len(active) >= columns["seat_limit"][i]:
            verdict = "limit"
        else:
            verdict, active[device] = "activated", None
        if out:
            out[0][i], out[1][i] = verdict, len(active)
    return [sorted(active, key=repr), revoked]


def seat_history(events: DataFrame, licence: str, device: str, action: str, order: str, seat_limit: Column) -> DataFrame:
    """Verdict and active seats after each event of a licence.

    A licence is read in order, a busy one in slots that start from each other's ends; the state is no larger than the
    seat limit. Nothing can happen to a revoked licence any more, so its later events are judged apart.
    """
    import pyarrow as pa

    rows = events.select(
        F.col(licence).alias("licence"), F.col(device).alias("device"), F.col(action).alias("action"),
        F.col(order).alias("ord"), seat_limit.cast("long").alias("seat_limit"),
    )
    end = rows.filter(F.col("action") == "revoke").groupBy("licence").agg(F.min("ord").alias("__end"))
    rows = rows.join(end, "licence", "left")
    before = rows.filter(F.col("__end").isNull() | (F.col("ord") <= F.col("__end"))).drop("__end")
    after = rows.filter(F.col("ord") > F.col("__end")).drop("__end")
    live = fold_slots(before, ["licence"], ["ord"], seat_fold, [("verdict", pa.string()), ("active_seats", pa.int64())])
    late = after.withColumn(
        "verdict",
        F.when(F.col("action") == "revoke", "already_revoked").when(F.col("action") == "deactivate", "ignored").otherwise("refused"),
    ).withColumn("active_seats", F.lit(0).cast("long"))
    return live.unionByName(late).select(
        F.col("licence").alias(licence), F.col("device").alias(device), F.col("action").alias(action),
        F.col("ord").alias(order), "verdict", "active_seats",
    )


def token_history(presented: DataFrame, session: str, token: str, order: str, time: str, expires: str, available: str | None = None) -> DataFrame:
    """Outcome of each presentation of a refresh token: ok, reused, revoked, expired or user_unavailable.

    The first presentation of a live token spends it. Presenting a spent token again burns the
    whole session; a successor inherits the expiry of the session. The earliest second
    presentation decides the moment of the burn, so no row waits for another. So does the first live token
    that comes while the account is not ``available`` (a flag per row).
    """
    rows = presented.withColumn("__ok", F.lit(True) if available is None else F.coalesce(F.col(available), F.lit(False)))
    two = top_n(rows.select(session, token, order, time, expires, "__ok"), [session, token], [F.col(order)], 2)
    per_token = two.groupBy(session, token).agg(
        F.min(F.struct(order, time, expires, "__ok")).alias("__one"), F.max(order).alias("__two"), F.count(F.lit(1)).alias("__n")
    )
    live = F.col("__one")[time] < F.col("__one")[expires]
    per_token = per_token.select(
        session, token, F.col("__one")[order].alias("__first"), (live & F.col("__one")["__ok"]).alias("__alive"),
        F.when(live & ~F.col("__one")["__ok"], F.col("__one")[order]).when(live & (F.col("__n") > 1), F.col("__two")).alias("__again"),
    )
    burn = per_token.groupBy(session).agg(F.min("__again").alias("__burn"))
    rows = rows.join(per_token, [session, token]).join(burn, session, "left")
    burned = F.coalesce(F.col(order) > F.col("__burn"), F.lit(False))
    spent_in_time = F.col("__alive") & (F.col("__burn").isNull() | (F.col("__first") < F.col("__burn")))
    outcome = (
        F.when(spent_in_time & (F.col(order) > F.col("__first")), "reused")
        .when(burned, "revoked")
        .when(F.col(time) >= F.col(expires), "expired")
        .when(~F.col("__ok"), "user_unavailable")
        .otherwise("ok")
    )
    return rows.select(*presented.columns, outcome.alias("outcome"))


def flush_fold(columns, start, stop, pending, out):
    """Usage total of one machine: emitted and cleared whenever it reaches the limit."""
    pending, counts = pending or 0, columns["count"]
    for i in range(start, stop):
        pending += max(0, counts[i] or 0)
        sent = pending if pending >= FLUSH_AT else 0
        pending -= sent
        if out:
            out[0][i], out[1][i] = sent, pending
    return pending


def counter_flushes(events: DataFrame, machine: str, order: str, count: str) -> DataFrame:
    """Running usage total per machine: what each event sends and what stays pending.

    What is pending lies below the limit, so a slot of a busy machine has that many ways to be entered and
    all of them are followed at once.
    """
    import pyarrow as pa

    rows = events.select(F.col(machine).alias("machine"), F.col(order).alias("ord"), F.col(count).cast("long").alias("count"))
    done = fold_slots(rows, ["machine"], ["ord"], flush_fold, [("flushed", pa.int64()), ("pending", pa.int64())], range(FLUSH_AT))
    return done.select(F.col("machine").alias(machine), F.col("ord").alias(order), "flushed", "pending")
