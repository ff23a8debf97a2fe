"""Keyed updates: retouch states, links, labels, overrides, status changes, audit rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frameloom.operators.ordered import first_row

# Retouch states; command -> (target, new status, audit action).
RETOUCH = ("none", "needed", "done")
COMMANDS = {
    "suspend": ("license", "SUSPENDED", "LICENSE_SUSPENDED"),
    "revoke": ("license", "REVOKED", "LICENSE_REVOKED"),
    "disable": ("user", "DISABLED", "USER_DISABLED"),
    "enable": ("user", "ACTIVE", "USER_ENABLED"),
    "publish": ("release", "PUBLISHED", "RELEASE_PUBLISHED"),
    "yank": ("release", "YANKED", "RELEASE_YANKED"),
}


def asset_list(referenced: DataFrame, needed: DataFrame, path: str = "path") -> DataFrame:
    """Assets with their link and retouch state: needed if flagged, else none."""
    flags = needed.select(path).distinct().withColumn("__needed", F.lit(True))
    return referenced.join(flags, path, "left").select(
        *referenced.columns, F.col(path).alias("linked_path"),
        F.when(F.col("__needed"), "needed").otherwise("none").alias("retouch_status"),
    )


def latest(commands: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Last command per key."""
    return first_row(commands, list(keys), F.col(order), largest=True)


def keyed_update(table: DataFrame, changes: DataFrame, keys: Sequence[str], column: str, value: str) -> DataFrame:
    """Set ``column`` from ``changes.value`` where the key matches (one change per key)."""
    keys = list(keys)
    new = changes.select(*keys, F.col(value).alias("__new"), F.lit(True).alias("__hit"))
    joined = table.join(new, keys, "left")
    changed = F.when(F.col("__hit"), F.col("__new")).otherwise(F.col(column))
    return joined.withColumn(column, changed).select(*table.columns)


def set_retouch(assets: DataFrame, commands: DataFrame, order: str, path: str = "path") -> tuple[DataFrame, DataFrame]:
    """(assets, rejects): unknown states and unknown paths are rejected with a reason.

    The last state of a path is found by its number: two numbers a path are hashed, where a text would have all
    commands of a task sorted. Commands for unknown paths meet no asset and need no check.
    """
    known = assets.select(path).distinct().withColumn("__known", F.lit(True))
    judged = commands.join(known, path, "left").withColumn(
        "reason",
        F.when(~F.col("status").isin(*RETOUCH), "unknown_status").when(F.col("__known").isNull(), "unknown_path"),
    )
    states = F.lit(list(RETOUCH))
    valid = commands.filter(F.coalesce(F.col("status").isin(*RETOUCH), F.lit(True)))
    good = valid.groupBy(path).agg(F.max_by(F.array_position(states, F.col("status")).cast("int"), order).alias("__state"))
    good = good.select(path, F.element_at(states, F.col("__state")).alias("status"))
    updated = keyed_update(assets, good, [path], "retouch_status", "status")
    return updated, judged.filter("reason IS NOT NULL").select(*commands.columns, "reason")


def relink(assets: DataFrame, links: DataFrame, order: str, path: str = "path") -> tuple[DataFrame, DataFrame]:
    """(assets, rejects): point assets at new files; unknown paths are rejected."""
    good = latest(links.join(assets.select(path), path, "left_semi"), [path], order)
    return (
        keyed_update(assets, good, [path], "linked_path", "new_link"),
        links.join(assets.select(path), path, "left_anti"),
    )


def pending_retouch(assets: DataFrame) -> DataFrame:
    return assets.filter(F.col("retouch_status") == "needed")


def flat_placements(spreads: DataFrame, placements: str, keys: Sequence[str]) -> DataFrame:
    """One row per placement in stacking order, frame and crop unpacked.

    ``placements`` is an array of struct(path, frame_px, crop, z_index); equal z keeps its place.
    """
    order = F.transform(
        F.col(placements),
        lambda p, i: F.struct(F.coalesce(p["z_index"], F.lit(0)).alias("z"), i.alias("i"), p.alias("p")),
    )
    each = spreads.select(*keys, F.posexplode(F.sort_array(order)).alias("layer", "__o"))
    p = F.col("__o.p")
    frame = {n: F.get(p["frame_px"], F.lit(i)).cast("long") for i, n in enumerate(("frame_x", "frame_y", "frame_w", "frame_h"))}
    crop = {n: F.get(p["crop"], F.lit(i)).cast("double") for i, n in enumerate(("crop_x", "crop_y", "crop_w", "crop_h"))}
    return each.select(
        *keys, "layer", p["path"].alias("path"), *[c.alias(n) for n, c in (frame | crop).items()],
        F.col("__o.z").cast("long").alias("z_index"),
    )


def label_clusters(clusters: DataFrame, commands: DataFrame, keys: Sequence[str], order: str) -> tuple[DataFrame, DataFrame]:
    """(clusters, rejects): set label and side; clearing the label clears the side."""
    keys = list(keys)
    new = latest(commands, keys, order).select(
        *keys, F.col("label").alias("__l"), F.when(F.coalesce(F.col("label"), F.lit("")) != "", F.col("side")).alias("__s"),
        F.lit(True).alias("__hit"),
    )
    joined = clusters.join(new, keys, "left")
    out = joined.withColumns(
        {
            "label": F.when(F.col("__hit"), F.col("__l")).otherwise(F.col("label")),
            "side": F.when(F.col("__hit"), F.col("__s")).otherwise(F.col("side")),
        }
    ).select(*clusters.columns)
    return out, commands.join(clusters.select(*keys), keys, "left_anti")


def merge_overrides(prior: DataFrame, new: DataFrame, path: str = "path") -> DataFrame:
    """Saved overrides with new ones on top, one row per path."""
    right = new.select(path, F.col("category").alias("__new"))
    return prior.join(right, path, "full_outer").select(path, F.coalesce("__new", "category").alias("category"))


def apply_overrides(records: DataFrame, overrides: DataFrame, path: str = "path") -> DataFrame:
    """The user's category wins and resets both flags; paths that are not there are ignored."""
    wish = overrides.select(path, F.col("category").alias("__wish"))
    joined = records.join(wish, path, "left")
    forced = F.col("__wish").isNotNull()
    return joined.withColumns(
        {
            "category": F.coalesce("__wish", "category"),
            "is_best_shot": F.when(forced, F.col("__wish") == "BestShots").otherwise(F.col("is_best_shot")),
            "is_duplicate": F.when(forced, F.col("__wish") == "Duplicates").otherwise(F.col("is_duplicate")),
        }
    ).select(*records.columns)


def face_boxes(photos: DataFrame, brains: DataFrame, cached: DataFrame, path: str = "path") -> DataFrame:
    """Face boxes per photo: landmark box, else detected box, else the cached regions; none drops out.

    ``brains`` has boxes and landmark_boxes (one per box, null where unusable), ``cached`` regions.
    """
    joined = photos.join(brains, path, "left").join(cached, path, "left")
    from_brain = F.transform(
        F.coalesce("boxes", F.array().cast(brains.schema["boxes"].dataType)),
        lambda b, i: F.coalesce(F.get("landmark_boxes", i.cast("int")), b),
    )
    chosen = F.when(F.size(from_brain) > 0, from_brain).otherwise(F.col("regions"))
    return joined.withColumn("faces", chosen).filter(F.coalesce(F.size("faces"), F.lit(0)) > 0).select(*photos.columns, "faces")


# -- status changes ---------------------------------------------------------------- #
def apply_commands(
    commands: DataFrame, licences: DataFrame, activations: DataFrame, users: DataFrame, sessions: DataFrame,
    releases: DataFrame,
) -> dict[str, DataFrame]:
    """Run bulk status commands and their cascades; each applied change yields an audit row.

    commands (seq, command, target_id, at, actor), the last per target counts for its status. Revoking a licence
    closes its active seats, disabling a user revokes the live sessions, publishing stamps the
    time. Nobody disables their own account. Keys: licence, (licence, device), user, (session,
    user), release. A licence gets the time of its last revoke. Audit rows say more as JSON: version and channel of
    a release, the number of sessions a disable revoked (the first of a user takes them all).
    """
    spec = F.create_map(*[F.lit(x) for name, (kind, _, _) in COMMANDS.items() for x in (name, kind)])
    status = F.create_map(*[F.lit(x) for name, (_, to, _) in COMMANDS.items() for x in (name, to)])
    action = F.create_map(*[F.lit(x) for name, (_, _, a) in COMMANDS.items() for x in (name, a)])
    own = (F.col("command") == "disable") & (F.col("target_id") == F.col("actor"))
    valid = commands.filter(F.col("command").isin(*COMMANDS) & ~F.coalesce(own, F.lit(False)))
    valid = valid.withColumns({"target_type": spec[F.col("command")], "to_status": status[F.col("command")], "action": action[F.col("command")]})

    def targets(kind: str, table: DataFrame, key: str) -> DataFrame:
        hits = valid.filter(F.col("target_type") == kind)
        return hits.join(table.select(F.col(key).alias("target_id")).distinct(), "target_id", "left_semi")

    on_licence, on_user, on_release = (
        targets("license", licences, "licence"), targets("user", users, "user"), targets("release", releases, "release"),
    )

    def updated(table: DataFrame, hits: DataFrame, key: str) -> DataFrame:
        last = latest(hits.select("target_id", "seq", "to_status"), ["target_id"], "seq").withColumnRenamed("target_id", key)
        return keyed_update(table, last, [key], "status", "to_status")

    closed = on_licence.filter(F.col("command") == "revoke").groupBy(F.col("target_id").alias("licence")).agg(F.min("at").alias("__at"))
    seats = activations.join(closed, "licence", "left")
    ends = (F.col("status") == "ACTIVE") & F.col("__at").isNotNull()
    seats = seats.withColumns(
        {
            "deactivated_at": F.when(ends, F.col("__at")).otherwise(F.col("deactivated_at")),
            "status": F.when(ends, "DEACTIVATED").otherwise(F.col("status")),
        }
    ).select(*activations.columns)

    out = on_user.filter(F.col("command") == "disable").groupBy(F.col("target_id").alias("user")).agg(F.min("at").alias("__at"))
    live = sessions.join(out, "user", "left").withColumn(
        "revoked_at", F.coalesce("revoked_at", "__at")
    ).select(*sessions.columns)

    stamp = on_release.filter(F.col("command") == "publish").groupBy(F.col("target_id").alias("release")).agg(F.max_by("at", "seq").alias("__at"))
    published = updated(releases, on_release, "release").join(stamp, "release", "left").withColumn(
        "published_at", F.coalesce("__at", "published_at")
    ).select(*releases.columns)

    revoked = on_licence.filter(F.col("command") == "revoke").groupBy(F.col("target_id").alias("licence")).agg(
        F.max_by("at", "seq").alias("revoked_at")
    )
    # the first disable finds the live sessions; later ones find none
    taken = live_sessions(sessions).join(
        on_user.filter(F.col("command") == "disable").groupBy(F.col("target_id").alias("user")).agg(F.min_by("seq", F.struct("at", "seq")).alias("seq")), "user"
    ).groupBy("seq").agg(F.count(F.lit(1)).alias("__n"))
    about_user = F.when(F.col("command") == "disable", F.to_json(F.struct(F.coalesce("__n", F.lit(0)).cast("long").alias("sessions_revoked"))))
    named = releases.select(F.col("release").alias("target_id"), F.col("release").cast("string").alias("version"), F.col("channel").alias("__channel"))
    about_release = F.to_json(F.struct("version", F.col("__channel").alias("channel")))
    audit = (
        on_licence.withColumn("metadata", F.lit(None).cast("string"))
        .unionByName(on_user.join(taken, "seq", "left").withColumn("metadata", about_user).drop("__n"))
        .unionByName(on_release.join(named, "target_id").withColumn("metadata", about_release).drop("version", "__channel"))
        .select("seq", "actor", "action", "target_type", "target_id", "at", "metadata")
    )
    return {
        "licences": updated(licences, on_licence, "licence").join(revoked, "licence", "left"),
        "activations": seats,
        "users": updated(users, on_user, "user"),
        "sessions": live,
        "releases": published,
        "audit": audit,
    }


def live_sessions(sessions: DataFrame) -> DataFrame:
    return sessions.filter(F.col("revoked_at").isNull())


def end_sessions(tokens: DataFrame, logouts: DataFrame, reason: str = "logout") -> dict[str, DataFrame]:
    """Log out: a shown token ends its session, that is every live token of it, whatever its own state.

    tokens (token, session, revoked_at, revoked_reason), logouts (seq, token, at), ``seq`` unique. Of several logouts of a
    session the first ends it. Every logout gets an outcome row: ``revoked`` tokens and ``ended``; an unknown or null token,
    and a session without live tokens, give 0 and false. Returns tokens, outcomes and audit (sessions that ended).
    """
    at = F.struct("seq", "at")
    # Only the first showing of a token can end anything, so a token shown often is one row before it meets the table.
    shown = logouts.filter(F.col("token").isNotNull()).groupBy("token").agg(F.min(at).alias("__shown"))
    can_end = F.col("revoked_at").isNull() & F.col("session").isNotNull()
    live = tokens.filter(can_end).groupBy("session").agg(F.count(F.lit(1)).alias("__live"))
    owned = tokens.filter(F.col("session").isNotNull()).select("token", "session")
    ended = shown.join(owned, "token").groupBy("session").agg(F.min("__shown").alias("__shown")).join(live, "session")
    ended = ended.select("session", F.col("__shown.seq").alias("seq"), F.col("__shown.at").alias("__at"), F.col("__live").alias("revoked"))
    # Tokens already revoked do not move.
    hit = F.col("__at").isNotNull()
    open_now = tokens.filter(can_end).join(ended.select("session", "__at"), "session", "left").withColumns({
        "revoked_at": F.when(hit, F.col("__at")),
        "revoked_reason": F.when(hit, F.lit(reason)).otherwise(F.col("revoked_reason")),
    })
    outcomes = logouts.join(ended.select("seq", "revoked"), "seq", "left").withColumn("revoked", F.coalesce("revoked", F.lit(0)).cast("long"))
    audit = ended.select(
        "seq", F.lit("LOGOUT").alias("action"), F.lit("session").alias("target_type"), F.col("session").cast("string").alias("target_id"),
        F.col("__at").alias("at"),
    )
    return {
        "tokens": open_now.select(*tokens.columns).unionByName(tokens.filter(~can_end)),
        "outcomes": outcomes.select(*logouts.columns, "revoked", (F.col("revoked") > 0).alias("ended")), "audit": audit,
    }


def deactivate_devices(commands: DataFrame, activations: DataFrame, devices: DataFrame) -> dict[str, DataFrame]:
    """Close one seat each: the active activation of (licence, device), its device and an audit row.

    commands (seq, licence, device, at, actor); a command without an active activation is refused. Of several for
    one seat the first counts.
    """
    seats = activations.filter(F.col("status") == "ACTIVE").select("licence", "device").distinct()
    first = first_row(commands, ["licence", "device"], F.col("seq"))
    done = first.join(seats, ["licence", "device"], "left_semi")
    refused = commands.join(done.select("seq"), "seq", "left_anti")

    def closed(table: DataFrame, keys: list[str], when: DataFrame, hit: Column) -> DataFrame:
        joined = table.join(when, keys, "left")
        change = F.col("__at").isNotNull() & hit
        return joined.withColumns(
            {
                "deactivated_at": F.when(change, F.col("__at")).otherwise(F.col("deactivated_at")),
                "status": F.when(change, "DEACTIVATED").otherwise(F.col("status")),
            }
        ).select(*table.columns)

    seat = done.select("licence", "device", F.col("at").alias("__at"))
    device = done.groupBy("device").agg(F.max_by("at", "seq").alias("__at"))
    audit = done.select(
        "seq", "actor", F.lit("LICENSE_DEVICE_DEACTIVATED").alias("action"), F.lit("license_activation").alias("target_type"),
        F.to_json(F.struct(F.col("licence").cast("string").alias("license_id"), F.col("device").cast("string").alias("device_id"))).alias("metadata"), "at",
    )
    return {
        "activations": closed(activations, ["licence", "device"], seat, F.col("status") == "ACTIVE"),
        "devices": closed(devices, ["device"], device, F.lit(True)), "audit": audit, "refused": refused.select("seq"),
    }


def partial_update(table: DataFrame, changes: DataFrame, key: str, fields: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(table, audit): only supplied fields change; the audit row lists them sorted.

    ``changes`` has one row per key and a column per field, null where not supplied.
    """
    new = changes.select(key, *[F.col(f).alias(f"__{f}") for f in fields])
    joined = table.join(new, key, "left")
    updated = joined.withColumns({f: F.coalesce(F.col(f"__{f}"), F.col(f)) for f in fields}).select(*table.columns)
    named: Column = F.array_sort(F.array_compact(F.array(*[F.when(F.col(f).isNotNull(), F.lit(f)) for f in fields])))
    audit = (
        changes.join(table.select(key), key, "left_semi")
        .withColumn("fields", named).filter(F.size("fields") > 0).select(key, "fields")
    )
    return updated, audit


def revoked_counts(before: DataFrame, by: str, revoked_at: str, commands: DataFrame) -> DataFrame:
    """How many live rows each revoke command changes, zero included."""
    live = before.filter(F.col(revoked_at).isNull()).groupBy(by).agg(F.count(F.lit(1)).alias("revoked"))
    return commands.select(by).distinct().join(live, by, "left").withColumn(
        "revoked", F.coalesce("revoked", F.lit(0)).cast("long")
    )
