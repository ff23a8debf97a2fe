"""Licence, token and release rules as column expressions with an explicit moment."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from frameloom.functions.scalar import col, valid_sha256, valid_url

# Days of trial, of grace without a check, and between checks.
TRIAL_DAYS, GRACE_DAYS, RECHECK_DAYS = 14, 21, 7
BLOCKING = ("REVOKED", "SUSPENDED", "PENDING")


def licence_valid_at(status: Column, starts: Column, expires: Column, moment: Column) -> Column:
    """Status and date window; open ends pass, a stored EXPIRED alone does not block."""
    return (
        ~status.isin(*BLOCKING)
        & F.coalesce(moment >= starts, F.lit(True))
        & F.coalesce(moment < expires, F.lit(True))
    )


def licence_reject_reason(status: Column, starts: Column, expires: Column, moment: Column) -> Column:
    """First rule that refuses the licence, or null."""
    return (
        F.when(status == "REVOKED", "revoked")
        .when(status == "SUSPENDED", "suspended")
        .when(status == "PENDING", "pending")
        .when(moment < starts, "not_started")
        .when(moment >= expires, "expired")
    )


def _day(text: Column) -> Column:
    """A date column, or text where an empty string means none."""
    return F.try_to_date(F.nullif(text.cast("string"), F.lit("")))


def trial_days_left(first_run: Column, today: Column) -> Column:
    used = F.datediff(today, _day(first_run))
    return F.coalesce(F.greatest(F.lit(0), TRIAL_DAYS - used), F.lit(TRIAL_DAYS))


def client_state(
    key: Column, activated: Column, expires: Column, last_check: Column, first_run: Column, today: Column,
) -> Column:
    """struct(state, days_left) of a client: expired, grace, active, trial or trial_expired."""
    licensed = (F.coalesce(key, F.lit("")) != "") & (F.coalesce(activated.cast("string"), F.lit("")) != "")
    since = F.coalesce(F.datediff(today, F.coalesce(_day(last_check), _day(activated))), F.lit(0))
    left = trial_days_left(first_run, today)

    def state(name: str, days: Column | None = None) -> Column:
        return F.struct(
            F.lit(name).alias("state"),
            (F.lit(None) if days is None else days).cast("long").alias("days_left"),
        )

    return (
        F.when(licensed & (_day(expires) < today), state("expired"))
        .when(licensed & (since > GRACE_DAYS), state("expired"))
        .when(licensed & (since > RECHECK_DAYS), state("grace", GRACE_DAYS - since))
        .when(licensed, state("active"))
        .when(left > 0, state("trial", left))
        .otherwise(state("trial_expired"))
    )


def token_usable_at(revoked_at: Column, replaced_by: Column, expires: Column, moment: Column) -> Column:
    return revoked_at.isNull() & replaced_by.isNull() & (moment < expires)


def token_outcome(
    known: Column, replaced_by: Column, revoked_at: Column, expires: Column, user_active: Column, moment: Column,
) -> Column:
    """What presenting a token leads to, by the first rule that applies."""
    return (
        F.when(~F.coalesce(known, F.lit(False)), "unknown")
        .when(replaced_by.isNotNull(), "reused")
        .when(revoked_at.isNotNull(), "revoked")
        .when(moment >= expires, "expired")
        .when(~F.coalesce(user_active, F.lit(False)), "user_unavailable")
        .otherwise("ok")
    )


def release_problem(url: Column | str, notes_url: Column | str, digest: Column | str) -> Column:
    """Name of the first invalid metadata field, or null."""
    bad_digest = col(digest).isNotNull() & valid_sha256(digest).isNull()
    return (
        F.when(~valid_url(url), "download_url")
        .when(~valid_url(notes_url), "release_notes_url")
        .when(bad_digest, "sha256")
    )

