"""Small column helpers shared by every area."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clamp(x: Column | str, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), col(x)))


def all_of(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def any_of(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def let(value: Column, body) -> Column:
    """Name an intermediate value: ``body`` receives it computed once, not copied into each use."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


# -- paths ------------------------------------------------------------------ #
def file_name(path: Column | str) -> Column:
    return F.element_at(F.split(col(path), "/"), -1)


def suffix(path: Column | str) -> Column:
    """Lower-cased last suffix with its dot; empty for none and for dot files."""
    return F.lower(F.regexp_extract(file_name(path), r"[^.]\.*?(\.[^.]+)$", 1))


def stem(path: Column | str) -> Column:
    name = file_name(path)
    return F.substring(name, F.lit(1), F.length(name) - F.length(suffix(path)))


# -- identifiers ------------------------------------------------------------ #
def normal_key(key: Column | str) -> Column:
    """Licence key without spaces and hyphens, upper-cased; null gives an empty text."""
    return F.coalesce(F.upper(F.regexp_replace(col(key), r"[\s\-]+", "")), F.lit(""))


def key_hash(key: Column | str) -> Column:
    k = normal_key(key)
    return F.when(k == "", F.lit("")).otherwise(F.sha2(k, 256))


def key_last4(key: Column | str) -> Column:
    return F.right(normal_key(key), F.lit(4))


def normal_email(email: Column | str) -> Column:
    """Trimmed, lower-cased address; a blank one becomes null so callers can reject it."""
    return F.nullif(F.lower(F.trim(col(email))), F.lit(""))


def limiter_key(scope: Column | str, identity: Column | str) -> Column:
    scope = F.lit(scope) if isinstance(scope, str) else scope
    return F.concat(scope, F.lit(":"), F.left(F.sha2(col(identity), 256), F.lit(32)))


_OCTET = r"(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_H = r"[0-9A-Fa-f]{1,4}"
_V6 = "|".join(
    [f"({_H}:){{7}}{_H}"]
    + [f"({_H}:){{{n}}}(:{_H}){{1,{7 - n}}}" for n in range(1, 7)]
    + [f":((:{_H}){{1,7}}|:)", f"({_H}:){{1,7}}:"]
)


def valid_ip(text: Column | str) -> Column:
    """The address when it is a plain IPv4 or IPv6 address, else null."""
    t = col(text)
    return F.when(t.rlike(rf"^({_OCTET}\.){{3}}{_OCTET}$") | t.rlike(f"^({_V6})$"), t)


def valid_url(url: Column | str) -> Column:
    """An absolute http(s) address, or none at all."""
    u = col(url)
    return u.isNull() | u.startswith("https://") | u.startswith("http://")


def valid_sha256(digest: Column | str) -> Column:
    """Lower-cased digest when it is 64 hex digits, else null."""
    d = col(digest)
    return F.when(d.rlike("^[0-9a-fA-F]{64}$"), F.lower(d))


# -- print sizes ------------------------------------------------------------ #
MM_PER_INCH = 25.4


def mm_to_px(mm: Column | str, dpi: int) -> Column:
    return F.rint(col(mm) / F.lit(MM_PER_INCH) * F.lit(dpi)).cast("long")


def inch_to_px(inches: Column | str, dpi: int) -> Column:
    return F.rint(col(inches) * F.lit(dpi)).cast("long")


def sheet_axis(length_px: Column, margin_px: Column, gap_px: Column, tile_px: Column) -> Column:
    """How many tiles fit along one side of a sheet."""
    usable = length_px - 2 * margin_px
    return F.when(usable < tile_px, F.lit(0)).otherwise(
        F.floor((usable + gap_px) / (tile_px + gap_px))
    ).cast("long")


def sheet_grid(
    width_px: Column, height_px: Column, margin_px: Column, gap_px: Column,
    tile_w: Column, tile_h: Column,
) -> tuple[Column, Column]:
    """(columns, rows) on a sheet; zero both ways when one side holds no tile."""
    cols = sheet_axis(width_px, margin_px, gap_px, tile_w)
    rows = sheet_axis(height_px, margin_px, gap_px, tile_h)
    fits = (cols > 0) & (rows > 0)
    zero = F.lit(0).cast("long")
    return F.when(fits, cols).otherwise(zero), F.when(fits, rows).otherwise(zero)


# -- identity tokens -------------------------------------------------------- #
# The roles and tokens of the label vocabulary.
IMMEDIATE_FAMILY = ("mother", "father", "brother", "sister")
FAMILY = IMMEDIATE_FAMILY + ("relative",)


def role_tokens(label: Column | str, side: Column | str) -> Column:
    """Presence tokens of a labelled person: family goes by side and closeness."""
    label, side = col(label), col(side)
    by_side = F.when(side == "bride", F.lit("family_bride")).when(
        side == "groom", F.lit("family_groom")
    )
    close = F.when(label.isin(*IMMEDIATE_FAMILY), F.lit("close_family"))
    return (
        F.when(label.isNull() | (label == ""), F.array().cast("array<string>"))
        .when(label.isin(*FAMILY), F.array_compact(F.array(by_side, close)))
        .otherwise(F.array(label))
    )
