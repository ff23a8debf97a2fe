"""Colour rules: hue, event by colour, tints, and the gentle edit recipe."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from frameloom.functions.scalar import clamp, col, let

# Base and accent colour of each event palette.
PALETTES = {
    "Haldi": ((245, 205, 60), (176, 120, 20)),
    "Mehndi": ((70, 160, 80), (34, 96, 46)),
    "Baraat": ((196, 52, 48), (120, 24, 24)),
    "Reception": ((208, 168, 92), (150, 110, 40)),
}


def hsv(r: Column | str, g: Column | str, b: Column | str) -> Column:
    """Hue in degrees, saturation and value from 0..255 channels."""
    scaled = F.struct(*[(col(c) / 255.0).alias(n) for c, n in ((r, "r"), (g, "g"), (b, "b"))])
    bounds = lambda c: F.struct(
        c["r"].alias("r"), c["g"].alias("g"), c["b"].alias("b"),
        F.greatest(c["r"], c["g"], c["b"]).alias("top"), F.least(c["r"], c["g"], c["b"]).alias("low"),
    )
    return let(let(scaled, bounds), _hue_saturation)


def _hue_saturation(c: Column) -> Column:
    top, spread = c["top"], c["top"] - c["low"]
    sector = (
        F.when(top == c["r"], (c["g"] - c["b"]) / spread)
        .when(top == c["g"], (c["b"] - c["r"]) / spread + 2.0)
        .otherwise((c["r"] - c["g"]) / spread + 4.0)
    )
    turn = let(sector, lambda x: F.when(x < 0, x / 6.0 + 1.0).otherwise(x / 6.0))
    return F.struct(
        F.when(spread == 0, F.lit(0.0)).otherwise(turn * 360.0).alias("hue"),
        F.when(top == 0, F.lit(0.0)).otherwise(spread / top).alias("s"),
        top.alias("v"),
    )


def colour_event(r: Column | str, g: Column | str, b: Column | str) -> Column:
    """struct(event, confidence) from a mood colour.

    The closeness to a hue centre is deliberately not circular.
    """
    return let(hsv(r, g, b), _rule)


def _rule(c: Column) -> Column:
    hue, s, v = c["hue"], c["s"], c["v"]

    def strength(sat: Column) -> Column:
        return clamp(sat * 0.65 + 0.35, 0.0, 1.0) * clamp(v, 0.4, 1.0)

    def named(event: str, centre: float | None = None, sat: Column = s) -> Column:
        value = strength(sat)
        if centre is not None:
            close = F.greatest(F.lit(0.0), 1.0 - F.abs(hue - centre) / 45.0)
            value = value * 0.5 + close * 0.5
        return F.struct(
            F.lit(event).alias("event"),
            F.round(clamp(value, 0.0, 1.0), 3).alias("confidence"),
        )

    warm_grey = (s >= 0.08) & (v >= 0.55) & ((hue <= 65.0) | (hue >= 350.0))
    return (
        F.when((s < 0.18) & warm_grey, named("Reception", sat=F.lit(0.18) - s + 0.3))
        .when(s < 0.18, named("Portraits", sat=F.lit(0.5)))
        .when(hue.between(40.0, 70.0) & (v >= 0.4), named("Haldi", 55.0))
        .when(hue.between(80.0, 160.0), named("Mehndi", 120.0))
        .when(hue.between(340.0, 360.0) | hue.between(0.0, 20.0), named("Baraat", 5.0))
        .when(hue.between(20.0, 40.0) & (v >= 0.4), named("Reception", 30.0))
        .otherwise(F.struct(F.lit("Ceremony").alias("event"), F.lit(0.4).alias("confidence")))
    )


def colour_event_name(event: Column, minimum: float = 0.45) -> Column:
    """Event name when the colour is telling enough, else null."""
    return let(
        event, lambda e: F.when((e["event"] != "Ceremony") & (e["confidence"] >= minimum), e["event"])
    )


def loose_event_name(r: Column | str, g: Column | str, b: Column | str) -> Column:
    """The one event recognised from hue, saturation and value alone, else null."""
    haldi = lambda c: (c["s"] >= 0.35) & (c["v"] >= 0.4) & c["hue"].between(40.0, 70.0)
    return let(hsv(r, g, b), lambda c: F.when(haldi(c), F.lit("Haldi")))


def tint(channel: Column | str, lighten: float = 0.66) -> Column:
    """A channel blended towards white."""
    t = max(0.0, min(1.0, lighten))
    return F.rint(col(channel) * (1.0 - t) + 255.0 * t).cast("int")


def to_hex(r: Column | str, g: Column | str, b: Column | str) -> Column:
    parts = [clamp(col(c).cast("int"), 0, 255).cast("int") for c in (r, g, b)]
    return F.format_string("#%02X%02X%02X", *parts)


def themed_background(event: Column, lighten: float = 0.62, minimum: float = 0.5) -> Column:
    """struct(background, accent) as hex for a confident event with a palette, else null."""
    pairs = []
    for name, (base, accent) in PALETTES.items():
        pair = F.struct(
            to_hex(*[tint(F.lit(c), lighten) for c in base]).alias("background"),
            to_hex(*[F.lit(c) for c in accent]).alias("accent"),
        )
        pairs += [F.lit(name), pair]
    palette = F.create_map(*pairs)
    return let(event, lambda e: F.when(e["confidence"] >= minimum, palette[e["event"]]))


# -- edit recipe ------------------------------------------------------------- #
# Deadzones, limits and targets of the automatic correction.
GAIN_DEADZONE, EXPOSURE_DEADZONE, CONTRAST_DEADZONE = 0.06, 0.12, 0.08
GAIN_LIMITS, EXPOSURE_LIMITS, CONTRAST_LIMITS = (0.85, 1.18), (0.8, 1.4), (0.92, 1.15)
TARGET_BRIGHTNESS, REFERENCE_STD, STRENGTH = 0.5, 0.22, 0.5


def soften(ratio: Column, strength: float, deadzone: float) -> Column:
    """A correction pulled towards 1; small ones vanish."""
    delta = ratio - 1.0
    return F.when(F.abs(delta) <= deadzone, F.lit(1.0)).otherwise(delta * strength + 1.0)


def edit_recipe(
    r_mean: Column | str, g_mean: Column | str, b_mean: Column | str,
    luma_mean: Column | str, luma_std: Column | str, strength: float = STRENGTH,
) -> Column:
    """Channel gains, exposure and contrast multipliers from channel statistics (0..255)."""
    r, g, b = col(r_mean), col(g_mean), col(b_mean)
    grey = (r + g + b) / 3.0

    def corrected(target: Column, current: Column, deadzone: float, limits: tuple) -> Column:
        low, high = limits
        return F.when(current <= 1e-6, F.lit(high)).otherwise(
            clamp(soften(target / current, strength, deadzone), low, high)
        )

    return F.struct(
        corrected(grey, r, GAIN_DEADZONE, GAIN_LIMITS).alias("gain_r"),
        corrected(grey, g, GAIN_DEADZONE, GAIN_LIMITS).alias("gain_g"),
        corrected(grey, b, GAIN_DEADZONE, GAIN_LIMITS).alias("gain_b"),
        corrected(F.lit(TARGET_BRIGHTNESS), col(luma_mean) / 255.0, EXPOSURE_DEADZONE, EXPOSURE_LIMITS).alias("exposure"),
        corrected(F.lit(REFERENCE_STD), col(luma_std) / 255.0, CONTRAST_DEADZONE, CONTRAST_LIMITS).alias("contrast"),
    )
