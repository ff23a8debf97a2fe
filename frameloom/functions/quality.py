"""Quality measures of one photo as column expressions."""

from __future__ import annotations

import dataclasses

from pyspark.sql import Column
from pyspark.sql import functions as F

from frameloom.functions.scalar import clamp, col

# Scoring weights, reference points and bands.
BLUR_REFERENCE = 100.0
CONTRAST_REFERENCE = 64.0
IDEAL_BRIGHTNESS = 127.5
USABLE_SHARPNESS = 15.0
USABLE_BRIGHTNESS = (12.0, 243.0)
HERO, BEST, REVIEW = 90.0, 75.0, 60.0
CATEGORIES = ("BestShots", "Duplicates", "Blurry", "Review")


@dataclasses.dataclass(frozen=True)
class Weights:
    blur: float = 0.5
    exposure: float = 0.2
    face: float = 0.3


def quality_score(
    sharpness: Column | str,
    brightness: Column | str,
    contrast: Column | str,
    has_face: Column | str,
    weights: Weights = Weights(),
    face_weight: Column | None = None,
) -> Column:
    """Score 0..100. ``face_weight`` overrides the weight with a computed column."""
    sharp, bright, contr = col(sharpness), col(brightness), col(contrast)
    face = F.lit(weights.face) if face_weight is None else face_weight
    blur_part = F.when(sharp <= 0, F.lit(0.0)).otherwise(sharp / (sharp + BLUR_REFERENCE))
    bright_part = clamp(1.0 - F.abs(bright - IDEAL_BRIGHTNESS) / IDEAL_BRIGHTNESS, 0.0, 1.0)
    contrast_part = clamp(contr / CONTRAST_REFERENCE, 0.0, 1.0)
    face_part = F.when(col(has_face), F.lit(1.0)).otherwise(F.lit(0.0))
    total = (
        blur_part * weights.blur
        + (bright_part + contrast_part) * 0.5 * weights.exposure
        + face_part * face
    )
    return F.round(clamp(total / (face + weights.blur + weights.exposure), 0.0, 1.0) * 100.0, 2)


def is_usable(sharpness: Column | str, brightness: Column | str) -> Column:
    low, high = USABLE_BRIGHTNESS
    return (col(sharpness) >= USABLE_SHARPNESS) & col(brightness).between(low, high)


def subject_sharpness(blur: Column | str, regions: Column | str, width: Column, height: Column) -> Column:
    """Largest sharpness among the face regions at least two pixels wide and high.

    ``regions`` is an array of structs (x, y, w, h relative, sharpness); the sharpness of
    a region is measured by the image job. Without a usable region: the whole-frame value.
    """

    def side(low: Column, extent: Column, length: Column) -> Column:
        first = F.greatest(F.lit(0.0), F.rint(low * length))
        return F.least(length, F.rint((low + extent) * length)) - first

    big = F.filter(
        col(regions),
        lambda r: (side(r["x"], r["w"], width) >= 2) & (side(r["y"], r["h"], height) >= 2),
    )
    return F.coalesce(F.array_max(F.transform(big, lambda r: r["sharpness"])), col(blur))


def is_blurry(blur: Column | str, threshold: float = BLUR_REFERENCE) -> Column:
    """Raw blur verdict. Routing goes by ``is_usable`` instead."""
    return col(blur) < threshold


def quality_tier(score: Column | str) -> Column:
    s = col(score)
    return (
        F.when(s.isNull(), F.lit(None).cast("string"))
        .when(s >= HERO, "Hero")
        .when(s >= BEST, "BestShots")
        .when(s >= REVIEW, "Review")
        .otherwise("Low")
    )


def category(best: Column, duplicate: Column, usable: Column) -> Column:
    """BestShots before Duplicates before Blurry before Review; unscored goes to Review."""
    return (
        F.when(F.coalesce(best, F.lit(False)), "BestShots")
        .when(F.coalesce(duplicate, F.lit(False)), "Duplicates")
        .when(~F.coalesce(usable, F.lit(True)), "Blurry")
        .otherwise("Review")
    )
