"""Naming events from scene labels and mood colours."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frameloom.functions.colour import colour_event, colour_event_name, loose_event_name
from frameloom.functions.scalar import any_of, let
from frameloom.operators.ordered import OrderedGroups

# The keyword vocabulary of each event.
EVENT_KEYWORDS = {
    "Haldi": ("haldi", "turmeric", "marigold", "yellow", "floral", "flower", "yellow saree", "ritual bath"),
    "Mehndi": ("mehndi", "henna", "mehendi", "hand", "intricate pattern"),
    "Baraat": (
        "baraat", "horse", "procession", "parade", "band", "dhol", "drum", "folk music",
        "street celebration", "groom entry",
    ),
    "Reception": (
        "reception", "dance", "stage", "cake", "banquet", "party", "disco", "nightclub", "sangeet",
        "dance floor", "celebration", "ballroom", "entertainment", "performance",
    ),
    "Ceremony": (
        "mandap", "priest", "ritual", "altar", "ceremony", "temple", "fire", "wedding ceremony", "sacred",
        "rite", "wedding ritual", "pheras", "vows", "garland", "wedding canopy",
    ),
    "Portraits": (
        "bride", "groom", "couple", "ring", "portrait", "gown", "wedding dress", "wedding photo",
        "wedding portrait", "pre-wedding", "bridal", "groomsmen", "bridesmaid", "wedding couple",
    ),
}
MIN_LABEL_SCORE = 0.25
MIN_GROUP_CONFIDENCE = 0.3
NEUTRAL = (210, 210, 210)
SAMPLE = 8
MIN_SATURATION, MIN_VALUE, MIN_COLOURFUL = 0.25, 0.20, 0.04


def label_votes(df: DataFrame, keys: Sequence[str], labels: str, confidences: str | None = None) -> DataFrame:
    """(keys, event, score) of the best event per row; rows without any match are absent.

    A label counts for every event one of whose keywords it contains; a missing confidence
    is 1. Ties go to the event seen first, then to vocabulary order. Labels are exploded and
    summed with map-side combine, so a row may have any number of them.
    """
    keys = list(keys)
    zipped = F.arrays_zip(F.col(labels).alias("t"), F.col(confidences).alias("c")) if confidences else F.transform(
        F.col(labels), lambda t: F.struct(t.alias("t"), F.lit(None).cast("double").alias("c"))
    )
    # Where there are more confidences than labels, the rest has no label and matches nothing.
    each = df.select(*keys, zipped.alias("__z")).select(*keys, F.posexplode("__z").alias("__at", "__z")).select(
        *keys, "__at", F.lower(F.col("__z.t")).alias("__t"), F.coalesce(F.col("__z.c"), F.lit(1.0)).alias("__c")
    )
    sums, order = [], []
    for n, (event, words) in enumerate(EVENT_KEYWORDS.items()):
        # A keyword that contains another one adds nothing.
        needed = [k for k in words if not any(o != k and o in k for o in words)]
        hit = any_of([F.col("__t").contains(k) for k in needed])
        sums += [
            F.sum(F.when(hit, F.col("__c"))).alias(f"__s{n}"),
            F.min(F.when(hit, F.col("__at"))).alias(f"__f{n}"),
        ]
        order.append(
            F.when(
                F.col(f"__f{n}").isNotNull(),
                F.struct(F.col(f"__s{n}").alias("score"), (-F.col(f"__f{n}")).alias("seen"), F.lit(-n).alias("ord"), F.lit(event).alias("event")),
            )
        )
    tallied = each.groupBy(*keys).agg(*sums).select(*keys, F.greatest(*order).alias("__best"))
    return tallied.filter(F.col("__best").isNotNull()).select(
        *keys, F.col("__best.event").alias("event"), F.col("__best.score").alias("score")
    )


def photo_event(event: Column, score: Column, colours: Column, minimum: float = MIN_LABEL_SCORE) -> Column:
    """struct(event, confidence, source): labels if they decide, else first colour, else nothing."""

    def result(event: Column, confidence: Column, source: str) -> Column:
        return F.struct(event.alias("event"), confidence.alias("confidence"), F.lit(source).alias("source"))

    def by_colour(first: Column) -> Column:
        return let(colour_event(first["r"], first["g"], first["b"]), lambda e: result(e["event"], e["confidence"], "color"))

    first = F.get(colours, F.lit(0))
    return (
        F.when(score >= minimum, result(event, F.least(F.lit(1.0), score / 2.0), "labels"))
        .when(first.isNotNull(), let(first, by_colour))
        .otherwise(result(F.lit("Ceremony"), F.lit(0.0), "unknown"))
    )


def group_event(df: DataFrame, by: Sequence[str], event: str, confidence: str, source: str, order: str) -> DataFrame:
    """(by, event, confidence, source): the event with the largest summed confidence.

    Two aggregations with map-side combine: per event, then per group. Ties go to the event
    whose first photo comes first in ``order``.
    """
    by = list(by)
    counted = F.col(confidence) > 0
    tally = df.groupBy(*by, event).agg(
        F.coalesce(F.sum(F.when(counted, F.col(confidence))), F.lit(0.0)).alias("__sum"),
        F.min(F.when(counted, F.col(order))).alias("__first"),
        F.count(F.lit(1)).alias("__n"),
        F.max(F.when(counted & (F.col(source) == "labels"), 2).when(counted, 1).otherwise(0)).alias("__src"),
    )
    best = F.min_by(F.struct(F.col(event).alias("e"), F.col("__sum").alias("s")), F.struct(-F.col("__sum"), F.col("__first")))
    won = F.max("__sum") > 0
    return tally.groupBy(*by).agg(
        F.when(won, best["e"]).otherwise("Ceremony").alias("event"),
        F.when(won, F.least(F.lit(1.0), best["s"] / F.sum("__n"))).otherwise(0.0).alias("confidence"),
        F.when(F.max("__src") == 2, "labels").when(F.max("__src") == 1, "color").otherwise("unknown").alias("source"),
    )


def event_name(vote_event: Column, vote_confidence: Column, r: Column, g: Column, b: Column, index: Column) -> Column:
    """Group vote, else telling colour, else the loose colour rule, else a number."""
    return F.coalesce(
        F.when(vote_confidence > MIN_GROUP_CONFIDENCE, vote_event),
        colour_event_name(colour_event(r, g, b)),
        loose_event_name(r, g, b),
        F.concat(F.lit("Event "), (index + 1).cast("string")),
    )


def even_sample(df: DataFrame, by: Sequence[str], order: list[Column], count: int = SAMPLE) -> DataFrame:
    """Up to ``count`` rows per group, evenly spaced in ``order``."""
    by = list(by)
    sizes = df.groupBy(*by).agg(F.count(F.lit(1)).alias("__n"))
    placed = OrderedGroups(df, by, order).position("__pos").df.join(sizes, by)
    # Row p is taken when some i has int(i * n / count) = p.
    first = F.ceil(F.col("__pos") * count / F.col("__n"))
    tries = [F.floor(i * (F.col("__n") / count)) == F.col("__pos") for i in (first - 1, first, first + 1)]
    ok = any_of([t & (i >= 0) & (i < count) for t, i in zip(tries, (first - 1, first, first + 1))])
    return placed.filter((F.col("__n") <= count) | ok).drop("__n", "__pos")


def dominant_colour(pixels: DataFrame, by: Sequence[str], weight: str | None = None) -> DataFrame:
    """(by, r, g, b): mean of the colourful pixels if there are enough, else of all.

    ``pixels`` has columns r, g, b and optionally a count per row; it is reduced on the map side.
    """
    n = F.lit(1) if weight is None else F.col(weight)
    top, low = F.greatest("r", "g", "b"), F.least("r", "g", "b")
    colourful = (F.when(top > 0, (top - low) / top).otherwise(0.0) > MIN_SATURATION) & (top / 255.0 > MIN_VALUE)
    sums = [F.sum(n).alias("n"), F.sum(F.when(colourful, n).otherwise(0)).alias("cn")]
    for c in ("r", "g", "b"):
        sums += [F.sum(F.col(c) * n).alias(f"{c}_all"), F.sum(F.when(colourful, F.col(c) * n)).alias(f"{c}_col")]
    enough = (F.col("cn") > 0) & (F.col("cn") >= F.col("n") * MIN_COLOURFUL)
    return pixels.groupBy(*by).agg(*sums).select(
        *by,
        *[
            F.when(enough, F.rint(F.col(f"{c}_col") / F.col("cn"))).otherwise(F.rint(F.col(f"{c}_all") / F.col("n"))).cast("int").alias(c)
            for c in ("r", "g", "b")
        ],
    )


def or_neutral(groups: DataFrame, colours: DataFrame, by: Sequence[str]) -> DataFrame:
    """A colour for every group; neutral grey where no pixel was readable."""
    by = list(by)
    filled = {c: F.coalesce(F.col(c), F.lit(v)) for c, v in zip(("r", "g", "b"), NEUTRAL)}
    return groups.select(*by).distinct().join(colours, by, "left").withColumns(filled)
