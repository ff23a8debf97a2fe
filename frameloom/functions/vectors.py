"""Vector columns: arrays of numbers, computed in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from frameloom.functions.scalar import col, let


def as_double(v: Column | str) -> Column:
    return F.transform(col(v), lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column | str) -> Column:
    return let(as_double(v), lambda d: F.sqrt(dot(d, d)))


def unit(v: Column | str) -> Column:
    """Unit vector; a zero vector stays zero. The length is computed once per row."""

    def scaled(s: Column) -> Column:
        return F.when(s["n"] == 0, s["d"]).otherwise(F.transform(s["d"], lambda x: x / s["n"]))

    return let(
        let(as_double(v), lambda d: F.struct(d.alias("d"), F.sqrt(dot(d, d)).alias("n"))), scaled
    )


def cosine_distance(a: Column, b: Column) -> Column:
    """Distance of two unit vectors."""
    return 1.0 - dot(a, b)


def median_hash(v: Column | str, bits: int = 64) -> Column:
    """Bit i is set when element i lies above the median of the vector.

    With an even length that is the upper half, so no average of floats is needed. Bit 63 is
    the sign of the number.
    """
    vec = col(v)
    # Even length: the middle pair straddles the median. Odd: the middle element is it.
    middle = F.floor((F.size(vec) + 1) / 2).cast("int")

    def packed(edge: Column) -> Column:
        flags = F.transform(F.slice(vec, 1, bits), lambda x: (x > edge).cast("long"))
        return F.aggregate(
            F.reverse(flags), F.lit(0).cast("long"), lambda acc, bit: F.shiftleft(acc, 1).bitwiseOR(bit)
        )

    return let(F.element_at(F.sort_array(vec), middle), packed)


# Distance limits of the known embedding models.
THRESHOLDS = {"arcface": 0.55, "insightface": 0.55, "buffalo_l": 0.55, "sface": 0.40}
DEFAULT_THRESHOLD = 0.55


def threshold_for(model: Column | str) -> Column:
    """Distance limit for a model name; unknown names get the default."""
    name = F.lower(F.trim(col(model)))
    table = F.create_map(*[F.lit(x) for pair in THRESHOLDS.items() for x in pair])
    return F.coalesce(table[name], F.lit(DEFAULT_THRESHOLD))
