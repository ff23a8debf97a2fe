"""Parsing the JSON answers of a vision model."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from frameloom.functions.scalar import col

DEFAULT_CONFIDENCE = 0.8
MAX_COLOURS = 3
ANSWER = (
    "struct<scene_labels:array<string>,scene_confidence:array<double>,"
    "dominant_colors:array<struct<r:double,g:double,b:double>>,face_count:double>"
)


def parse_vision_json(text: Column | str) -> Column:
    """struct(labels, confidences, colours, face_count); an unreadable answer gives empty arrays.

    A code fence around the JSON is removed. Labels are trimmed and lower-cased, confidences padded
    with 0.8 or cut to the labels, the first three colours rounded.
    """
    bare = F.trim(col(text), F.lit(" \t\r\n"))
    inner = F.regexp_replace(F.regexp_replace(bare, r"^```[^\n]*\n?", ""), r"\n?[ \t]*```[ \t]*$", "")
    body = F.when(bare.startswith("```"), inner).otherwise(bare)
    data = F.from_json(body, ANSWER, {"mode": "PERMISSIVE"})
    no_text, no_numbers = F.array().cast("array<string>"), F.array().cast("array<double>")
    labels = F.transform(F.coalesce(data["scene_labels"], no_text), lambda t: F.lower(F.trim(t)))
    given = F.coalesce(data["scene_confidence"], no_numbers)
    n, m = F.size(labels), F.size(given)
    filled = F.when(m >= n, F.slice(given, F.lit(1), n)).otherwise(
        F.concat(given, F.array_repeat(F.lit(DEFAULT_CONFIDENCE), n - m))
    )
    whole = lambda v: F.rint(F.coalesce(v, F.lit(0.0))).cast("int")
    found = F.filter(
        F.coalesce(data["dominant_colors"], F.array().cast("array<struct<r:double,g:double,b:double>>")),
        lambda c: c.isNotNull(),
    )
    colours = F.transform(
        F.slice(found, 1, MAX_COLOURS),
        lambda c: F.struct(whole(c["r"]).alias("r"), whole(c["g"]).alias("g"), whole(c["b"]).alias("b")),
    )
    faces = F.coalesce(data["face_count"], F.lit(0.0)).cast("int")
    return F.struct(labels.alias("labels"), filled.alias("confidences"), colours.alias("colours"), faces.alias("face_count"))
