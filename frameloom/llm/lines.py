"""Line dedup by site-relative frequency: a line on too large a share of a host's pages is boilerplate.

Defined cases: a null host is a host of its own (the empty name, which it shares); a null text has no
lines and stays null; blank lines are never dropped; lines are compared without the blanks around them
(space, tab, carriage return); a line counts once per page however often it stands there; repeated
rows count as pages of their own and fare alike; other columns pass through untouched. With ``distinct``
equal texts of a host count as one page, so that copies of a page do not make its lines boilerplate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A line is dropped if it stands on more than this share of the pages of its host ...
RATIO = 0.08
#: ... and on at least this many of them.
MIN_PAGES = 5


def _hash(line: Column) -> Column:
    return F.xxhash64(F.btrim(line, F.lit(" \t\r")))


def _blank(line: Column) -> Column:
    return F.btrim(line, F.lit(" \t\r")) == ""


def boilerplate(
    pages: DataFrame, host: str, lines: str, ratio: float = RATIO, min_pages: int = MIN_PAGES, text_tag: str | None = None
) -> DataFrame:
    """(host, line) hashes above the ratio. Counts are summed on the map side, so a hot host does no harm.

    ``text_tag`` names a hash of host and text: rows that agree in it count as one page.
    """
    tag = [] if text_tag is None else [F.col(text_tag).alias("tag")]
    told = pages.select(
        F.col(host).alias("host"), *tag,
        F.explode(F.array_distinct(F.transform(F.filter(lines, lambda x: ~_blank(x)), _hash))).alias("line"),
    )
    seen = pages.select(F.col(host).alias("host"), *tag)
    if tag:
        told, seen = told.distinct(), seen.distinct()
    often = told.groupBy("host", "line").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages)
    total = seen.groupBy("host").agg(F.count("*").alias("total"))
    return often.join(total, "host").where(F.col("n") > F.lit(ratio) * F.col("total")).select("host", "line")


def drop_boilerplate(
    df: DataFrame, key: str, host: str, text: str, ratio: float = RATIO, min_pages: int = MIN_PAGES, distinct: bool = False
) -> DataFrame:
    """``df`` as one struct column ``row``, with ``kept`` (the text without boilerplate lines), ``n_lines``
    (not blank) and ``n_dropped``.

    Only hashes are exploded; the texts move once, to meet the list of their own dropped lines.
    """
    pages = df.select(
        F.struct("*").alias("row"), F.col(key).alias("key"), F.xxhash64(host, text).alias("tag"),
        F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host"), F.split(F.coalesce(text, F.lit("")), "\n").alias("lines"),
    )
    told = pages.select("key", "tag", "host", F.explode(F.array_distinct(F.transform(F.filter("lines", lambda x: ~_blank(x)), _hash))).alias("line"))
    found = told.join(boilerplate(pages, "host", "lines", ratio, min_pages, "tag" if distinct else None), ["host", "line"], "left_semi")
    per_page = found.groupBy(F.col("key").alias("k"), F.col("tag").alias("t")).agg(F.collect_set("line").alias("bad"))
    # the lines are cut anew after the join, so that texts move once
    met = pages.drop("lines").join(per_page, F.col("key").eqNullSafe(F.col("k")) & (F.col("tag") == F.col("t")), "left")
    met = met.withColumn("lines", F.split(F.coalesce(F.col(f"row.`{text}`"), F.lit("")), "\n"))
    gone = lambda x: ~_blank(x) & F.array_contains("bad", _hash(x))
    kept = F.when(F.col("bad").isNull(), F.col(f"row.`{text}`")).otherwise(F.array_join(F.filter("lines", lambda x: ~gone(x)), "\n"))
    return met.select(
        "row", "host", kept.alias("kept"), F.size(F.filter("lines", lambda x: ~_blank(x))).cast("long").alias("n_lines"),
        F.when(F.col("bad").isNull(), 0).otherwise(F.size(F.filter("lines", gone))).cast("long").alias("n_dropped"),
    )
