"""Licence scan by diagonal voting, in DataFrame operations only.

Every rolling three-word hash of a text meets the positions it has in the templates. A hit votes for the
diagonal (position in the text minus position in the template); neighbouring diagonals of a template, as
an inserted or missing word makes them, are merged; then spans are verified: the words of a phrase must stand
there exactly, of a longer template a share of its three-word runs must.

The template table is fixed by this module, so it may be broadcast. The only grouping is by document and
template; a phrase that a third of all documents hold makes no large group.

Defined cases: a null or empty text has no words and no labels; texts with fewer than three words match
nothing; repeated rows fare alike; a null id is an id; other columns are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

GRAM = 3
#: Diagonals this close are one span.
NEAR = 2
#: Share of the runs of a longer template that verifies it.
COVERAGE = 0.6
# fixed values
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
OWN = (
    ("permission is hereby granted free of charge to any person obtaining a copy of this software", "mit"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("licensed under the apache license version 2 0 the license", "apache-2"),
    ("licensed under the gnu general public license", "gpl"),
    ("all rights reserved", "all-rights-reserved"),
    ("gnu general public license as published by the free software foundation", "gpl"),
    ("gnu lesser general public license as published by the free software foundation", "lgpl"),
    ("subject to the terms of the mozilla public license v 2 0", "mpl-2"),
    ("this work is licensed under a creative commons attribution", "cc"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
)
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: str) -> Column:
    """Lower-cased runs of digits, ASCII letters and non-ASCII characters.

    ``lower`` changes other letters too, which can make no difference to a comparison with ASCII words,
    except for the two characters whose lower case is or begins with an ASCII letter.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    odd = whole.contains("\u212a") | whole.contains("\u0130")
    low = F.when(odd, F.translate(whole, _UPPER, _LOWER)).otherwise(F.lower(whole))
    return F.array_remove(F.split(low, BETWEEN), "")


def _gram(at: Column) -> Column:
    return F.xxhash64(*(F.get("words", at + k) for k in range(GRAM)))


def templates(spark: SparkSession) -> DataFrame:
    """(template, label, base, phrase, at, gram): every three-word run of the fixed templates."""
    rows = [(n, label, n < len(BASE), text.split()) for n, (text, label) in enumerate(BASE + OWN)]
    df = spark.createDataFrame(rows, "template int, label string, base boolean, phrase array<string>")
    df = df.withColumn("words", F.col("phrase")).withColumn("at", F.explode(F.sequence(F.lit(0), F.size("phrase") - GRAM)))
    return df.withColumn("gram", _gram(F.col("at"))).drop("words")


def licence_spans(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """Verified and unverified spans: (doc, tag, template, label, base, start, stop, coverage, verified)."""
    known = templates(docs.sparkSession)
    grams = [r[0] for r in known.select("gram").distinct().collect()]  # a fixed, short list
    told = docs.select(F.col(doc).alias("doc"), F.xxhash64(text).alias("tag"), words(text).alias("words"))
    longest = max(len(text.split()) for text, _ in BASE)

    def found(word: Column, at: Column) -> Column:
        # a hit takes along the words that a phrase around it can have, not those of the whole text
        low = F.greatest(at - (longest - GRAM), F.lit(0))
        near = F.transform(F.sequence(low, at + longest - 1), lambda k: F.get("words", k))
        return F.when(_gram(at).isin(grams), F.struct(at.alias("pos"), _gram(at).alias("gram"), low.alias("low"), near.alias("near")))

    hits = told.select("doc", "tag", F.explode(F.array_compact(F.transform("words", found))).alias("hit")).select("doc", "tag", "hit.*")
    met = hits.join(F.broadcast(known), "gram")
    start = F.col("pos") - F.col("at")
    exact = F.col("base") & (start >= 0) & (F.slice("near", F.greatest(start - F.col("low"), F.lit(0)) + 1, F.size("phrase")) == F.col("phrase"))
    votes = met.withColumn("exact", exact).groupBy("doc", "tag", "template", start.alias("diagonal")).agg(
        F.first("label").alias("label"), F.first("base").alias("base"), F.first(F.size("phrase")).alias("length"),
        F.max("exact").alias("exact"), F.collect_set("at").alias("runs"), F.min("pos").alias("low"), F.max("pos").alias("high"),
    )
    order = Window.partitionBy("doc", "tag", "template").orderBy("diagonal")
    far = F.col("diagonal") - F.lag("diagonal").over(order) > NEAR
    # phrases are verified on one diagonal; only longer templates merge
    opens = F.when(far | F.col("base") | F.lag("diagonal").over(order).isNull(), 1).otherwise(0)
    spans = votes.withColumn("span", F.sum(opens).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    merged = spans.groupBy("doc", "tag", "template", "span").agg(
        F.first("label").alias("label"), F.first("base").alias("base"), F.max("exact").alias("exact"),
        F.min("low").alias("start"), (F.max("high") + GRAM).alias("stop"),
        (F.size(F.array_distinct(F.flatten(F.collect_list("runs")))) / (F.first("length") - GRAM + 1)).alias("coverage"),
    )
    return merged.withColumn("verified", F.when(F.col("base"), F.col("exact")).otherwise(F.col("coverage") >= COVERAGE))


def licences(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: n_words, n_base, first_word, last_word, base_labels, labels, score."""
    spans = licence_spans(docs, doc, text)
    base = F.col("base") & F.col("verified")
    joined = lambda c: F.array_join(F.sort_array(F.collect_set(c)), ",")
    per_doc = spans.groupBy(F.col("doc").alias("d"), F.col("tag").alias("t")).agg(
        F.count(F.when(base, 1)).alias("n_base"), F.min(F.when(base, F.col("start"))).cast("long").alias("first_word"),
        F.max(F.when(base, F.col("start"))).cast("long").alias("last_word"), joined(F.when(base, F.col("label"))).alias("base_labels"),
        joined(F.when(F.col("verified"), F.col("label"))).alias("labels"),
        F.max(F.when(F.col("base") & ~F.col("verified"), F.lit(0.0)).otherwise(F.col("coverage"))).alias("score"),
    )
    sizes = docs.select(F.col(doc).alias("doc_id"), F.xxhash64(text).alias("tag"), F.size(words(text)).cast("long").alias("n_words"))
    return sizes.join(per_doc, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("tag") == F.col("t")), "left").select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )


def _values() -> str:
    return ",\n".join(
        f"({n}, '{label}', {str(n < len(BASE)).lower()}, {text.split()!r})" for n, (text, label) in enumerate(BASE + OWN)
    )


def oracle() -> str:
    """The same scan in SQL."""
    run = reduce(lambda s, k: f"{s} AND word.w{k} = gram.w{k}", range(1, GRAM), "word.w0 = gram.w0")
    return f"""
WITH template(template, label, base, phrase) AS (VALUES {_values()}),
gram AS (
  SELECT template, label, base, phrase, k - 1 AS spot, phrase[k] AS w0, phrase[k + 1] AS w1, phrase[k + 2] AS w2
  FROM (SELECT *, unnest(range(1, len(phrase) - {GRAM} + 2)) AS k FROM template)),
doc AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS words
  FROM documents),
place AS (SELECT doc_id, words, unnest(range(1, len(words) - {GRAM} + 2)) AS k FROM doc),
word AS (SELECT doc_id, k - 1 AS pos, words[k] AS w0, words[k + 1] AS w1, words[k + 2] AS w2 FROM place),
vote AS (
  SELECT doc_id, template, any_value(label) AS label, any_value(base) AS base, any_value(len(phrase)) AS length, pos - spot AS diagonal,
    list(DISTINCT spot) AS runs, min(pos) AS low
  FROM word JOIN gram ON {run} GROUP BY doc_id, template, pos - spot),
marked AS (
  SELECT *, CASE WHEN base OR lag(diagonal) OVER o IS NULL OR diagonal - lag(diagonal) OVER o > {NEAR} THEN 1 ELSE 0 END AS opens
  FROM vote WINDOW o AS (PARTITION BY doc_id, template ORDER BY diagonal)),
spanned AS (SELECT *, sum(opens) OVER (PARTITION BY doc_id, template ORDER BY diagonal) AS span FROM marked),
merged AS (
  SELECT doc_id, template, span, any_value(label) AS label, any_value(base) AS base, min(low) AS start,
    len(list_distinct(flatten(list(runs)))) / (any_value(length) - {GRAM} + 1)::DOUBLE AS coverage
  FROM spanned GROUP BY ALL),
seen AS (SELECT *, CASE WHEN base THEN coverage = 1 ELSE coverage >= {COVERAGE} END AS verified FROM merged),
per AS (
  SELECT doc_id, count(*) FILTER (WHERE base AND verified) AS n_base, min(start) FILTER (WHERE base AND verified) AS first_word,
    max(start) FILTER (WHERE base AND verified) AS last_word,
    coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE base AND verified), '') AS base_labels,
    coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE verified), '') AS labels,
    max(CASE WHEN base AND NOT verified THEN 0.0 ELSE coverage END)::DOUBLE AS score
  FROM seen GROUP BY doc_id)
SELECT doc_id, len(words) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels,
  coalesce(labels, '') AS labels, coalesce(score, 0.0)::DOUBLE AS score
FROM doc LEFT JOIN per USING (doc_id)"""
