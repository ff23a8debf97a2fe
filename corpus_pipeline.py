"""From raw documents to packed bins. Each stage works on all rows its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from frameloom.llm import jaccard, lines, packing, queries, secret_scan, toxicity
from frameloom.llm.store import stored

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects (a score of 0.5 or more) go; it learns from labels that are not held out."""
    model = toxicity.fit_on(docs, queries.table(spark, sf_dir, "labels"))
    return docs.select(*COLUMNS).where(toxicity.score_column(model, F.col("text")) < 0.5)


def drop_boilerplate_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines on more than 8 % of the different texts of their source go; every document stays."""
    done = lines.drop_boilerplate(docs.select(*COLUMNS), "doc_id", "source", "text", distinct=True)
    return done.select(
        "row.doc_id", F.col("kept").alias("text"), "row.lang", "row.source",
        F.when(F.col("n_dropped") > 0, F.length("kept")).otherwise(F.col("row.n_chars")).cast("long").alias("n_chars"),
    )


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by five-word shingles (Jaccard 0.75 or more) the smallest doc_id stays.

    Rows of that id stay once for each different text; of equal ones the smallest (source, lang, n_chars). Rows without an id all stay.
    """
    docs = docs.select(*COLUMNS)
    found = jaccard.jaccard_components(docs)
    gone = found.where("doc_id != component_id").select("doc_id").distinct()
    kept = docs.where("doc_id IS NOT NULL").join(gone, "doc_id", "left_anti").groupBy("doc_id", "text")
    kept = kept.agg(F.min(F.struct("source", "lang", "n_chars")).alias("first"))
    return kept.select("doc_id", "text", "first.lang", "first.source", "first.n_chars").unionAll(docs.where("doc_id IS NULL"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets become ``[secret]``; every document stays."""
    field = secret_scan.fit_on(docs)
    masked = docs.select(*COLUMNS).withColumn("clean", secret_scan.masked_column(field, F.col("text")))
    changed = ~F.col("clean").eqNullSafe(F.col("text"))
    return masked.select(
        "doc_id", F.col("clean").alias("text"), "lang", "source",
        F.when(changed, F.length("clean")).otherwise(F.col("n_chars")).cast("long").alias("n_chars"),
    )


def pack_bins(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bins of 2,048 words, no two documents of a source or of equal texts together."""
    return packing.pack(
        docs.select("doc_id", "source", queries.word_count("text").alias("length"), queries.cluster_key("text").alias("cluster"))
    )


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_boilerplate_lines),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("secret_scan", mask_secrets),
    ("best_fit_packing", pack_bins),
]

#: Scores and packing are not expressible in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is a table in the shared folder."""
    docs = queries.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
