"""The numbered queries over the given tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from frameloom.llm import (
    fingerprints, importance, jaccard, licences, lines, near_vectors, packing, personal, pieces, prefix_trie, repeats,
    secret_scan, toxicity,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


#: What is no text in a page, and the tags that end a line of it.
NO_TEXT = "(?s)<script.*?</script>|<style.*?</style>|<!--.*?-->"
TAG = "<[^>]*>"


@query(
    "op1_line_dedup",
    f"""
WITH page AS (
  SELECT page_id, coalesce(regexp_extract(url, '^[a-zA-Z]+://([^/?#]*)', 1), '') AS host,
    [trim(x, ' ' || chr(9) || chr(13)) FOR x IN string_split(regexp_replace(regexp_replace(coalesce(html, ''), '{NO_TEXT}', '', 'g'), '{TAG}', chr(10), 'g'), chr(10))] AS lines
  FROM pages),
line AS (SELECT host, page_id, unnest(list_distinct([x FOR x IN lines IF x <> ''])) AS line FROM page),
often AS (SELECT host, line, count(*) AS n FROM line GROUP BY ALL HAVING count(*) >= {lines.MIN_PAGES}),
total AS (SELECT host, count(*) AS total FROM page GROUP BY host),
bad AS (SELECT host, list(line) AS bad FROM often JOIN total USING (host) WHERE n > {lines.RATIO} * total GROUP BY host),
raw AS (
  SELECT page_id, string_split(regexp_replace(regexp_replace(coalesce(html, ''), '{NO_TEXT}', '', 'g'), '{TAG}', chr(10), 'g'), chr(10)) AS raw
  FROM pages),
done AS (
  SELECT page_id, host, len([x FOR x IN lines IF x <> '']) AS n_lines,
    len([x FOR x IN lines IF x <> '' AND list_contains(coalesce(bad, []), x)]) AS n_dropped,
    array_to_string([x FOR x IN raw IF NOT (trim(x, ' ' || chr(9) || chr(13)) <> '' AND list_contains(coalesce(bad, []), trim(x, ' ' || chr(9) || chr(13))))], chr(10)) AS kept
  FROM page JOIN raw USING (page_id) LEFT JOIN bad USING (host))
SELECT page_id, host, n_lines::BIGINT AS n_lines, n_dropped::BIGINT AS n_dropped, sha256(kept) AS kept_sha256 FROM done""",
)
def op1_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Boilerplate lines of every page, by the share of the host's pages that hold them."""
    pages = table(spark, folder, "pages").select(
        "page_id", F.coalesce(F.regexp_extract("url", "^[a-zA-Z]+://([^/?#]*)", 1), F.lit("")).alias("host"),
        F.regexp_replace(F.regexp_replace(F.coalesce("html", F.lit("")), NO_TEXT, ""), TAG, "\n").alias("text"),
    )
    done = lines.drop_boilerplate(pages, "page_id", "host", "text")
    return done.select("row.page_id", "host", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


@query("op2_embedding_near_dedup")
def op2_embedding_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Every vector with its links (cosine 0.98 or more, equal labels) and its component."""
    return near_vectors.near_vectors(table(spark, folder, "embeddings"))


def word_count(text: str):
    """Words between white space."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def cluster_key(text: str):
    """Texts that differ in letter case and white space only are duplicates of one cluster."""
    return F.md5(F.regexp_replace(F.lower(F.trim(F.coalesce(text, F.lit("")))), r"\s+", " "))


@query("op3_best_fit_packing")
def op3_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Every document into bins of 2,048 words, no two of a source or of equal texts together."""
    docs = table(spark, folder, "documents").select(
        "doc_id", "source", word_count("text").alias("length"), cluster_key("text").alias("cluster")
    )
    return packing.pack(docs)


@query("op4_ngram_jaccard_join")
def op4_ngram_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with the size of its shingle set and its near-duplicate component."""
    return jaccard.jaccard_components(table(spark, folder, "documents"))


@query("op5_secret_scan")
def op5_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Spans of secrets in every document."""
    found = secret_scan.find_secrets(table(spark, folder, "documents").select("doc_id", "text"))
    count = lambda *kinds: F.size(F.filter("spans", lambda s: s["kind"].isin(*kinds))).cast("long")
    return found.select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(secret_scan.listed(F.filter("spans", lambda s: s["kind"] != "crf")), 256).alias("base_sha256"),
        secret_scan.listed(F.col("spans")).alias("spans"), count("crf").alias("n_added"),
    )


@query("op6_document_fingerprints")
def op6_document_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    """Multiset fingerprints of every document and of its edited text, and their likeness."""
    return fingerprints.fingerprints(table(spark, folder, "documents"))


@query("op7_suffix_array_dedup")
def op7_suffix_array_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Every passage of 50 words or more that stands in another document too."""
    return repeats.repeats(table(spark, folder, "documents"))


@query("op8_licence_scan", licences.oracle())
def op8_licence_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Licence phrases and texts in every document."""
    return licences.licences(table(spark, folder, "documents"))


@query("op9_sentencepiece")
def op9_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    """Every document in pieces with merge-dropout (0.1, seed 1), and whether they decode to the text."""
    told = pieces.round_trip_column(pieces.read_model(), F.col("text"), pieces.DROPOUT, seed=1)
    coded = table(spark, folder, "documents").select("doc_id", "text", told.alias("told"))
    return coded.select(
        "doc_id", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_chars"),
        F.coalesce(F.size("told.ids"), F.lit(0)).cast("long").alias("n_pieces"), F.hex(F.xxhash64("told.ids")).alias("ids_hash"),
        "told.lossless",
    )


@query("op10_toxicity")
def op10_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's score, from labels that are not held out."""
    scored = toxicity.toxicity(table(spark, folder, "documents").select("doc_id", "text"), table(spark, folder, "labels"))
    return scored.select(
        "doc_id", toxicity.held_out("doc_id").alias("held_out"), F.col("toxicity").alias("score"),
        (F.col("toxicity") >= 0.5).cast("int").alias("predicted"),
    )


@query("op11_importance_resampling", importance.oracle())
def op11_importance_resampling(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's weight towards the benchmark's words, its score and its rank in the draw of a tenth."""
    return importance.resampled(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query("op12_personal_data", personal.oracle())
def op12_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    """Mail addresses, network addresses, card and phone numbers of every document, and account, call and social security numbers."""
    return personal.personal(table(spark, folder, "documents"))


@query("op13_prefix_trie", prefix_trie.oracle())
def op13_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    """Every node of the prefix trie of the rebuilt conversations."""
    return prefix_trie.prefix_trie(table(spark, folder, "conversations"))
