"""The given tables seen as photos, faces, albums, licences and ledgers: in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from frameloom.functions.boxes import box
from frameloom.functions.quality import is_usable, quality_score
from frameloom.operators.duplicates import rerank
from frameloom.operators.selection import inventory
from frameloom.plans.registry import dealt, table

# -- photos: one line item is one photo ------------------------------------------- #
MEDIA = """media AS (SELECT concat('s', l_suppkey, '/', l_orderkey, '-', l_linenumber, '-', l_partkey, '-',
    CAST(round(l_extendedprice * 100) AS BIGINT), '.jpg') AS path,
  l_suppkey AS project, concat(l_suppkey, ':', l_partkey % 500) AS dup_group,
  l_extendedprice / 100 AS blur_score, l_quantity * 5 AS brightness, l_discount * 640 AS contrast,
  l_returnflag = 'R' AS faces_detected,
  CASE WHEN l_returnflag = 'R' THEN l_linenumber ELSE 0 END AS face_count,
  l_shipdate AS captured_at, l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice,
  l_discount, l_tax, l_returnflag, l_linestatus FROM lineitem)"""


def media(spark: SparkSession, d: str) -> DataFrame:
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    rows = dealt(table(spark, d, "lineitem"), "l_orderkey", "l_linenumber", "l_partkey")
    return rows.withColumns(
        {
            "path": F.concat(
                F.lit("s"), "l_suppkey", F.lit("/"), "l_orderkey", F.lit("-"), "l_linenumber", F.lit("-"),
                "l_partkey", F.lit("-"), cents, F.lit(".jpg"),
            ),
            "project": F.col("l_suppkey"),
            "dup_group": F.concat("l_suppkey", F.lit(":"), (F.col("l_partkey") % 500).cast("string")),
            "blur_score": F.col("l_extendedprice") / 100,
            "brightness": F.col("l_quantity") * 5,
            "contrast": F.col("l_discount") * 640,
            "faces_detected": F.col("l_returnflag") == "R",
            "face_count": F.when(F.col("l_returnflag") == "R", F.col("l_linenumber")).otherwise(0),
            "captured_at": F.col("l_shipdate"),
        }
    )


SCORE_SQL = """round(least(1e0, greatest(0e0, ((CASE WHEN {sharp} <= 0 THEN 0e0 ELSE {sharp} / ({sharp} + 100e0) END) * 5e-1
    + ((least(1e0, greatest(0e0, 1e0 - abs(brightness - 127.5e0) / 127.5e0)) + least(1e0, greatest(0e0, contrast / 64e0))) * 5e-1) * 2e-1
    + (CASE WHEN {face} THEN 1e0 ELSE 0e0 END) * {wf}) / (({wf} + 5e-1) + 2e-1))) * 100e0, 2)"""


def score_sql(sharp: str = "blur_score", face: str = "faces_detected", wf: str = "3e-1") -> str:
    return SCORE_SQL.format(sharp=sharp, face=face, wf=wf)


USABLE_SQL = "(blur_score >= 15 AND brightness BETWEEN 12 AND 243)"
SCORED = f"scored AS (SELECT *, {score_sql()} AS quality, {USABLE_SQL} AS usable FROM media)"


def scored(spark: SparkSession, d: str) -> DataFrame:
    return media(spark, d).withColumns(
        {
            "quality": quality_score("blur_score", "brightness", "contrast", "faces_detected"),
            "usable": is_usable("blur_score", "brightness"),
        }
    )


RANKED = """ranked AS (SELECT *, row_number() OVER (PARTITION BY dup_group ORDER BY quality DESC, path) > 1 AS is_duplicate,
  first_value(path) OVER (PARTITION BY dup_group ORDER BY quality DESC, path) AS representative,
  count(*) OVER (PARTITION BY dup_group) AS group_size FROM scored)"""
TIER_SQL = "CASE WHEN quality >= 90 THEN 'Hero' WHEN quality >= 75 THEN 'BestShots' WHEN quality >= 60 THEN 'Review' ELSE 'Low' END"
RECORDS = f"""records AS (SELECT *, (NOT is_duplicate AND usable AND quality >= 75) AS is_best_shot,
  CASE WHEN NOT is_duplicate AND usable AND quality >= 75 THEN 'BestShots' WHEN is_duplicate THEN 'Duplicates'
    WHEN NOT usable THEN 'Blurry' ELSE 'Review' END AS category, {TIER_SQL} AS tier FROM ranked)"""
PHOTOS = (MEDIA, SCORED, RANKED, RECORDS)


def ranked_media(spark: SparkSession, d: str) -> DataFrame:
    return rerank(scored(spark, d), "dup_group", "path", "quality").withColumn(
        "is_duplicate", ~F.col("is_representative")
    )


def records(spark: SparkSession, d: str) -> DataFrame:
    return inventory(ranked_media(spark, d), "path", "quality", "usable", "is_duplicate")


# -- faces on photos: boxes built from the row itself -------------------------------- #
# Photos have 0..7 boxes. Some reach past the frame and every seventh has no width, on purpose.
BOXED = """boxed AS (SELECT *, 0.4e0 + (l_partkey % 50) / 25e0 AS aspect, 0.5e0 + (l_orderkey % 40) / 20e0 AS frame_aspect,
  CASE WHEN l_returnflag = 'R' THEN l_linenumber WHEN l_linestatus = 'O' THEN 1 ELSE 0 END AS n_boxes FROM media)"""
FACE_X = "((l_partkey * 7 + i * 13) % 100) / 100e0"
FACE_Y = "((l_suppkey * 11 + i * 29) % 100) / 100e0"
FACE_W = "CASE WHEN i % 7 = 0 THEN 0e0 ELSE l_quantity * (1 + i % 3) / 200e0 END"
FACE_H = "l_quantity * (1 + i % 3) / 150e0"
BOXROWS = f"""boxrows AS (SELECT *, {FACE_X} AS x, {FACE_Y} AS y, {FACE_W} AS w, {FACE_H} AS h
  FROM (SELECT *, unnest(range(1, n_boxes + 1)) AS i FROM boxed))"""
CLIPPED = """clipped AS (SELECT * FROM (SELECT * EXCLUDE (x, y, w, h), least(1e0, greatest(0e0, x)) AS x, least(1e0, greatest(0e0, y)) AS y,
  least(w, 1e0 - least(1e0, greatest(0e0, x))) AS w, least(h, 1e0 - least(1e0, greatest(0e0, y))) AS h
  FROM boxrows WHERE w > 0 AND h > 0) WHERE w > 0 AND h > 0)"""


def boxed(spark: SparkSession, d: str) -> DataFrame:
    n = F.when(F.col("l_returnflag") == "R", F.col("l_linenumber")).when(F.col("l_linestatus") == "O", 1).otherwise(0)

    def one(i):
        grow = F.col("l_quantity") * (1 + i % 3)
        return box(
            ((F.col("l_partkey") * 7 + i * 13) % 100) / 100.0,
            ((F.col("l_suppkey") * 11 + i * 29) % 100) / 100.0,
            F.when(i % 7 == 0, F.lit(0.0)).otherwise(grow / 200.0),
            grow / 150.0,
        )

    some = F.transform(F.sequence(F.lit(1), F.greatest(F.col("n_boxes"), F.lit(1))), one)
    return (
        media(spark, d)
        .withColumns(
            {
                "aspect": (F.col("l_partkey") % 50) / 25.0 + 0.4,
                "frame_aspect": (F.col("l_orderkey") % 40) / 20.0 + 0.5,
                "n_boxes": n,
            }
        )
        .withColumn("boxes", F.slice(some, F.lit(1), F.col("n_boxes")))
    )


# -- albums: one order is one photo ---------------------------------------------------- #
ALBUM = """album AS (SELECT o_orderkey AS path, o_custkey AS project, round(o_totalprice / 5000e0, 2) AS quality,
  o_orderdate AS taken, o_orderstatus AS kind, o_orderpriority AS priority,
  o_totalprice >= 375000 AS is_best_shot, (o_orderkey % 6) AS face_count, (o_orderkey % 6) > 0 AS faces_detected
  FROM orders)"""


def album(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(
        F.col("o_orderkey").alias("path"), F.col("o_custkey").alias("project"),
        F.round(F.col("o_totalprice") / 5000.0, 2).alias("quality"), F.col("o_orderdate").alias("taken"),
        F.col("o_orderstatus").alias("kind"), F.col("o_orderpriority").alias("priority"),
        (F.col("o_totalprice") >= 375000).alias("is_best_shot"), (F.col("o_orderkey") % 6).alias("face_count"),
        ((F.col("o_orderkey") % 6) > 0).alias("faces_detected"),
    )


# Labels present on each album photo, from its own key: a sorted set of up to four.
ALBUM_TOKENS = """tokens AS (SELECT *, list_sort(list_filter([
    CASE WHEN path % 2 = 0 THEN 'bride' END, CASE WHEN path % 3 = 0 THEN 'groom' END,
    CASE WHEN path % 5 = 0 THEN 'family_bride' END, CASE WHEN path % 7 = 0 THEN 'close_family' END],
    lambda t: t IS NOT NULL)) AS persons FROM album)"""


def album_tokens(spark: SparkSession, d: str) -> DataFrame:
    tests = ((2, "bride"), (3, "groom"), (5, "family_bride"), (7, "close_family"))
    names = [F.when(F.col("path") % n == 0, F.lit(t)) for n, t in tests]
    return album(spark, d).withColumn("persons", F.array_sort(F.array_compact(F.array(*names))))


# -- shots ------------------------------------------------------------------------------- #
def shots(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(
        F.col("user_id").alias("project"), F.col("event_id").alias("path"), F.col("ts").alias("captured_at")
    )


SHOTS = "shots AS (SELECT user_id AS project, event_id AS path, ts AS captured_at FROM events)"


# -- faces as vectors --------------------------------------------------------------------- #
DIM = 64
FACES = """faces AS (SELECT vec_id, vec_id // 4 AS image, label, list_transform(e, lambda x: x / sqrt(n2)) AS v
  FROM (SELECT vec_id, label, e, list_sum(list_transform(e, lambda x: x * x)) AS n2
    FROM (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)) WHERE n2 > 0)"""


def faces(spark: SparkSession, d: str, filled: bool = False) -> DataFrame:
    """``filled``: a null element counts as zero, as the sums of the SQL skip it; else its vector drops out."""
    from frameloom.operators.people import unit_vectors

    vector = F.transform("embedding", lambda x: F.coalesce(x, F.lit(0.0).cast("float"))) if filled else F.col("embedding")
    rows = table(spark, d, "embeddings").select(
        "vec_id", F.floor(F.col("vec_id") / 4).alias("image"), "label", vector.alias("v")
    )
    return unit_vectors(rows, "v")


# Sign hashes with planted near copies: each vector appears with 0..3 flipped bits.
HASHES = """hashes AS (SELECT concat('v', lpad(CAST(vec_id AS VARCHAR), 7, '0'), '-', k) AS path,
    xor(h, (CASE WHEN k = 0 THEN 0 ELSE (1::BIGINT << CAST((vec_id * 7) % 60 AS INT)) END)
       | (CASE WHEN k < 2 THEN 0 ELSE (3::BIGINT << CAST((vec_id * 11 + 3) % 60 AS INT)) END)) AS hash
  FROM (SELECT vec_id, list_reduce(list_transform(range(1, 65), lambda i:
      CASE WHEN embedding[i] <= list_sort(embedding)[32] THEN 0::BIGINT WHEN i = 64 THEN (-9223372036854775807 - 1)::BIGINT ELSE 1::BIGINT << CAST(i - 1 AS INT) END), lambda x, y: x | y) AS h FROM embeddings),
    (SELECT unnest(range(0, 3)) AS k))"""


def hashes(spark: SparkSession, d: str) -> DataFrame:
    from frameloom.functions.vectors import median_hash

    rows = table(spark, d, "embeddings").select("vec_id", median_hash("embedding").alias("h"))
    each = rows.withColumn("k", F.explode(F.lit([0, 1, 2])))
    one = F.when(F.col("k") == 0, F.lit(0).cast("long")).otherwise(
        F.call_function("shiftleft", F.lit(1).cast("long"), ((F.col("vec_id") * 7) % 60).cast("int"))
    )
    two = F.when(F.col("k") < 2, F.lit(0).cast("long")).otherwise(
        F.call_function("shiftleft", F.lit(3).cast("long"), ((F.col("vec_id") * 11 + 3) % 60).cast("int"))
    )
    return each.select(
        F.concat(F.lit("v"), F.lpad(F.col("vec_id").cast("string"), 7, "0"), F.lit("-"), F.col("k").cast("string")).alias("path"),
        F.col("h").bitwiseXOR(one.bitwiseOR(two)).alias("hash"),
    )


# -- colours ---------------------------------------------------------------------------------- #
COLOURS = "colours AS (SELECT p_partkey AS id, p_brand AS brand, p_size * 5 AS r, CAST(p_partkey * 37 % 256 AS INTEGER) AS g, CAST(p_partkey * 91 % 256 AS INTEGER) AS b FROM part)"


def colours(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_brand").alias("brand"), (F.col("p_size") * 5).alias("r"),
        (F.col("p_partkey") * 37 % 256).cast("int").alias("g"), (F.col("p_partkey") * 91 % 256).cast("int").alias("b"),
    )


# -- licences ------------------------------------------------------------------------------------ #
AS_OF = "1998-06-15"
LICENCES = """licences AS (SELECT o_orderkey AS licence, o_custkey AS owner,
  CASE WHEN o_orderstatus = 'P' THEN 'PENDING' WHEN o_orderpriority = '5-LOW' THEN 'SUSPENDED'
       WHEN o_orderkey % 11 = 0 THEN 'REVOKED' WHEN o_orderkey % 13 = 0 THEN 'EXPIRED' ELSE 'ACTIVE' END AS status,
  o_orderdate AS starts, CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE o_orderdate + INTERVAL 365 DAY END AS expires,
  concat('ab-', o_orderkey, ' x') AS licence_key, 2 AS seat_limit FROM orders)"""


def licences(spark: SparkSession, d: str) -> DataFrame:
    status = (
        F.when(F.col("o_orderstatus") == "P", "PENDING").when(F.col("o_orderpriority") == "5-LOW", "SUSPENDED")
        .when(F.col("o_orderkey") % 11 == 0, "REVOKED").when(F.col("o_orderkey") % 13 == 0, "EXPIRED").otherwise("ACTIVE")
    )
    return table(spark, d, "orders").select(
        F.col("o_orderkey").alias("licence"), F.col("o_custkey").alias("owner"), status.alias("status"),
        F.col("o_orderdate").alias("starts"),
        F.when(F.col("o_orderkey") % 17 != 0, F.col("o_orderdate") + F.expr("INTERVAL 365 DAYS")).alias("expires"),
        F.concat(F.lit("ab-"), F.col("o_orderkey").cast("string"), F.lit(" x")).alias("licence_key"),
        F.lit(2).alias("seat_limit"),
    )


# One line item is one activation of a device (supplier) on a licence (order).
ACTIVATIONS = """activations AS (SELECT l_orderkey AS licence, l_suppkey AS device,
  CASE l_returnflag WHEN 'A' THEN 'ACTIVE' WHEN 'N' THEN 'DEACTIVATED' ELSE 'REVOKED' END AS status,
  l_shipdate AS activated_at, CASE WHEN l_returnflag = 'N' THEN l_shipdate + INTERVAL 30 DAY END AS deactivated_at,
  l_linenumber AS line, l_partkey AS part, l_extendedprice AS price FROM lineitem)"""


def activations(spark: SparkSession, d: str) -> DataFrame:
    flag = F.col("l_returnflag")
    rows = dealt(table(spark, d, "lineitem"), "l_orderkey", "l_suppkey", "l_partkey")
    return rows.select(
        F.col("l_orderkey").alias("licence"), F.col("l_suppkey").alias("device"),
        F.when(flag == "A", "ACTIVE").when(flag == "N", "DEACTIVATED").otherwise("REVOKED").alias("status"),
        F.col("l_shipdate").alias("activated_at"),
        F.when(flag == "N", F.col("l_shipdate") + F.expr("INTERVAL 30 DAYS")).alias("deactivated_at"),
        F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"), F.col("l_extendedprice").alias("price"),
    )


# -- ledger ----------------------------------------------------------------------------------------- #
LEDGER = """ledger AS (SELECT event_id, user_id, ts,
  CASE event_type WHEN 'purchase' THEN 1 WHEN 'error' THEN -1 ELSE 0 END * CAST(round(value * 100) AS BIGINT) AS amount,
  CASE WHEN event_id % 9 = 0 THEN NULL ELSE props END AS reference FROM events)"""


def ledger(spark: SparkSession, d: str) -> DataFrame:
    sign = F.when(F.col("event_type") == "purchase", 1).when(F.col("event_type") == "error", -1).otherwise(0)
    return table(spark, d, "events").select(
        "event_id", "user_id", "ts", (sign * F.round(F.col("value") * 100).cast("long")).alias("amount"),
        F.when(F.col("event_id") % 9 != 0, F.col("props")).alias("reference"),
    )
