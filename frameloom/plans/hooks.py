"""Queries of what a user hands in (stages, rules, kernels, models, section lists), and of the small scalar rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from frameloom.functions import boxes, colour, licence, scalar
from frameloom.operators import duplicates as D
from frameloom.operators import layout as L
from frameloom.operators import selection as sel
from frameloom.plans import albums, layouts
from frameloom.plans import views as V
from frameloom.plans.registry import query, table, with_views
from frameloom.sources import images

# -- images: 64 consecutive parts are the pixels of one, in the form in which Spark's image source hands them on ---- #
SIDE = 8
PIXELS = f"""px AS (SELECT p_partkey // {SIDE * SIDE} AS image, p_partkey % {SIDE * SIDE} // {SIDE} AS y, p_partkey % {SIDE} AS x, p_size * 5 AS r, p_partkey * 7 % 256 AS g,
  CAST(round(p_retailprice * 100) AS BIGINT) % 256 AS b FROM part WHERE p_partkey >= {SIDE * SIDE}),
  gray AS (SELECT *, round_even(0.114e0 * b + 0.587e0 * g + 0.299e0 * r, 0) AS l FROM px WHERE image IN (SELECT image FROM px GROUP BY image HAVING count(*) = {SIDE * SIDE}))"""


def pictures(spark, d):
    """path, height, width, channels and BGR bytes; an image has as many pixels as it has parts, 64."""
    k, byte = F.col("p_partkey"), lambda c: F.lpad(F.hex(c.cast("long")), 2, "0")
    blue = F.round(F.col("p_retailprice") * 100).cast("long") % 256
    px = table(spark, d, "part").where(k >= SIDE * SIDE).select(
        F.floor(k / (SIDE * SIDE)).alias("image"), k.alias("at"), F.concat(byte(blue), byte(k * 7 % 256), byte(F.col("p_size") * 5)).alias("bgr")
    )
    rows = px.groupBy("image").agg(F.sort_array(F.collect_list(F.struct("at", "bgr"))).alias("px")).where(F.size("px") == SIDE * SIDE)
    return rows.select(
        F.col("image").cast("string").alias("path"), F.lit(SIDE).alias("height"), F.lit(SIDE).alias("width"), F.lit(3).alias("nChannels"),
        F.unhex(F.array_join(F.col("px.bgr"), "")).alias("data"),
    )


@query(
    "S3_image_features",
    with_views(PIXELS) + """, lap AS (SELECT c.image, n.l + s.l + w.l + e.l - 4 * c.l AS v FROM gray c
      JOIN gray n ON n.image = c.image AND n.x = c.x AND n.y = abs(c.y - 1) JOIN gray s ON s.image = c.image AND s.x = c.x AND s.y = 7 - abs(6 - c.y)
      JOIN gray w ON w.image = c.image AND w.y = c.y AND w.x = abs(c.x - 1) JOIN gray e ON e.image = c.image AND e.y = c.y AND e.x = 7 - abs(6 - c.x)),
    blur AS (SELECT image, var_pop(v) AS blur FROM lap GROUP BY image)
    SELECT image::VARCHAR AS path, true AS readable, round(avg(l), 6) AS brightness, round(stddev_pop(l), 6) AS contrast, round(any_value(blur), 4) AS blur_score, round(avg(r), 6) AS r_mean, round(avg(g), 6) AS g_mean, round(avg(b), 6) AS b_mean
    FROM gray JOIN blur USING (image) GROUP BY image""",
)
def image_features(spark, d):
    out = images.image_features(pictures(spark, d))
    return out.select(
        "path", "readable", *(F.round(c, 6).alias(c) for c in ("brightness", "contrast")), F.round("blur_score", 4).alias("blur_score"),
        *(F.round(c, 6).alias(c) for c in ("r_mean", "g_mean", "b_mean")),
    )


@query(
    "X4_image_kernel",
    with_views(PIXELS) + "SELECT image::VARCHAR AS path, max(r)::BIGINT AS reddest, count(*) FILTER (b > g)::BIGINT AS blue FROM gray GROUP BY image",
)
def image_kernel(spark, d):
    def kernel(row):
        bgr = images.pixels(row["data"], row["height"], row["width"], row["nChannels"]).astype(int)
        return {"reddest": int(bgr[:, :, 2].max()), "blue": int((bgr[:, :, 0] > bgr[:, :, 1]).sum())}

    return images.image_features(pictures(spark, d), kernel, "path string, reddest long, blue long")


@query(
    "X1_embedding_backend",
    "SELECT p_partkey, length(p_name) % 4 AS a, (ascii(p_name) % 2)::BIGINT AS b FROM part WHERE length(p_name) % 4 > 0 OR ascii(p_name) % 2 > 0",
)
def embedding_backend(spark, d):
    def backend(crops):
        return [[len(c) % 4, c[0] % 2] for c in crops]

    crops = table(spark, d, "part").select("p_partkey", F.col("p_name").cast("binary").alias("crop"))
    out = images.embed_faces(crops, backend, ["p_partkey"], "p_partkey long, vector array<float>")
    return out.select("p_partkey", F.get("vector", F.lit(0)).cast("long").alias("a"), F.get("vector", F.lit(1)).cast("long").alias("b"))


@query(
    "X2_injected_stage",
    """WITH s AS (SELECT o_custkey AS shoot, o_orderkey AS path, CASE WHEN o_orderstatus = 'F' THEN NULL ELSE o_totalprice END AS quality FROM orders)
    SELECT path, first_value(path) OVER w AS representative FROM s WINDOW w AS (PARTITION BY shoot ORDER BY coalesce(quality, -1) DESC, path)""",
)
def injected_stage(spark, d):
    """A user's own scoring stage in front of the library's ranking."""

    def score(df):
        return df.withColumn("quality", F.when(F.col("o_orderstatus") != "F", F.col("o_totalprice")))

    shots = table(spark, d, "orders").withColumns({"shoot": F.col("o_custkey"), "path": F.col("o_orderkey")})
    return shots.transform(score).transform(D.rerank, "shoot", "path", "quality").select("path", "representative")


@query(
    "X3_rule_registry",
    with_views(layouts.SEQUENCES) + """, o AS (SELECT *, row_number() OVER w AS r, count(*) OVER (PARTITION BY spread) AS n, lag(composition) OVER w AS c1 FROM seqs WINDOW w AS (PARTITION BY spread ORDER BY slot)),
    v AS (SELECT spread, bool_or(coalesce(composition = c1, false)) AS same, bool_or(n >= 2 AND r IN (1, n) AND composition = 'detail') AS ends FROM o GROUP BY spread)
    SELECT spread, same::INTEGER + (ends AND NOT same)::INTEGER AS penalty FROM v""",
)
def rule_registry(spark, d):
    names = F.lit(["portrait", "group", "detail", "landscape"])
    seqs = table(spark, d, "part").select(
        F.floor(F.col("p_partkey") / 5).alias("spread"), F.col("p_partkey").alias("slot"),
        F.get(names, F.col("p_size") % 4).alias("composition"), (F.col("p_size") / 40.0 + 0.5).alias("aspect"),
    )
    broken = L.layout_violations(seqs, ["spread"], "slot", "composition", "aspect")
    mine = {"only_ends": F.col("detail_not_at_ends") & ~F.col("no_repetition")}
    return L.layout_penalty(broken, ["no_repetition", "only_ends", "never_heard_of"], mine).select("spread", "penalty")


X5_PARTS = [("Groom", "persons = ['groom']", ""), ("Family", "list_contains(persons, 'close_family')", " WHERE pos < 3")]


@query(
    "X5_section_specs",
    albums.TOKENS + " UNION ALL ".join(
        f"SELECT * FROM ({albums.SECTION.format(n=n, name=name, order=albums.BY_QUALITY, src='tokens', test=test)}){cut}" for n, (name, test, cut) in enumerate(X5_PARTS)
    ),
)
def section_specs(spark, d):
    specs = [{"name": "Groom", "kind": "solo", "label": "groom"}, {"name": "Family", "kind": "group", "label": "close_family", "limit": 3}]
    return sel.rule_sections(V.album_tokens(spark, d), specs, ["project"], "path", "quality", "persons")


# -- scalar rules ------------------------------------------------------------------------------------------------- #
@query("F1_clamp", "SELECT p_partkey, greatest(10e0, least(40e0, p_size - 0.5e0)) AS clamped FROM part")
def clamp(spark, d):
    return table(spark, d, "part").select("p_partkey", scalar.clamp(F.col("p_size") - 0.5, 10.0, 40.0).alias("clamped"))


@query("F2_round", "SELECT p_partkey, round(p_size / 8e0, 2) AS eighths, round(p_retailprice / 7e0, 2) AS sevenths FROM part")
def rounded(spark, d):
    return table(spark, d, "part").select(
        "p_partkey", F.round(F.col("p_size") / 8.0, 2).alias("eighths"), F.round(F.col("p_retailprice") / 7.0, 2).alias("sevenths")
    )


@query(
    "F5_soften_thirds_slide",
    """WITH v AS (SELECT p_partkey, p_size / 25e0 AS ratio, p_size / 50e0 AS x, p_size / 40e0 - 0.4e0 AS low, (p_partkey % 9) / 6e0 AS width FROM part)
    SELECT p_partkey, round(CASE WHEN abs(ratio - 1) <= 0.12e0 THEN 1 ELSE 1 + (ratio - 1) * 0.5e0 END, 9) AS softened, round(CASE WHEN abs(x - 1e0 / 3) <= abs(x - 2e0 / 3) THEN 1e0 / 3 ELSE 2e0 / 3 END, 9) AS third,
    round(CASE WHEN width >= 1 OR low < 0 THEN 0 WHEN low + width > 1 THEN 1 - width ELSE low END, 9) AS start, round(CASE WHEN width >= 1 THEN 1 WHEN low < 0 THEN width WHEN low + width > 1 THEN 1 ELSE low + width END, 9) AS stop FROM v""",
)
def soften_thirds_slide(spark, d):
    size = F.col("p_size")
    low, width = size / 40.0 - 0.4, (F.col("p_partkey") % 9) / 6.0
    start, stop = boxes.slide_into_unit(low, low + width)
    return table(spark, d, "part").select(
        "p_partkey", F.round(colour.soften(size / 25.0, 0.5, 0.12), 9).alias("softened"), F.round(boxes.nearest_third(size / 50.0), 9).alias("third"),
        F.round(start, 9).alias("start"), F.round(stop, 9).alias("stop"),
    )


@query(
    "F15_trial_days",
    """SELECT o_orderkey, CAST(greatest(0, 14 - date_diff('day', o_orderdate::DATE, (o_orderdate + INTERVAL 1 DAY * (o_orderkey % 20))::DATE)) AS INTEGER) AS days_left FROM orders""",
)
def trial_days(spark, d):
    today = F.date_add(F.to_date("o_orderdate"), (F.col("o_orderkey") % 20).cast("int"))
    left = licence.trial_days_left(F.date_format("o_orderdate", "yyyy-MM-dd"), today)
    return table(spark, d, "orders").select("o_orderkey", left.cast("int").alias("days_left"))
