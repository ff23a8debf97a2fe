"""Queries over layout data."""

from __future__ import annotations

from pyspark.sql import functions as F

from frameloom.functions import boxes as B
from frameloom.operators import layout as L
from frameloom.plans import views as V
from frameloom.plans.photos import BOXES, ORIENT, PROFILE, crop_sql
from frameloom.plans.registry import query, table, with_views

# -- slots ---------------------------------------------------------------------- #
SLOT_ROWS = """slots AS (SELECT * FROM (VALUES (0, 'portrait_large', 0.75e0, ['portrait', 'full_body'], 1, 2), (1, 'portrait_small', 0.75e0, ['portrait'], 1, 1),
  (2, 'landscape_wide', 1.78e0, ['group', 'landscape'], 0, 5), (3, 'group_square', 1e0, ['group', 'large_group'], 2, 8), (4, 'detail_square', 1e0, ['detail', 'environmental'], 0, 1)) s(slot, slot_name, sa, ideal, lo, hi))"""


def _scores_sql():
    # The crop of every photo into every slot, then the score.
    crop = crop_sql().replace("WITH ", "")
    per_slot = crop.replace("boxed b LEFT JOIN (SELECT path, px, py, pw, ph FROM padded) p ON b.path = p.path GROUP BY b.path",
                            "(SELECT * EXCLUDE (frame_aspect), sa AS frame_aspect FROM boxed, slots) b LEFT JOIN (SELECT path, px, py, pw, ph FROM padded) p ON b.path = p.path GROUP BY b.path, b.slot")
    per_slot = per_slot.replace("spans AS (SELECT b.path,", "spans AS (SELECT b.path, b.slot,").replace("crops AS (SELECT path,", "crops AS (SELECT path, slot,")
    return (
        ", " + SLOT_ROWS + per_slot
        + """, kept AS (SELECT c.path, c.slot, b.w * b.h AS area, least(b.x + b.w, c.cx + c.cw) - greatest(b.x, c.cx) AS ow, least(b.y + b.h, c.cy + c.ch) - greatest(b.y, c.cy) AS oh
      FROM crops c LEFT JOIN (SELECT path, x, y, w, h FROM clipped) b ON b.path = c.path),
    losses AS (SELECT path, slot, CASE WHEN sum(area) > 0 THEN least(1e0, greatest(0e0, 1e0 - sum(CASE WHEN ow > 0 AND oh > 0 THEN ow * oh ELSE 0 END) / sum(area))) ELSE 0e0 END AS loss FROM kept GROUP BY path, slot)"""
        + PROFILE
        + """, slot_scores AS (SELECT p.path, s.slot, s.slot_name,
      (CASE WHEN list_contains(s.ideal, p.composition) THEN 1e0 WHEN list_contains(s.ideal, CASE p.composition WHEN 'group' THEN 'large_group' WHEN 'large_group' THEN 'group' WHEN 'detail' THEN 'landscape' WHEN 'landscape' THEN 'detail' END) THEN 0.5e0 ELSE 0e0 END) * 55e0
      + greatest(0e0, 1e0 - greatest(s.lo - p.n, p.n - s.hi, 0) / 4e0) * 25e0
      + (CASE WHEN {oa} = {ob} THEN 1e0 ELSE 0.4e0 END) * (least(p.aspect, s.sa) / greatest(p.aspect, s.sa) * 0.4e0 + 0.6e0) * 20e0 - l.loss * 150e0 AS score
    FROM described p, slots s, losses l WHERE l.path = p.path AND l.slot = s.slot)""".format(oa=ORIENT.format(a="p.aspect"), ob=ORIENT.format(a="s.sa"))
    )


SCORES = BOXES + _scores_sql()


def contents(spark, d):
    df = V.boxed(spark, d).withColumn("boxes", B.clip_boxes("boxes")).withColumn("p", B.content_profile("boxes", "aspect"))
    # Scores are rounded so that near equal totals compare alike everywhere.
    return df.select("path", "project", "dup_group", "l_orderkey", "aspect", "boxes", "p.composition", "p.face_count")


def scores(spark, d):
    s = L.score_slots(contents(spark, d))
    return s.select("path", "dup_group", "l_orderkey", "slot", "slot_name", F.round("score", 4).alias("score"))


@query("J9_slot_scores", SCORES + "SELECT path, slot_name, round(score, 4) AS score FROM slot_scores")
def slot_scores(spark, d):
    return scores(spark, d).select("path", "slot_name", "score")


GROUPED = ", grouped AS (SELECT m.l_orderkey AS grp, s.path, s.slot, round(s.score, 4) AS score FROM slot_scores s JOIN media m USING (path))"
GREEDY = GROUPED + """, ranked_cells AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY score DESC, path, slot) AS n FROM grouped),
  walk AS (SELECT grp, 0::BIGINT AS n, []::VARCHAR[] AS photos, []::INTEGER[] AS used, NULL::VARCHAR AS path, NULL::INTEGER AS slot, NULL::DOUBLE AS score FROM (SELECT DISTINCT grp FROM grouped)
    UNION ALL SELECT w.grp, r.n, CASE WHEN list_contains(w.photos, r.path) OR list_contains(w.used, r.slot) THEN w.photos ELSE list_append(w.photos, r.path) END,
      CASE WHEN list_contains(w.photos, r.path) OR list_contains(w.used, r.slot) THEN w.used ELSE list_append(w.used, r.slot) END,
      CASE WHEN list_contains(w.photos, r.path) OR list_contains(w.used, r.slot) THEN NULL ELSE r.path END, CASE WHEN list_contains(w.photos, r.path) OR list_contains(w.used, r.slot) THEN NULL ELSE r.slot END, r.score
    FROM walk w JOIN ranked_cells r ON r.grp = w.grp AND r.n = w.n + 1)
  SELECT grp AS l_orderkey, slot, path, score FROM walk WHERE slot IS NOT NULL"""


@query("C6_greedy_assignment", SCORES.replace("WITH ", "WITH RECURSIVE ", 1) + GREEDY)
def greedy(spark, d):
    return L.greedy_assignment(scores(spark, d), ["l_orderkey"], "path")


# Every way to fill the slots one after the other; the totals are whole ten-thousandths, so ties are exact.
BEST = GROUPED + """, cells AS (SELECT grp, slot, path, score, CAST(round(score * 10000) AS BIGINT) AS points, dense_rank() OVER (PARTITION BY grp ORDER BY path) AS photo,
    row_number() OVER (PARTITION BY grp, slot ORDER BY score DESC, path) AS r FROM grouped),
  few AS (SELECT * FROM cells WHERE r <= 5), bounds AS (SELECT grp, least(count(DISTINCT slot), count(DISTINCT photo)) AS must FROM few GROUP BY grp),
  plan AS (SELECT DISTINCT slot FROM few), steps AS (SELECT slot, row_number() OVER (ORDER BY slot) AS k FROM plan), total AS (SELECT count(*) AS n FROM plan),
  walk AS (SELECT grp, must, 0::BIGINT AS k, []::BIGINT[] AS picks, []::BIGINT[] AS used, 0::BIGINT AS points FROM bounds
    UNION ALL SELECT w.grp, w.must, w.k + 1, CASE WHEN o.photo IS NULL THEN w.picks ELSE list_concat(w.picks, [o.slot::BIGINT, o.photo]) END,
      CASE WHEN o.photo IS NULL THEN w.used ELSE list_append(w.used, o.photo) END, w.points + coalesce(o.points, 0)
    FROM walk w JOIN (SELECT f.grp, s.k, f.slot, f.photo, f.points FROM few f JOIN steps s USING (slot) UNION ALL SELECT b.grp, s.k, NULL, NULL, NULL FROM bounds b, steps s) o
      ON o.grp = w.grp AND o.k = w.k + 1, total t
    WHERE (o.photo IS NOT NULL AND NOT list_contains(w.used, o.photo)) OR (o.photo IS NULL AND len(w.used) + t.n - w.k - 1 >= w.must)),
  done AS (SELECT grp, picks, row_number() OVER (PARTITION BY grp ORDER BY points DESC, picks) AS r FROM walk, total WHERE k = n AND len(used) = must),
  chosen AS (SELECT grp, unnest(range(1, len(picks), 2)) AS at, picks FROM done WHERE r = 1)
  SELECT c.grp AS l_orderkey, f.slot, f.path, f.score FROM chosen c JOIN few f ON f.grp = c.grp AND f.slot = c.picks[c.at] AND f.photo = c.picks[c.at + 1]"""


@query("C7_best_assignment", SCORES.replace("WITH ", "WITH RECURSIVE ", 1) + BEST)
def best_assignment(spark, d):
    return L.best_assignment(scores(spark, d), ["l_orderkey"], "path")


# -- ranks -------------------------------------------------------------------------- #
@query(
    "W10_rank_fractions",
    """SELECT p_partkey, round(CASE WHEN count(*) OVER (PARTITION BY p_brand) <= 1 THEN 0.5e0 ELSE (rank() OVER (PARTITION BY p_brand ORDER BY p_size) - 1 + (count(*) OVER (PARTITION BY p_brand, p_size) - 1) / 2e0) / (count(*) OVER (PARTITION BY p_brand) - 1) END, 6) AS fraction FROM part""",
)
def rank_fractions(spark, d):
    return L.rank_fractions(table(spark, d, "part"), ["p_brand"], "p_size", "fraction").select("p_partkey", F.round("fraction", 6).alias("fraction"))


@query(
    "W11_pair_by_rank",
    """WITH ph AS (SELECT p_partkey % 10 AS g, p_partkey AS photo, 0.5e0 + p_size / 25e0 AS aspect, row_number() OVER (PARTITION BY p_partkey % 10 ORDER BY p_partkey) - 1 AS p FROM part),
    sl AS (SELECT s_suppkey % 10 AS g, s_suppkey AS slot, 0.5e0 + abs(s_acctbal) / 5000e0 AS sa, row_number() OVER (PARTITION BY s_suppkey % 10 ORDER BY s_suppkey) - 1 AS p FROM supplier),
    np AS (SELECT g, count(*) AS n FROM ph GROUP BY g), ns AS (SELECT g, count(*) AS m FROM sl GROUP BY g),
    a AS (SELECT ph.*, row_number() OVER (PARTITION BY ph.g ORDER BY aspect, p) AS k FROM ph JOIN ns ON ns.g = ph.g WHERE p < m),
    b AS (SELECT sl.*, row_number() OVER (PARTITION BY sl.g ORDER BY sa, slot) AS k FROM sl JOIN np ON np.g = sl.g WHERE p < n)
    SELECT b.g, b.slot, a.photo FROM a JOIN b ON a.g = b.g AND a.k = b.k UNION ALL SELECT ph.g, NULL, photo FROM ph LEFT JOIN ns ON ns.g = ph.g WHERE m IS NULL OR p >= m""",
)
def pair_by_rank(spark, d):
    ph = table(spark, d, "part").select((F.col("p_partkey") % 10).alias("g"), F.col("p_partkey").alias("photo"), (F.col("p_size") / 25.0 + 0.5).alias("aspect"))
    sl = table(spark, d, "supplier").select((F.col("s_suppkey") % 10).alias("g"), F.col("s_suppkey").alias("slot"), (F.abs("s_acctbal") / 5000.0 + 0.5).alias("sa"))
    return L.pair_by_rank(ph, sl, ["g"], "photo", "aspect", "photo", "slot", "sa")


@query(
    "W13_hero_pick",
    BOXES + """, areas AS (SELECT b.path, any_value(b.l_orderkey) AS l_orderkey, any_value(b.l_extendedprice) AS pixels, coalesce(max(c.w * c.h), 0e0) AS face FROM boxed b LEFT JOIN (SELECT path, w, h FROM clipped) c ON c.path = b.path GROUP BY b.path)
    SELECT l_orderkey, path FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY face DESC, pixels DESC, path) AS r FROM areas) WHERE r = 1""",
)
def hero(spark, d):
    df = V.boxed(spark, d).withColumn("boxes", B.clip_boxes("boxes"))
    face = F.array_max(F.transform("boxes", lambda b: b["w"] * b["h"]))
    # Only what decides moves: the rest of a photo would go through the aggregate with it.
    few = df.select("l_orderkey", "path", face.alias("face"), F.col("l_extendedprice").alias("pixels"))
    return L.hero_pick(few, ["l_orderkey"], "path", F.col("face"), F.col("pixels")).select("l_orderkey", "path")


# Spreads of four consecutive parts; frames depend on the spread.
SPREADS = """spreads AS (SELECT p_partkey // 4 AS spread, p_partkey AS photo, 0.5e0 + p_size / 25e0 AS aspect, p_partkey % 4 AS faces FROM part),
  frames AS (SELECT spread, f AS frame, 0.5e0 + ((spread * 7 + f * 11) % 20) / 10e0 AS frame_aspect, 0.1e0 + ((spread * 3 + f * 5) % 9) / 10e0 AS frame_area FROM (SELECT DISTINCT spread FROM spreads), (SELECT unnest([0, 1, 2, 3]) AS f))"""


def spread_rows(spark, d):
    sp = table(spark, d, "part").select(
        F.floor(F.col("p_partkey") / 4).alias("spread"), F.col("p_partkey").alias("photo"), (F.col("p_size") / 25.0 + 0.5).alias("aspect"),
        (F.col("p_partkey") % 4).alias("faces"),
    )
    fr = sp.select("spread").distinct().withColumn("frame", F.explode(F.lit([0, 1, 2, 3]))).select(
        "spread", "frame", (((F.col("spread") * 7 + F.col("frame") * 11) % 20) / 10.0 + 0.5).alias("frame_aspect"),
        (((F.col("spread") * 3 + F.col("frame") * 5) % 9) / 10.0 + 0.1).alias("frame_area"),
    )
    return sp, fr


@query(
    "C8_frame_assignment",
    with_views(SPREADS) + """, pc AS (SELECT *, (rank() OVER (PARTITION BY spread ORDER BY faces) - 1 + (count(*) OVER (PARTITION BY spread, faces) - 1) / 2e0) / (count(*) OVER (PARTITION BY spread) - 1) AS crowd FROM spreads),
    fc AS (SELECT *, (rank() OVER (PARTITION BY spread ORDER BY frame_area) - 1 + (count(*) OVER (PARTITION BY spread, frame_area) - 1) / 2e0) / (count(*) OVER (PARTITION BY spread) - 1) AS room FROM frames),
    cost AS (SELECT p.spread, frame, photo, abs(ln(greatest(frame_aspect, 1e-3)) - ln(greatest(aspect, 1e-3))) + 0.35e0 * (crowd * (1e0 - room)) AS c FROM pc p JOIN fc f USING (spread)),
    ways AS (SELECT a.spread, a.photo AS p0, b.photo AS p1, c.photo AS p2, e.photo AS p3, a.c + b.c + c.c + e.c AS total FROM cost a JOIN cost b ON b.spread = a.spread AND b.frame = 1 AND b.photo <> a.photo
      JOIN cost c ON c.spread = a.spread AND c.frame = 2 AND c.photo NOT IN (a.photo, b.photo) JOIN cost e ON e.spread = a.spread AND e.frame = 3 AND e.photo NOT IN (a.photo, b.photo, c.photo) WHERE a.frame = 0),
    best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY spread ORDER BY round(total, 9), p0, p1, p2, p3) AS r FROM ways) WHERE r = 1)
    SELECT spread, frame, CASE frame WHEN 0 THEN p0 WHEN 1 THEN p1 WHEN 2 THEN p2 ELSE p3 END AS photo FROM best, (SELECT unnest([0, 1, 2, 3]) AS frame)""",
)
def frame_assignment(spark, d):
    sp, fr = spread_rows(spark, d)
    return L.frame_assignment(sp, ["spread"], "photo", "photo", "aspect", "faces", fr)


# -- pacing ---------------------------------------------------------------------------- #
TOTALS = """kinds AS (SELECT project, CASE priority WHEN '1-URGENT' THEN 'cover' WHEN '2-HIGH' THEN 'portraits' WHEN '3-MEDIUM' THEN 'family' WHEN '4-NOT SPECIFIED' THEN 'ceremony' ELSE 'extra' END AS kind,
  count(*) * (1 + project % 9) AS photos FROM album GROUP BY project, 2)"""


def kinds(spark, d):
    names = {"1-URGENT": "cover", "2-HIGH": "portraits", "3-MEDIUM": "family", "4-NOT SPECIFIED": "ceremony"}
    kind = F.coalesce(F.create_map(*[F.lit(x) for p in names.items() for x in p])[F.col("priority")], F.lit("extra"))
    return V.album(spark, d).groupBy("project", kind.alias("kind")).agg((F.count(F.lit(1)) * (1 + F.col("project") % 9)).alias("photos"))


@query(
    "C11_spread_budget",
    with_views(V.ALBUM, TOTALS) + """, b AS (SELECT project, coalesce(sum(photos) FILTER (kind <> 'cover'), 0) AS t FROM kinds GROUP BY project)
    SELECT project, kind, CAST(CASE WHEN kind = 'cover' THEN 1 ELSE greatest(CASE kind WHEN 'portraits' THEN 2 WHEN 'family' THEN 4 ELSE 3 END, CASE WHEN t <= 0 THEN 3 ELSE greatest(2, ceil(t / 24)) END) END AS BIGINT) AS per_spread FROM kinds JOIN b USING (project)""",
)
def spread_budget(spark, d):
    return L.spread_budget(kinds(spark, d), ["project"], "kind", "photos").select("project", "kind", "per_spread")


# One photo moves a step: first to the empty spreads from the fullest, then from the overfull to the emptiest.
PACED = """budget AS (SELECT project, coalesce(sum(photos) FILTER (kind <> 'cover'), 0) AS t FROM kinds GROUP BY project),
  base AS (SELECT project, kind, CAST(photos AS BIGINT) AS t, CAST(CASE WHEN kind = 'cover' THEN 1 ELSE greatest(CASE kind WHEN 'portraits' THEN 2 WHEN 'family' THEN 4 ELSE 3 END, CASE WHEN b.t <= 0 THEN 3 ELSE greatest(2, ceil(b.t / 24)) END) END AS BIGINT) AS p
    FROM kinds JOIN budget b USING (project) WHERE photos > 0),
  sections AS (SELECT *, CAST(ceil(t / p) AS BIGINT) AS n FROM base),
  spreads AS (SELECT *, p > 1 AND n >= 3 AND n * 6 >= t AS paced FROM sections, unnest(range(0, n)) AS u(spread)),
  raw AS (SELECT *, w * (t / sum(w) OVER (PARTITION BY project, kind)) AS r FROM (SELECT *, [1.35e0, 1e0, 1.3e0, 0.35e0][spread % 4 + 1] AS w FROM spreads WHERE paced)),
  dealt AS (SELECT *, row_number() OVER (PARTITION BY project, kind ORDER BY round(r - floor(r), 9) DESC, spread) AS place, t - sum(floor(r)) OVER (PARTITION BY project, kind) AS short FROM raw),
  starts AS (SELECT project, kind, list(CAST(floor(r) AS BIGINT) + CASE WHEN place <= short THEN 1 ELSE 0 END ORDER BY spread) AS c FROM dealt GROUP BY project, kind),
  moves AS (SELECT project, kind, c, 0 AS step FROM starts
    UNION ALL SELECT project, kind, [x + CASE WHEN i = gain THEN 1 ELSE 0 END - CASE WHEN i = loss THEN 1 ELSE 0 END FOR x, i IN c], step + 1
    FROM (SELECT *, CASE WHEN list_min(c) < 1 THEN list_position(c, 0) ELSE list_position(c, list_min(c)) END AS gain,
        CASE WHEN list_min(c) < 1 THEN list_position(c, list_max(c)) ELSE list_position([x > 6 FOR x IN c], true) END AS loss
      FROM moves WHERE (list_min(c) < 1 AND list_max(c) > 1) OR (list_min(c) >= 1 AND list_min(c) < 6 AND list_max(c) > 6))),
  done AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY project, kind ORDER BY step DESC) AS last FROM moves) WHERE last = 1)"""


@query(
    "C9_pace_counts",
    with_views(V.ALBUM, TOTALS, PACED).replace("WITH ", "WITH RECURSIVE ", 1) + """SELECT project, kind, spread, least(p, t - spread * p) AS photos FROM spreads WHERE NOT paced
    UNION ALL SELECT project, kind, unnest(range(0, len(c))) AS spread, unnest(c) AS photos FROM done""",
)
def pace_counts(spark, d):
    k = L.spread_budget(kinds(spark, d), ["project"], "kind", "photos")
    return L.pace_counts(k, ["project", "kind"], "photos", "per_spread", 6)


@query(
    "C9_pace_counts_uniform",
    with_views(V.ALBUM, TOTALS) + """SELECT project, kind, s AS spread, least(3, photos - s * 3) AS photos FROM (SELECT *, unnest(range(0, CAST(ceil(photos / 3) AS BIGINT))) AS s FROM kinds)""",
)
def pace_uniform(spark, d):
    k = kinds(spark, d).withColumn("per", F.lit(3))
    return L.pace_counts(k, ["project", "kind"], "photos", "per", 6, rhythm="uniform")


@query(
    "C10_chunk_by_counts",
    with_views(V.ALBUM) + """, placed AS (SELECT project, path, row_number() OVER (PARTITION BY project ORDER BY path) - 1 AS p FROM album)
    SELECT project, path, CASE WHEN p < 2 THEN 0 WHEN p < 3 THEN 1 WHEN p < 6 THEN 2 ELSE 3 END::BIGINT AS spread FROM placed""",
)
def chunks(spark, d):
    al = V.album(spark, d).select("project", "path")
    counts = al.select("project").distinct().select("project", F.posexplode(F.lit([2, 1, 3])).alias("spread", "photos"))
    return L.chunk_by_counts(al, counts, ["project"], [F.col("path")])


# -- rules and variants --------------------------------------------------------------------- #
SEQUENCES = """seqs AS (SELECT p_partkey // 5 AS spread, p_partkey AS slot, ['portrait', 'group', 'detail', 'landscape'][p_size % 4 + 1] AS composition, 0.5e0 + p_size / 40e0 AS aspect FROM part)"""


@query(
    "C12_layout_penalty",
    with_views(SEQUENCES) + f""", o AS (SELECT *, {ORIENT.format(a='aspect')} AS o, row_number() OVER w AS r, count(*) OVER (PARTITION BY spread) AS n, lag(composition) OVER w AS c1 FROM seqs WINDOW w AS (PARTITION BY spread ORDER BY slot)),
    q AS (SELECT *, lag(o) OVER w AS o1, lag(o, 2) OVER w AS o2 FROM o WINDOW w AS (PARTITION BY spread ORDER BY slot))
    SELECT spread, bool_or(coalesce(composition = c1, false)) AS no_repetition, bool_or(coalesce(o = o1 AND o = o2, false)) AS vary_orientations, bool_or(n >= 2 AND r IN (1, n) AND composition = 'detail') AS detail_not_at_ends,
    bool_or(n >= 3 AND r IN (1, n) AND o = 'landscape') AS wide_in_center, CAST(bool_or(coalesce(composition = c1, false)) AS INTEGER) + CAST(bool_or(n >= 3 AND r IN (1, n) AND o = 'landscape') AS INTEGER) AS penalty FROM q GROUP BY spread""",
)
def layout_penalty(spark, d):
    names = F.lit(["portrait", "group", "detail", "landscape"])
    seqs = table(spark, d, "part").select(
        F.floor(F.col("p_partkey") / 5).alias("spread"), F.col("p_partkey").alias("slot"),
        F.get(names, F.col("p_size") % 4).alias("composition"), (F.col("p_size") / 40.0 + 0.5).alias("aspect"),
    )
    v = L.layout_violations(seqs, ["spread"], "slot", "composition", "aspect")
    return L.layout_penalty(v, ["no_repetition", "wide_in_center", "no_such_rule"])


VARIANTS = [(4, 0, [0.5, 1.0, 1.5, 2.0], False), (4, 1, [1.0, 1.0, 1.0, 1.0], True), (4, 2, [0.7, 0.7, 1.4, 1.4], False), (4, 3, [2.0, 2.0, 0.6, 1.2], True), (2, 0, [1.0, 1.0], False)]
VARIANTS_SQL = "variants AS (SELECT * FROM (VALUES " + ", ".join(
    f"({n}, {v}, [{', '.join(f'{a}e0' for a in fa)}], {str(g).lower()})" for n, v, fa, g in VARIANTS
) + ") t(n, variant, fa, gutter))"


@query(
    "C13_choose_variant",
    with_views(SPREADS, VARIANTS_SQL) + """, a AS (SELECT spread, list_sort(list(aspect)) AS pa FROM spreads GROUP BY spread),
    g AS (SELECT spread, variant, list_sum(list_transform(range(1, 5), lambda i: abs(ln(greatest(list_sort(fa)[i], 1e-3)) - ln(greatest(pa[i], 1e-3))))) AS gap FROM a JOIN variants ON n = len(pa) WHERE NOT gutter),
    c AS (SELECT *, row_number() OVER (PARTITION BY spread ORDER BY gap, variant) - 1 AS r FROM (SELECT *, min(gap) OVER (PARTITION BY spread) AS best FROM g) WHERE gap <= best + 0.15e0),
    m AS (SELECT spread, count(*) AS n FROM c GROUP BY spread) SELECT c.spread, variant, round(gap, 6) AS gap FROM c JOIN m ON m.spread = c.spread WHERE r = c.spread % m.n""",
)
def choose_variant(spark, d):
    sp, _ = spread_rows(spark, d)
    # A spread has four photos by construction.
    rows = sp.groupBy("spread").agg(F.collect_list("aspect").alias("aspects")).withColumn("idx", F.col("spread"))
    library = spark.createDataFrame(VARIANTS, "count int, variant int, frame_aspects array<double>, crosses_gutter boolean")
    out = L.choose_variant(rows, library, ["spread"], "aspects", "idx", avoid_gutter=True)
    return out.select("spread", "variant", F.round("gap", 6).alias("gap"))


@query(
    "C13_rotate_variant",
    with_views(VARIANTS_SQL) + "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN [0, 1, 2, 3][p_size % 4 + 1] WHEN 1 THEN 0 END AS variant FROM part",
)
def rotate_variant(spark, d):
    rows = table(spark, d, "part").select("p_partkey", F.get(F.lit([4, 2, 9]), (F.col("p_partkey") % 3).cast("int")).alias("n"), "p_size")
    library = spark.createDataFrame(VARIANTS, "count int, variant int, frame_aspects array<double>, crosses_gutter boolean")
    return L.rotate_variant(rows, library, "n", "p_size").select("p_partkey", "variant")


@query(
    "A18_layout_hint",
    """SELECT p_brand, p_size % 7 AS g, CASE WHEN count(*) = 1 THEN 'feature' WHEN max(0.5e0 + p_size / 25e0) / greatest(1e-6, min(0.5e0 + p_size / 25e0)) > 1.6e0 THEN 'mosaic' ELSE 'grid' END AS layout, count(*) AS photos FROM part GROUP BY ALL""",
)
def layout_hint(spark, d):
    rows = table(spark, d, "part").select("p_brand", (F.col("p_size") % 7).alias("g"), (F.col("p_size") / 25.0 + 0.5).alias("aspect"))
    return L.layout_hint(rows, ["p_brand", "g"], "aspect")


@query(
    "A24_grid_dimensions",
    """WITH o AS (SELECT p_partkey, c, CAST(ceil(p_size / c) AS BIGINT) AS r, abs(ln(1.5e0 / c * ceil(p_size / c))) + (c * ceil(p_size / c) - p_size) * 0.04e0 AS penalty FROM part, (SELECT unnest(range(1, 51)) AS c) WHERE c <= p_size)
    SELECT p_partkey, c AS cols, r AS rows FROM (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY penalty, c) AS k FROM o) WHERE k = 1""",
)
def grid_dimensions(spark, d):
    df = table(spark, d, "part").withColumn("g", L.grid_dimensions(F.col("p_size"), F.lit(1.5)))
    return df.select("p_partkey", "g.cols", "g.rows")


@query(
    "C14_sheet_fill",
    """WITH e AS (SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey, CAST(round(l_extendedprice * 100) AS BIGINT) AS cents, CAST(l_quantity AS BIGINT) % 5 AS copies FROM lineitem),
    r AS (SELECT *, CAST(sum(copies) OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, cents ROWS UNBOUNDED PRECEDING) AS BIGINT) AS fin FROM e WHERE copies > 0),
    t AS (SELECT *, unnest(range(fin - copies, least(fin, 12))) AS tile FROM r WHERE fin - copies < 12)
    SELECT l_suppkey, l_orderkey, tile, tile // 4 AS row, tile % 4 AS col FROM t""",
)
def sheet_fill(spark, d):
    e = table(spark, d, "lineitem").select(
        "l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", F.round(F.col("l_extendedprice") * 100).cast("long").alias("cents"),
        (F.col("l_quantity").cast("long") % 5).alias("copies"),
    )
    order = [F.col(c) for c in ("l_orderkey", "l_linenumber", "l_partkey", "cents")]
    return L.sheet_fill(e, ["l_suppkey"], order, "copies", 4, 3).select("l_suppkey", "l_orderkey", "tile", "row", "col")


