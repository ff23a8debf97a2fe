"""Queries over photos: quality, categories, duplicates, sources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frameloom.functions import boxes as B
from frameloom.functions import quality as Q
from frameloom.functions import scalar as S
from frameloom.functions.scrub import scrub_json, scrub_map, scrub_text
from frameloom.operators import duplicates as D
from frameloom.operators import selection as sel
from frameloom.plans import views as V
from frameloom.plans.registry import query, table, with_views
from frameloom.session import scratch_dir, stored
from frameloom.sources import cache, manifest_files, scan, sinks, vision

PHOTOS = with_views(*V.PHOTOS)
MEDIA = with_views(V.MEDIA)
SCORED = with_views(V.MEDIA, V.SCORED)


# -- quality ------------------------------------------------------------------ #
@query("P1_quality_score", SCORED + "SELECT path, quality FROM scored")
def quality(spark, d):
    return V.scored(spark, d).select("path", "quality")


@query("P2_is_usable", SCORED + "SELECT path, usable FROM scored")
def usable(spark, d):
    return V.scored(spark, d).select("path", "usable")


@query(
    "P3_subject_sharpness",
    with_views(V.MEDIA, V.BOXED, V.BOXROWS)
    + """, sized AS (SELECT path, blur_score, h * 0 + blur_score * i / 3e0 AS sharp,
      least(120, round_even((x + w) * 120, 0)) - greatest(0, round_even(x * 120, 0)) AS pw,
      least(80, round_even((y + h) * 80, 0)) - greatest(0, round_even(y * 80, 0)) AS ph FROM boxrows)
    SELECT b.path, round(coalesce(max(CASE WHEN pw >= 2 AND ph >= 2 THEN sharp END), any_value(b.blur_score)), 6) AS sharpness
    FROM boxed b LEFT JOIN sized s ON b.path = s.path GROUP BY b.path""",
)
def sharpness(spark, d):
    df = V.boxed(spark, d)
    regions = F.transform(
        "boxes", lambda b, i: F.struct(b["x"], b["y"], b["w"], b["h"], (F.col("blur_score") * (i + 1) / 3.0).alias("sharpness"))
    )
    value = Q.subject_sharpness("blur_score", regions, F.lit(120), F.lit(80))
    return df.select("path", F.round(value, 6).alias("sharpness"))


@query("P4_is_blurry", MEDIA + "SELECT path, blur_score < 100 AS is_blurry FROM media")
def blurry(spark, d):
    return V.media(spark, d).select("path", Q.is_blurry("blur_score").alias("is_blurry"))


@query("P5_quality_tier", SCORED + f"SELECT {V.TIER_SQL} AS tier, count(*) AS photos FROM scored GROUP BY 1")
def tier(spark, d):
    return V.scored(spark, d).groupBy(Q.quality_tier("quality").alias("tier")).agg(F.count(F.lit(1)).alias("photos"))


@query("P6_categorise", PHOTOS + "SELECT path, category FROM records")
def categorise(spark, d):
    return V.records(spark, d).select("path", "category")


@query(
    "P7_candidate_pool",
    PHOTOS + "SELECT project, count(*) AS photos FROM records WHERE category IN ('BestShots', 'Review') GROUP BY project",
)
def pool(spark, d):
    return sel.candidate_pool(V.records(spark, d)).groupBy("project").agg(F.count(F.lit(1)).alias("photos"))


@query(
    "P8_best_shot_filter",
    PHOTOS + "SELECT path, quality FROM records WHERE NOT is_duplicate AND usable AND quality >= 75",
)
def best(spark, d):
    return sel.best_shots(V.ranked_media(spark, d), "path", "quality", "usable", "is_duplicate").select("path", "quality")


@query(
    "P9_face_weight_fallback",
    MEDIA + f"""SELECT path, {V.score_sql(wf="(SELECT CASE WHEN bool_and(l_linenumber > 9) THEN 0e0 ELSE 3e-1 END FROM media)")} AS with_faces,
    {V.score_sql(wf="(SELECT CASE WHEN bool_and(l_linenumber < 9) THEN 0e0 ELSE 3e-1 END FROM media)")} AS all_failed FROM media""",
)
def face_weight(spark, d):
    df = V.media(spark, d).withColumns({"never": F.col("l_linenumber") > 9, "always": F.col("l_linenumber") < 9})

    def score(flag):
        return Q.quality_score(
            "blur_score", "brightness", "contrast", "faces_detected", face_weight=sel.face_weight_for_run(df, flag)
        )

    return df.select("path", score("never").alias("with_faces"), score("always").alias("all_failed"))


@query(
    "P31_optional_filters",
    "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority = '1-URGENT'",
)
def filters(spark, d):
    wanted = {"o_orderstatus": "O", "o_orderpriority": "1-URGENT", "o_custkey": None}
    return sel.optional_filters(table(spark, d, "orders"), wanted).select("o_orderkey")


@query(
    "P32_require_faces",
    MEDIA + """, grouped AS (SELECT *, dup_group AS g FROM media)
    SELECT path FROM (SELECT *, max(faces_detected) OVER (PARTITION BY g) AS any_face FROM grouped)
    WHERE faces_detected OR NOT any_face""",
)
def require_faces(spark, d):
    return sel.require_faces(V.media(spark, d), ["dup_group"], "faces_detected").select("path")


@query(
    "P32_require_faces_missing",
    MEDIA + """, holes AS (SELECT path, CASE WHEN l_linenumber % 7 <> 0 THEN dup_group END AS g, CASE WHEN l_linenumber % 3 <> 0 AND l_orderkey % 5 <> 0 THEN faces_detected END AS f FROM media)
    SELECT path FROM (SELECT *, max(coalesce(f, false)) OVER (PARTITION BY g) AS any_face FROM holes) WHERE coalesce(f, false) OR NOT any_face""",
)
def require_faces_missing(spark, d):
    holes = V.media(spark, d).select(
        "path", F.when(F.col("l_linenumber") % 7 != 0, F.col("dup_group")).alias("g"),
        F.when((F.col("l_linenumber") % 3 != 0) & (F.col("l_orderkey") % 5 != 0), F.col("faces_detected")).alias("f"),
    )
    return sel.require_faces(holes, ["g"], "f").select("path")


@query("P33_records", PHOTOS + "SELECT path, category, tier, is_best_shot, is_duplicate FROM records")
def records(spark, d):
    return V.records(spark, d).select("path", "category", "tier", "is_best_shot", "is_duplicate")


# -- joins and aggregates ------------------------------------------------------- #
@query(
    "J1_quality_with_faces",
    MEDIA + """, f AS (SELECT path, faces_detected, face_count FROM media WHERE l_linenumber % 2 = 0)
    SELECT m.path, coalesce(f.faces_detected, false) AS faces_detected, coalesce(f.face_count, 0) AS face_count
    FROM media m LEFT JOIN f ON m.path = f.path""",
)
def with_faces(spark, d):
    df = V.media(spark, d)
    found = df.filter(F.col("l_linenumber") % 2 == 0).select("path", "faces_detected", "face_count")
    return sel.quality_with_faces(df.select("path"), found, "path").select("path", "faces_detected", "face_count")


@query(
    "J2_category_flags",
    PHOTOS + "SELECT path, is_best_shot AS best, is_duplicate AS duplicate, NOT usable AS blurry FROM records",
)
def flags(spark, d):
    # All lists come from one table, which is computed once.
    ranked = stored(V.ranked_media(spark, d).select("path", "quality", "usable", "is_duplicate", "is_representative"), "ranked")
    members = {
        "best": ranked.filter(sel.best_shot(F.col("quality"), F.col("usable"), F.col("is_duplicate"))).select("path"),
        "duplicate": D.duplicate_paths(ranked, "path"),
        "blurry": ranked.filter(~F.col("usable")).select("path"),
    }
    return sel.flag_lists(ranked.select("path"), "path", members)


@query(
    "A1_category_counts",
    PHOTOS + """SELECT c.category, count(r.path) AS photos FROM (VALUES ('BestShots'), ('Duplicates'), ('Blurry'), ('Review')) c(category)
    LEFT JOIN records r ON r.category = c.category GROUP BY c.category""",
)
def category_counts(spark, d):
    return sel.grouped_category_counts(V.scored(spark, d), "dup_group", "path", "quality", "usable").select("category", "photos")


@query(
    "A2_run_summary",
    PHOTOS + """SELECT count(*) AS scanned, count(*) FILTER (NOT is_duplicate AND group_size >= 2) AS duplicate_groups,
    count(*) FILTER (is_duplicate) AS duplicates, count(*) FILTER (category = 'Blurry') AS blurry,
    count(*) FILTER (faces_detected) AS with_faces, count(quality) AS scored, round(avg(quality), 4) AS mean_quality FROM records""",
)
def summary(spark, d):
    return sel.run_summary(V.records(spark, d))


@query(
    "A3_duplicate_listing",
    """WITH d AS (SELECT md5(text) AS h, lpad(CAST(doc_id AS VARCHAR), 9, '0') AS path FROM documents),
    g AS (SELECT h, min(path) AS representative, count(*) AS group_size FROM d GROUP BY h HAVING count(*) >= 2)
    SELECT representative, path, group_size, path = representative AS is_representative FROM d JOIN g USING (h)""",
)
def listing(spark, d):
    docs = table(spark, d, "documents").select(
        F.md5("text").alias("h"), F.lpad(F.col("doc_id").cast("string"), 9, "0").alias("path")
    )
    return D.duplicate_listing(docs, "h", "path")


@query(
    "W3_rerank",
    """WITH d AS (SELECT md5(text) AS h, lpad(CAST(d.doc_id AS VARCHAR), 9, '0') AS path, quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)
    SELECT path, first_value(path) OVER w AS representative, row_number() OVER w = 1 AS is_representative FROM d
    WINDOW w AS (PARTITION BY h ORDER BY coalesce(quality, -1) DESC, path)""",
)
def rerank(spark, d):
    docs = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left").select(
        F.md5("text").alias("h"), F.lpad(F.col("doc_id").cast("string"), 9, "0").alias("path"), F.col("quality").cast("double")
    )
    return D.rerank(docs, "h", "path", "quality").select("path", "representative", "is_representative")


@query(
    "W3_rerank_missing",
    """WITH d AS (SELECT CASE WHEN d.doc_id % 3 <> 0 THEN md5(text) END AS h, lpad(CAST(d.doc_id AS VARCHAR), 9, '0') AS path, quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)
    SELECT path, first_value(path) OVER w AS representative, row_number() OVER w = 1 AS is_representative, count(*) OVER (PARTITION BY coalesce(h, path)) AS group_size FROM d
    WINDOW w AS (PARTITION BY coalesce(h, path) ORDER BY coalesce(quality, -1) DESC, path)""",
)
def rerank_missing(spark, d):
    docs = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left").select(
        F.when(F.col("doc_id") % 3 != 0, F.md5("text")).alias("h"), F.lpad(F.col("doc_id").cast("string"), 9, "0").alias("path"),
        F.col("quality").cast("double"),
    )
    return D.rerank(docs, "h", "path", "quality").select("path", "representative", "is_representative", "group_size")


@query("U6_duplicate_set", PHOTOS + "SELECT path FROM ranked WHERE is_duplicate")
def duplicate_set(spark, d):
    return D.duplicate_paths(V.ranked_media(spark, d), "path")


@query(
    "J3_hamming_pairs",
    with_views(V.HASHES) + """, u AS (SELECT hash, min(path) AS p, count(*) AS n FROM hashes GROUP BY hash)
    SELECT x.hash AS a, y.hash AS b, x.p AS path_a, y.p AS path_b, x.n AS copies_a, y.n AS copies_b,
      CAST(bit_count(xor(x.hash, y.hash)) AS BIGINT) AS distance
    FROM u x JOIN u y ON x.hash < y.hash AND bit_count(xor(x.hash, y.hash)) <= 5""",
)
def hamming_pairs(spark, d):
    return D.hamming_pairs(V.hashes(spark, d), "path", "hash", 5)


@query(
    "J3_hamming_pairs_loose",
    with_views(V.HASHES) + """, u AS (SELECT DISTINCT hash FROM hashes)
    SELECT x.hash AS a, y.hash AS b, CAST(bit_count(xor(x.hash, y.hash)) AS BIGINT) AS distance
    FROM u x JOIN u y ON x.hash < y.hash AND bit_count(xor(x.hash, y.hash)) <= 18""",
)
def hamming_pairs_loose(spark, d):
    return D.hamming_pairs(V.hashes(spark, d), "path", "hash", 18).select("a", "b", "distance")


@query(
    "J3_hamming_pairs_wide",
    with_views(V.HASHES) + """, u AS (SELECT DISTINCT hash FROM hashes)
    SELECT x.hash AS a, y.hash AS b, CAST(bit_count(xor(x.hash, y.hash)) AS BIGINT) AS distance
    FROM u x JOIN u y ON x.hash < y.hash AND bit_count(xor(x.hash, y.hash)) <= 10""",
)
def hamming_pairs_wide(spark, d):
    return D.hamming_pairs(V.hashes(spark, d), "path", "hash", 10).select("a", "b", "distance")


FOUNDERS = """, items AS (SELECT hash, min(path) AS p FROM hashes GROUP BY hash),
    ordered AS (SELECT p, hash, row_number() OVER (ORDER BY p) AS n FROM items),
    walk AS (SELECT 0::BIGINT AS n, []::BIGINT[] AS found
      UNION ALL SELECT o.n, CASE WHEN len(list_filter(w.found, lambda f: bit_count(xor(f, o.hash)) <= {d})) > 0 THEN w.found
        ELSE list_append(w.found, o.hash) END FROM walk w JOIN ordered o ON o.n = w.n + 1),
    heads AS (SELECT unnest(found) AS hash FROM (SELECT found FROM walk ORDER BY n DESC LIMIT 1)),
    named AS (SELECT h.hash, i.p FROM heads h JOIN items i USING (hash)),
    owner AS (SELECT i.hash, min(f.p) AS representative FROM items i JOIN named f ON bit_count(xor(i.hash, f.hash)) <= {d} GROUP BY i.hash)
    SELECT path, representative, path = representative AS is_representative FROM hashes JOIN owner USING (hash)"""


@query("C1_near_duplicate_groups", with_views(V.HASHES).replace("WITH ", "WITH RECURSIVE ", 1) + FOUNDERS.format(d=5))
def near_duplicates(spark, d):
    return D.near_duplicate_groups(V.hashes(spark, d), "path", "hash", 5)


@query("C1_near_duplicate_groups_loose", with_views(V.HASHES).replace("WITH ", "WITH RECURSIVE ", 1) + FOUNDERS.format(d=18))
def near_duplicates_loose(spark, d):
    return D.near_duplicate_groups(V.hashes(spark, d), "path", "hash", 18)


@query("C1_near_duplicate_groups_wide", with_views(V.HASHES).replace("WITH ", "WITH RECURSIVE ", 1) + FOUNDERS.format(d=10))
def near_duplicates_wide(spark, d):
    return D.near_duplicate_groups(V.hashes(spark, d), "path", "hash", 10)


# -- sources --------------------------------------------------------------------- #
URL_SUFFIX = """CASE WHEN regexp_extract(url, '[^/]*$') LIKE '%.%' THEN lower(regexp_extract(regexp_extract(url, '[^/]*$'), '[^.](\\.[^.]+)$', 1)) ELSE '' END"""


# The listing lies below a root with signs that mean something in a pattern and a name that is excluded.
@query(
    "S1_scan_media",
    f"""SELECT url, concat('file:/d/fr (1+)/[a]/', url) AS path FROM pages WHERE {URL_SUFFIX} IN ('.html') AND len(list_intersect(string_split(lower(url), '/'), ['fr', 'es', 'fr (1+)'])) = 0""",
)
def scan_media(spark, d):
    root = "/d/fr (1+)/[a]"
    files = table(spark, d, "pages").select("url", F.concat(F.lit(f"file:{root}/"), "url").alias("path"))
    return files.filter(scan.is_media(scan.below_root("path", root), [".HTML"], ["FR", "es", "FR (1+)"])).orderBy("path")


@query(
    "S2_capture_time",
    """SELECT o_orderkey, coalesce(CASE WHEN o_orderkey % 3 = 0 THEN o_orderdate END,
    CASE WHEN o_orderkey % 5 > 0 THEN o_orderdate + INTERVAL 1 DAY END, TIMESTAMP '1970-01-01 00:00:00') AS captured_at FROM orders""",
)
def capture_time(spark, d):
    exif = F.when(
        F.col("o_orderkey") % 3 == 0, F.concat(F.lit(" "), F.date_format("o_orderdate", "yyyy:MM:dd HH:mm:ss"), F.lit(" "))
    ).when(F.col("o_orderkey") % 3 == 1, "broken")
    mtime = F.when(F.col("o_orderkey") % 5 > 0, F.col("o_orderdate") + F.expr("INTERVAL 1 DAY"))
    return table(spark, d, "orders").select("o_orderkey", scan.capture_time(exif, mtime).alias("captured_at"))


# A page with a query string in its address counts as unreadable.
@query(
    "S6_quarantine_split",
    """SELECT url NOT LIKE '%?%' AS readable, count(*) AS pages, min(page_id) AS first_page FROM pages GROUP BY 1""",
)
def quarantine(spark, d):
    pages = table(spark, d, "pages")
    good, bad = scan.quarantine_split(pages, F.col("url").contains("?"))
    both = good.withColumn("readable", F.lit(True)).unionByName(bad.withColumn("readable", F.lit(False)))
    return both.groupBy("readable").agg(F.count(F.lit(1)).alias("pages"), F.min("page_id").alias("first_page"))


@query(
    "S6_run_flags",
    """SELECT count(*) AS scanned, count(*) FILTER (url NOT LIKE '%.html%') AS unreadable, count(*) FILTER (page_id >= 0) AS face_failures,
    count(*) > 0 AND count(*) FILTER (url NOT LIKE '%.html%') = count(*) AS all_unreadable,
    count(*) > 0 AND count(*) FILTER (page_id >= 0) = count(*) AS all_faces_failed FROM pages""",
)
def run_flags(spark, d):
    return scan.run_flags(table(spark, d, "pages"), ~F.col("url").contains(".html"), F.col("page_id") >= 0)


def _versions(spark, d):
    docs = table(spark, d, "documents").select(
        F.col("source").alias("namespace"), F.col("doc_id").cast("string").alias("path"), F.col("n_chars").alias("size"),
        (F.col("doc_id") * 7).alias("mtime_s"), F.md5("text").alias("payload"), "doc_id",
    )
    old = docs.filter(F.col("doc_id") % 4 != 0)
    new = docs.withColumn("size", F.when(F.col("doc_id") % 5 == 0, F.col("size") + 1).otherwise(F.col("size")))
    return old.drop("doc_id"), new.drop("doc_id")


CACHES = """WITH docs AS (SELECT source AS namespace, CAST(doc_id AS VARCHAR) AS path, n_chars AS size, doc_id * 7 AS mtime_s, md5(text) AS payload, doc_id FROM documents),
  v1 AS (SELECT * FROM docs WHERE doc_id % 4 <> 0),
  v2 AS (SELECT * REPLACE (CASE WHEN doc_id % 5 = 0 THEN size + 1 ELSE size END AS size) FROM docs),
  judged AS (SELECT v2.*, v1.path IS NOT NULL AS valid FROM v2 LEFT JOIN v1 ON v1.namespace = v2.namespace AND v1.path = v2.path AND v1.size = v2.size AND v1.mtime_s = v2.mtime_s)
"""


@query("S7_incremental_plan", CACHES + "SELECT namespace, path, size FROM judged WHERE NOT valid")
def incremental_plan(spark, d):
    old, new = _versions(spark, d)
    return cache.to_recompute(new, old).select("namespace", "path", "size")


@query(
    "S7_all_valid",
    CACHES + "SELECT namespace, bool_and(valid) AS all_valid, count(*) FILTER (NOT valid) AS stale, count(*) AS files FROM judged GROUP BY namespace",
)
def all_valid(spark, d):
    old, new = _versions(spark, d)
    return cache.all_valid(new, old)


@query(
    "S8_upsert_cache",
    CACHES + """SELECT namespace, path, size, mtime_s, payload FROM v1 WHERE doc_id % 3 <> 0
    UNION ALL SELECT namespace, path, size, mtime_s, concat(payload, '-second') FROM v2 WHERE doc_id % 3 = 0""",
)
def upsert(spark, d):
    old, new = _versions(spark, d)
    fresh = new.filter(F.col("path").cast("long") % 3 == 0).withColumn("put", F.lit(2))
    # Every key is put twice; the later entry, though of an older file, wins.
    again = fresh.withColumns({"put": F.lit(1), "mtime_s": F.col("mtime_s") + 5})
    both = again.unionByName(fresh.withColumn("payload", F.concat("payload", F.lit("-second"))))
    return cache.upsert_cache(old, both, "put")


@query(
    "S10_unique_names",
    """WITH f AS (SELECT concat(lang, '/', doc_id, '/', source, '-', n_chars % 50, '.jpg') AS path, CASE doc_id % 4 WHEN 0 THEN 'BestShots' WHEN 1 THEN 'Duplicates' WHEN 2 THEN 'Blurry' ELSE 'Review' END AS category,
      concat(source, '-', n_chars % 50) AS stem FROM documents),
    r AS (SELECT *, row_number() OVER (PARTITION BY category, stem ORDER BY path) - 1 AS k FROM f)
    SELECT category, path, CASE WHEN k = 0 THEN concat(stem, '.jpg') ELSE concat(stem, '_', k, '.jpg') END AS target FROM r""",
)
def unique_names(spark, d):
    names = F.array(*[F.lit(c) for c in Q.CATEGORIES])
    df = table(spark, d, "documents").select(
        F.concat_ws("", "lang", F.lit("/"), "doc_id", F.lit("/"), "source", F.lit("-"), F.col("n_chars") % 50, F.lit(".jpg")).alias("path"),
        F.get(names, (F.col("doc_id") % 4).cast("int")).alias("category"),
    )
    return sinks.unique_names(df, "path").select("category", "path", "target")


@query(
    "S11_labelled_folders",
    "SELECT url, coalesce(string_split(url, '/')[-2], '') AS label, '' AS flat_label FROM pages",
)
def labelled(spark, d):
    return table(spark, d, "pages").select(
        "url", scan.folder_label("url").alias("label"), scan.folder_label("url", flat=True).alias("flat_label")
    )


# An answer text per event: fenced, short of confidences, too many colours, or broken.
ANSWERS = """WITH a AS (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN '{"scene_labels": [broken' ELSE
    concat(CASE WHEN event_id % 3 = 0 THEN concat('```json', chr(10)) ELSE '' END,
      '{"scene_labels": [" ', upper(event_type), '", "Bride ', user_id, '", "fire"], "scene_confidence": [', CASE WHEN event_id % 2 = 0 THEN '0.25' ELSE '0.5, 0.75, 0.125, 1.0' END,
      '], "dominant_colors": [{"r": ', user_id % 256, '.5, "g": 10, "b": 20.4}, {"r": 1, "g": 2, "b": 3}, {"r": 4, "g": 5, "b": 6}, {"r": 7, "g": 8, "b": 9}], "face_count": ', user_id % 4, '}',
      CASE WHEN event_id % 3 = 0 THEN concat(chr(10), '```') ELSE '' END) END AS answer, event_id % 7 = 0 AS bad, user_id, event_type FROM events)
"""


def answers(spark, d) -> DataFrame:
    fence = F.when(F.col("event_id") % 3 == 0, F.lit("```json\n")).otherwise("")
    tail = F.when(F.col("event_id") % 3 == 0, F.lit("\n```")).otherwise("")
    sure = F.when(F.col("event_id") % 2 == 0, F.lit("0.25")).otherwise("0.5, 0.75, 0.125, 1.0")
    text = F.concat(
        fence, F.lit('{"scene_labels": [" '), F.upper("event_type"), F.lit('", "Bride '), F.col("user_id").cast("string"),
        F.lit('", "fire"], "scene_confidence": ['), sure, F.lit('], "dominant_colors": [{"r": '),
        (F.col("user_id") % 256).cast("string"),
        F.lit('.5, "g": 10, "b": 20.4}, {"r": 1, "g": 2, "b": 3}, {"r": 4, "g": 5, "b": 6}, {"r": 7, "g": 8, "b": 9}], "face_count": '),
        (F.col("user_id") % 4).cast("string"), F.lit("}"), tail,
    )
    return table(spark, d, "events").withColumn(
        "answer", F.when(F.col("event_id") % 7 == 0, F.lit('{"scene_labels": [broken')).otherwise(text)
    )


@query(
    "S12_parse_vision_json",
    ANSWERS + """SELECT event_id, CASE WHEN bad THEN '' ELSE concat(event_type, ',bride ', user_id, ',fire') END AS labels,
    CASE WHEN bad THEN 0e0 WHEN event_id % 2 = 0 THEN 1.85e0 ELSE 1.375e0 END AS confidence_sum,
    CASE WHEN bad THEN 0 ELSE 3 END AS colours, CASE WHEN bad THEN -1 ELSE CAST(round_even(user_id % 256 + 0.5e0, 0) AS INTEGER) END AS first_red,
    CASE WHEN bad THEN 0 ELSE CAST(user_id % 4 AS INTEGER) END AS face_count FROM a""",
)
def parse_answers(spark, d):
    a = answers(spark, d).select("event_id", vision.parse_vision_json("answer").alias("v"))
    return a.select(
        "event_id", F.array_join("v.labels", ",").alias("labels"),
        F.round(F.aggregate("v.confidences", F.lit(0.0), lambda s, c: s + c), 6).alias("confidence_sum"),
        F.size("v.colours").alias("colours"), F.coalesce(F.get("v.colours", F.lit(0))["r"], F.lit(-1)).alias("first_red"),
        F.col("v.face_count").alias("face_count"),
    )


@query("S13_scan_with_limit", "SELECT doc_id, n_chars FROM documents ORDER BY lpad(CAST(doc_id AS VARCHAR), 9, '0') LIMIT 25")
def limited(spark, d):
    docs = table(spark, d, "documents").withColumn("path", F.lpad(F.col("doc_id").cast("string"), 9, "0"))
    return scan.scan_with_limit(docs, 25).select("doc_id", "n_chars")


# -- scalar functions --------------------------------------------------------------- #
@query(
    "F6_print_sizes",
    """WITH s AS (SELECT p_partkey, CAST(round_even(p_size / 25.4e0 * 300, 0) AS BIGINT) AS tile_w, CAST(round_even(p_size * 1.25e0 / 25.4e0 * 300, 0) AS BIGINT) AS tile_h FROM part),
    g AS (SELECT *, CASE WHEN 1200 - 60 < tile_w THEN 0 ELSE (1140 + 15) // (tile_w + 15) END AS c, CASE WHEN 1800 - 60 < tile_h THEN 0 ELSE (1740 + 15) // (tile_h + 15) END AS r FROM s)
    SELECT p_partkey, tile_w, tile_h, CASE WHEN c > 0 AND r > 0 THEN c ELSE 0 END AS cols, CASE WHEN c > 0 AND r > 0 THEN r ELSE 0 END AS rows FROM g""",
)
def print_sizes(spark, d):
    df = table(spark, d, "part").select(
        "p_partkey", S.mm_to_px("p_size", 300).alias("tile_w"), S.mm_to_px(F.col("p_size") * 1.25, 300).alias("tile_h")
    )
    sheet = [S.inch_to_px(F.lit(v), 300) for v in (4.0, 6.0, 0.1, 0.05)]
    cols, rows = S.sheet_grid(sheet[0], sheet[1], sheet[2], sheet[3], F.col("tile_w"), F.col("tile_h"))
    return df.select("*", cols.alias("cols"), rows.alias("rows"))


@query(
    "F8_licence_keys",
    with_views(V.LICENCES) + """SELECT licence, upper(regexp_replace(licence_key, '[\\s-]+', '', 'g')) AS normal,
    sha256(upper(regexp_replace(licence_key, '[\\s-]+', '', 'g'))) AS key_hash, right(upper(regexp_replace(licence_key, '[\\s-]+', '', 'g')), 4) AS last4 FROM licences""",
)
def licence_keys(spark, d):
    return V.licences(spark, d).select(
        "licence", S.normal_key("licence_key").alias("normal"), S.key_hash("licence_key").alias("key_hash"), S.key_last4("licence_key").alias("last4")
    )


@query(
    "F9_normal_email",
    """SELECT c_custkey, nullif(lower(trim(CASE WHEN c_custkey % 10 = 0 THEN '   ' ELSE concat('  ', c_name, '@Example.COM ') END)), '') AS email FROM customer""",
)
def emails(spark, d):
    raw = F.when(F.col("c_custkey") % 10 == 0, F.lit("   ")).otherwise(F.concat(F.lit("  "), "c_name", F.lit("@Example.COM ")))
    return table(spark, d, "customer").select("c_custkey", S.normal_email(raw).alias("email"))


ROLES = "['bride', 'groom', 'mother', 'father', 'brother', 'sister', 'relative', 'friend', 'cousin', '']"


@query(
    "F10_role_tokens",
    f"""WITH r AS (SELECT c_custkey, {ROLES}[c_custkey % 10 + 1] AS label, CASE c_custkey % 3 WHEN 0 THEN 'bride' WHEN 1 THEN 'groom' END AS side FROM customer)
    SELECT c_custkey, CASE WHEN label = '' THEN '' WHEN label IN ('mother', 'father', 'brother', 'sister')
      THEN concat_ws(',', CASE side WHEN 'bride' THEN 'family_bride' WHEN 'groom' THEN 'family_groom' END, 'close_family')
      WHEN label = 'relative' THEN coalesce(CASE side WHEN 'bride' THEN 'family_bride' WHEN 'groom' THEN 'family_groom' END, '')
      ELSE label END AS tokens FROM r""",
)
def role_tokens(spark, d):
    roles = F.lit(["bride", "groom", "mother", "father", "brother", "sister", "relative", "friend", "cousin", ""])
    label = F.get(roles, (F.col("c_custkey") % 10).cast("int"))
    side = F.when(F.col("c_custkey") % 3 == 0, "bride").when(F.col("c_custkey") % 3 == 1, "groom")
    return table(spark, d, "customer").select("c_custkey", F.array_join(S.role_tokens(label, side), ",").alias("tokens"))


@query(
    "F11_path_parts",
    """WITH p AS (SELECT page_id, string_split(url, '/')[-1] AS name FROM pages),
    s AS (SELECT *, lower(regexp_extract(name, '[^.](\\.[^.]+)$', 1)) AS suffix FROM p)
    SELECT page_id, name, suffix, left(name, len(name) - len(suffix)) AS stem FROM s""",
)
def path_parts(spark, d):
    return table(spark, d, "pages").select(
        "page_id", S.file_name("url").alias("name"), S.suffix("url").alias("suffix"), S.stem("url").alias("stem")
    )


@query(
    "F12_scrub_text",
    """SELECT doc_id, concat('loaded <photo.', ['jpg', 'jpeg', 'png', 'tiff'][doc_id % 4 + 1], '> ', md5(text), ' from C:\\Users\\<user>\\x and /home/<user>/run; drive <path> done') AS scrubbed FROM documents""",
)
def scrub_texts(spark, d):
    ext = F.get(F.lit(["JPG", "jpeg", "Png", "tiff"]), (F.col("doc_id") % 4).cast("int"))
    line = F.concat(
        F.lit("loaded /data/Priya & Arjun/"), "lang", F.lit(" "), F.col("doc_id").cast("string"), F.lit("."), ext, F.lit(" "), F.md5("text"),
        F.lit(" from C:\\Users\\amy"), F.col("doc_id").cast("string"), F.lit("\\x and /home/bob"), F.col("doc_id").cast("string"),
        F.lit("/run; drive D:\\Client Work\\notes "), "source", F.lit(".txt done"),
    )
    return table(spark, d, "documents").select("doc_id", scrub_text(line).alias("scrubbed"))


@query(
    "F13_scrub_metadata",
    """SELECT doc_id, concat('{"lang":"', lang, '","api_KEY":"[redacted]","nested":{"userPassword":"[redacted]","n":', n_chars, '},"list":[{"token_id":"[redacted]"},true]}') AS scrubbed,
    concat_ws('|', '[redacted]', CASE WHEN len(text) > 2000 THEN concat(left(text, 2000), '…[truncated]') ELSE text END) AS flat FROM documents""",
)
def scrub_metadata(spark, d):
    docs = table(spark, d, "documents")
    text = F.concat(
        F.lit('{"lang":"'), "lang", F.lit('","api_KEY":"'), F.md5("text"), F.lit('","nested":{"userPassword":"x","n":'),
        F.col("n_chars").cast("string"), F.lit('},"list":[{"token_id":7},true]}'),
    )
    flat = scrub_map(F.create_map(F.lit("Access_Token"), F.md5("text"), F.lit("body"), F.col("text")))
    return docs.select(
        "doc_id", scrub_json(text).alias("scrubbed"), F.concat_ws("|", flat["Access_Token"], flat["body"]).alias("flat")
    )


@query(
    "F14_limiter_key",
    "SELECT c_custkey, concat('login:', left(sha256(c_name), 32)) AS limiter_key FROM customer",
)
def limiter_keys(spark, d):
    return table(spark, d, "customer").select("c_custkey", S.limiter_key("login", "c_name").alias("limiter_key"))


@query(
    "F17_valid_ip",
    """SELECT event_id, CASE WHEN event_id % 4 IN (0, 1) AND event_id % 300 < 256 AND user_id < 256 THEN concat('10.', user_id, '.', event_id % 300, '.7')
      WHEN event_id % 4 = 2 THEN concat('fe80::', user_id % 9, ':1') END AS ip FROM events""",
)
def valid_ips(spark, d):
    v4 = F.concat(F.lit("10."), F.col("user_id").cast("string"), F.lit("."), (F.col("event_id") % 300).cast("string"), F.lit(".7"))
    v6 = F.concat(F.lit("fe80::"), (F.col("user_id") % 9).cast("string"), F.lit(":1"))
    raw = F.when(F.col("event_id") % 4 < 2, v4).when(F.col("event_id") % 4 == 2, v6).otherwise("proxy, 10.0.0.1")
    return table(spark, d, "events").select("event_id", S.valid_ip(raw).alias("ip"))


@query(
    "F18_release_metadata",
    """WITH r AS (SELECT page_id, CASE WHEN page_id % 5 = 0 THEN concat('ftp://', page_id) ELSE url END AS url, CASE WHEN page_id % 7 = 0 THEN 'abc' WHEN page_id % 3 = 0 THEN upper(sha256(html)) END AS digest FROM pages)
    SELECT page_id, CASE WHEN NOT (url LIKE 'https://%' OR url LIKE 'http://%') THEN 'download_url' WHEN digest IS NOT NULL AND len(digest) <> 64 THEN 'sha256' END AS problem,
    CASE WHEN len(digest) = 64 THEN lower(digest) END AS digest FROM r""",
)
def release_metadata(spark, d):
    from frameloom.functions.licence import release_problem

    rows = table(spark, d, "pages").select(
        "page_id", F.when(F.col("page_id") % 5 == 0, F.concat(F.lit("ftp://"), F.col("page_id").cast("string"))).otherwise(F.col("url")).alias("url"),
        F.when(F.col("page_id") % 7 == 0, "abc").when(F.col("page_id") % 3 == 0, F.upper(F.sha2("html", 256))).alias("digest"),
    )
    return rows.select(
        "page_id", release_problem("url", F.lit(None).cast("string"), "digest").alias("problem"), S.valid_sha256("digest").alias("digest")
    )


# -- boxes on photos ------------------------------------------------------------------- #
BOXES = with_views(V.MEDIA, V.BOXED, V.BOXROWS, V.CLIPPED)


def _summed(boxes, prefix=""):
    """Count and sums of a box array, one number per side."""
    out = [F.size(boxes).cast("long").alias(f"{prefix}n")]
    for side in ("x", "y", "w", "h"):
        out.append(F.round(B.total(boxes, lambda b, s=side: b[s]), 6).alias(f"{prefix}{side}"))
    return out


SUMS = "count(x) AS n, round(coalesce(sum(x), 0), 6) AS x, round(coalesce(sum(y), 0), 6) AS y, round(coalesce(sum(w), 0), 6) AS w, round(coalesce(sum(h), 0), 6) AS h"


@query("P13_clip_boxes", BOXES + f"SELECT b.path, {SUMS} FROM boxed b LEFT JOIN clipped c ON b.path = c.path GROUP BY b.path")
def clip_boxes(spark, d):
    return V.boxed(spark, d).withColumn("c", B.clip_boxes("boxes")).select("path", *_summed(F.col("c")))


@query(
    "P14_pixel_boxes",
    BOXES + """, p AS (SELECT path, greatest(0, round_even(x * 240, 0)) AS x0, greatest(0, round_even(y * 160, 0)) AS y0,
      least(240, round_even((x + w) * 240, 0)) AS x1, least(160, round_even((y + h) * 160, 0)) AS y1 FROM boxrows)
    SELECT path, count(*) AS n, CAST(sum(x0) AS BIGINT) AS x0, CAST(sum(y0) AS BIGINT) AS y0, CAST(sum(x1) AS BIGINT) AS x1, CAST(sum(y1) AS BIGINT) AS y1
    FROM p WHERE x1 - x0 >= 24 AND y1 - y0 >= 24 GROUP BY path""",
)
def pixel_boxes(spark, d):
    df = V.boxed(spark, d).withColumn("p", B.pixel_boxes("boxes", F.lit(240), F.lit(160))).filter(F.size("p") > 0)

    def total(n):
        return F.aggregate("p", F.lit(0).cast("long"), lambda s, b: s + b[n]).alias(n)

    return df.select("path", F.size("p").cast("long").alias("n"), *[total(n) for n in ("x0", "y0", "x1", "y1")])


PADDED = """, padded AS (SELECT *, least(1e0, x + w * (1e0 + 0.25e0)) - greatest(0e0, x - w * 0.25e0) AS pw, greatest(0e0, x - w * 0.25e0) AS px,
  least(1e0, y + h * (1e0 + 1.4e0)) - greatest(0e0, y - h * 0.45e0) AS ph, greatest(0e0, y - h * 0.45e0) AS py FROM clipped)"""


@query(
    "P15_pad_boxes",
    BOXES + PADDED + """SELECT b.path, count(px) AS n, round(coalesce(sum(px), 0), 6) AS x, round(coalesce(sum(py), 0), 6) AS y,
    round(coalesce(sum(pw), 0), 6) AS w, round(coalesce(sum(ph), 0), 6) AS h FROM boxed b LEFT JOIN padded p ON b.path = p.path GROUP BY b.path""",
)
def pad_boxes(spark, d):
    return V.boxed(spark, d).withColumn("p", B.pad_boxes(B.clip_boxes("boxes"))).select("path", *_summed(F.col("p")))


def _window_sql(size, lo, hi, pull):
    a, b = f"greatest(0e0, {hi} - {size})", f"least(greatest(0e0, 1e0 - {size}), {lo})"
    fit = {None: f"((least({a}, {b}) + greatest({a}, {b})) / 2e0)", "low": f"least({a}, {b})", "high": f"greatest({a}, {b})"}[pull]
    return f"""least(greatest(CASE WHEN {lo} IS NULL OR {size} >= 1e0 - 1e-6 THEN (1e0 - {size}) / 2e0
      WHEN {hi} - {lo} <= {size} + 1e-6 THEN {fit} ELSE ({lo} + {hi}) / 2e0 - {size} / 2e0 END, 0e0), greatest(0e0, 1e0 - {size}))"""


def crop_sql(pull=None):
    return PADDED + f""", spans AS (SELECT b.path, any_value(aspect) AS aspect, any_value(frame_aspect) AS frame_aspect, min(px) AS lx, max(px + pw) AS hx, min(py) AS ly, max(py + ph) AS hy
      FROM boxed b LEFT JOIN (SELECT path, px, py, pw, ph FROM padded) p ON b.path = p.path GROUP BY b.path),
    sizes AS (SELECT *, CASE WHEN aspect > frame_aspect THEN frame_aspect / aspect ELSE 1e0 END AS cw, CASE WHEN aspect > frame_aspect THEN 1e0 ELSE aspect / frame_aspect END AS ch FROM spans),
    crops AS (SELECT path, {_window_sql('cw', 'lx', 'hx', pull)} AS cx, {_window_sql('ch', 'ly', 'hy', None)} AS cy, cw, ch FROM sizes)"""


@query(
    "P16_cover_crop",
    BOXES + crop_sql() + "SELECT path, round(cx, 9) AS x, round(cy, 9) AS y, round(cw, 9) AS w, round(ch, 9) AS h FROM crops",
)
def cover_crop(spark, d):
    df = V.boxed(spark, d).withColumn("c", B.cover_crop("aspect", "frame_aspect", B.clip_boxes("boxes")))
    return df.select("path", *[F.round(F.col(f"c.{s}"), 9).alias(s) for s in ("x", "y", "w", "h")])


@query("P16_cover_crop_pulled", BOXES + crop_sql("high") + "SELECT path, round(cx, 9) AS x, round(cy, 9) AS y FROM crops")
def cover_crop_pulled(spark, d):
    df = V.boxed(spark, d).withColumn("c", B.cover_crop("aspect", "frame_aspect", B.clip_boxes("boxes"), pull_x="high"))
    return df.select("path", *[F.round(F.col(f"c.{s}"), 9).alias(s) for s in ("x", "y")])


@query(
    "P17_crop_loss",
    BOXES + crop_sql() + """, kept AS (SELECT c.path, b.w * b.h AS area, least(b.x + b.w, c.cx + c.cw) - greatest(b.x, c.cx) AS ow, least(b.y + b.h, c.cy + c.ch) - greatest(b.y, c.cy) AS oh
      FROM crops c LEFT JOIN (SELECT path, x, y, w, h FROM clipped) b ON b.path = c.path)
    SELECT path, round(CASE WHEN sum(area) > 0 THEN least(1e0, greatest(0e0, 1e0 - sum(CASE WHEN ow > 0 AND oh > 0 THEN ow * oh ELSE 0 END) / sum(area))) ELSE 0e0 END, 6) AS loss FROM kept GROUP BY path""",
)
def crop_loss(spark, d):
    df = V.boxed(spark, d).withColumn("f", B.clip_boxes("boxes")).withColumn("c", B.cover_crop("aspect", "frame_aspect", "f"))
    return df.select("path", F.round(B.crop_loss("f", "c"), 6).alias("loss"))


@query(
    "P18_box_from_eyes",
    MEDIA + """, e AS (SELECT path, l_discount * 9e0 AS lx, l_tax * 10e0 AS ly, l_discount * 9e0 + (l_partkey % 20) / 100e0 AS rx, l_tax * 10e0 + (l_suppkey % 5) / 100e0 AS ry FROM media),
    s AS (SELECT *, sqrt((rx - lx) * (rx - lx) + (ry - ly) * (ry - ly)) AS d, (lx + rx) / 2e0 AS cx, (ly + ry) / 2e0 AS cy FROM e),
    b AS (SELECT path, d, greatest(0e0, cx - d * 2.2e0 / 2e0) AS x0, greatest(0e0, cy - d * 1.5e0) AS y0, least(1e0, cx + d * 2.2e0 / 2e0) AS x1, least(1e0, cy + d * 2.6e0) AS y1 FROM s)
    SELECT path, round(x0, 6) AS x, round(y0, 6) AS y, round(x1 - x0, 6) AS w, round(y1 - y0, 6) AS h FROM b WHERE d > 0 AND x1 > x0 AND y1 > y0""",
)
def eyes(spark, d):
    lx, ly = F.col("l_discount") * 9.0, F.col("l_tax") * 10.0
    rx, ry = lx + (F.col("l_partkey") % 20) / 100.0, ly + (F.col("l_suppkey") % 5) / 100.0
    df = V.media(spark, d).withColumn("b", B.box_from_eyes(lx, ly, rx, ry)).filter(F.col("b").isNotNull())
    return df.select("path", *[F.round(F.col(f"b.{s}"), 6).alias(s) for s in ("x", "y", "w", "h")])


@query(
    "P19_id_crop",
    MEDIA + """, f AS (SELECT path, CAST(600 + l_partkey % 400 AS BIGINT) AS iw, CAST(500 + l_suppkey % 300 AS BIGINT) AS ih, l_linenumber % 3 > 0 AS has,
      (l_partkey % 60) / 100e0 AS x, (l_orderkey % 50) / 100e0 AS y, l_quantity / 200e0 AS w, l_quantity / 150e0 AS h FROM media),
    i AS (SELECT *, least(1e0, iw / (h * ih * 1.8e0 / 0.65e0 * 0.8e0), ih / (h * ih * 1.8e0 / 0.65e0)) AS fit, least(ih, iw / 0.8e0) AS fh FROM f),
    s AS (SELECT *, CASE WHEN has THEN h * ih * 1.8e0 / 0.65e0 * fit ELSE fh END AS ch, CASE WHEN has THEN h * ih * 1.8e0 / 0.65e0 * 0.8e0 * fit ELSE fh * 0.8e0 END AS cw FROM i),
    o AS (SELECT *, CASE WHEN has THEN CASE WHEN iw - cw < 0 THEN 0e0 ELSE greatest(0e0, least(iw - cw, x * iw + w * iw / 2e0 - cw / 2e0)) END ELSE (iw - cw) / 2e0 END AS x0,
      CASE WHEN has THEN CASE WHEN ih - ch < 0 THEN 0e0 ELSE greatest(0e0, least(ih - ch, y * ih + h * ih * 0.35e0 - ch * 0.45e0)) END ELSE (ih - ch) / 2e0 END AS y0 FROM s)
    SELECT path, CAST(round_even(x0, 0) AS BIGINT) AS x0, CAST(round_even(y0, 0) AS BIGINT) AS y0, CAST(round_even(x0 + cw, 0) AS BIGINT) AS x1, CAST(round_even(y0 + ch, 0) AS BIGINT) AS y1 FROM o""",
)
def id_crop(spark, d):
    face = F.when(
        F.col("l_linenumber") % 3 > 0,
        B.box((F.col("l_partkey") % 60) / 100.0, (F.col("l_orderkey") % 50) / 100.0, F.col("l_quantity") / 200.0, F.col("l_quantity") / 150.0),
    )
    df = V.media(spark, d).withColumns(
        {"iw": 600 + F.col("l_partkey") % 400, "ih": 500 + F.col("l_suppkey") % 300, "face": face}
    )
    df = df.withColumn("c", B.id_crop(F.col("iw"), F.col("ih"), "face", 0.8))
    return df.select("path", "c.x0", "c.y0", "c.x1", "c.y1")


def _third_sql(lo, hi):
    size = f"(({hi} + ({hi} - {lo}) * 0.35e0) - ({lo} - ({hi} - {lo}) * 0.35e0))"
    mid = f"(({lo} + {hi}) * 0.5e0)"
    third = f"(CASE WHEN abs({mid} - 1e0 / 3e0) <= abs({mid} - 2e0 / 3e0) THEN 1e0 / 3e0 ELSE 2e0 / 3e0 END)"
    start = f"greatest({hi} - {size}, least({lo}, {mid} - {third} * {size}))"
    return size, start


@query(
    "P21_third_rule_crop",
    BOXES + """, u AS (SELECT path, min(greatest(0e0, x)) AS lx, max(least(1e0, x + w)) AS hx, min(greatest(0e0, y)) AS ly, max(least(1e0, y + h)) AS hy FROM clipped GROUP BY path),
    s AS (SELECT path, {0} AS sx, {1} AS ax, {2} AS sy, {3} AS ay FROM u),
    e AS (SELECT path, ax + sx - ax AS wx, ax, ax + sx AS bx, ay + sy - ay AS wy, ay, ay + sy AS by_ FROM s),
    f AS (SELECT path, CASE WHEN wx >= 1 OR ax < 0 THEN 0e0 WHEN bx > 1 THEN 1e0 - wx ELSE ax END AS x0, CASE WHEN wx >= 1 OR (bx > 1 AND ax >= 0) THEN 1e0 WHEN ax < 0 THEN wx ELSE bx END AS x1,
      CASE WHEN wy >= 1 OR ay < 0 THEN 0e0 WHEN by_ > 1 THEN 1e0 - wy ELSE ay END AS y0, CASE WHEN wy >= 1 OR (by_ > 1 AND ay >= 0) THEN 1e0 WHEN ay < 0 THEN wy ELSE by_ END AS y1 FROM e)
    SELECT path, round(x0, 6) AS x, round(y0, 6) AS y, round(x1 - x0, 6) AS w, round(y1 - y0, 6) AS h FROM f""".format(*_third_sql("lx", "hx"), *_third_sql("ly", "hy")),
)
def third_rule(spark, d):
    # Boxes are clipped once and photos without any leave first; a filter on the crop would compute it again.
    df = V.boxed(spark, d).filter("n_boxes > 0").withColumn("clipped", B.clip_boxes("boxes")).filter(F.size("clipped") > 0)
    df = df.withColumn("c", B.third_rule_crop("clipped"))
    return df.select("path", *[F.round(F.col(f"c.{s}"), 6).alias(s) for s in ("x", "y", "w", "h")])


ORIENT = "CASE WHEN {a} <= 0 OR abs({a} - 1e0) <= 0.05e0 THEN 'square' WHEN {a} > 1 THEN 'landscape' ELSE 'portrait' END"


@query("P10_orientation", f"SELECT p_partkey, {ORIENT.format(a='((p_size - 2) / 25e0)')} AS orientation FROM part")
def orientation(spark, d):
    return table(spark, d, "part").select("p_partkey", B.orientation((F.col("p_size") - 2) / 25.0).alias("orientation"))


PROFILE = """, profile AS (SELECT b.path, any_value(b.aspect) AS aspect, count(x) AS n, coalesce(max(least(1e0, greatest(0e0, w)) * least(1e0, greatest(0e0, h))), 0e0) AS face,
    round(coalesce(sum(x + w / 2e0), 0), 6) AS cx, round(coalesce(sum(y + h / 2e0), 0), 6) AS cy FROM boxed b LEFT JOIN (SELECT path, x, y, w, h FROM clipped) c ON b.path = c.path GROUP BY b.path),
  described AS (SELECT *, {o} AS orientation, CASE WHEN n = 0 THEN 'landscape' WHEN n >= 5 THEN 'large_group' WHEN n >= 2 THEN 'group' WHEN face >= 0.08e0 THEN 'portrait'
    WHEN face <= 0.06e0 AND {o} = 'portrait' THEN 'full_body' WHEN face >= 0.02e0 THEN 'environmental' ELSE 'detail' END AS composition FROM profile)""".format(o=ORIENT.format(a="aspect"))


@query("P11_composition", BOXES + PROFILE + "SELECT composition, count(*) AS photos FROM described GROUP BY composition")
def composition(spark, d):
    kind = B.composition(B.clip_boxes("boxes"), "aspect")
    return V.boxed(spark, d).groupBy(kind.alias("composition")).agg(F.count(F.lit(1)).alias("photos"))


@query(
    "P12_content_profile",
    BOXES + PROFILE + "SELECT path, n AS face_count, round(face, 6) AS dominant_face, cx, cy, composition, orientation FROM described",
)
def content_profile(spark, d):
    df = V.boxed(spark, d).withColumn("p", B.content_profile(B.clip_boxes("boxes"), "aspect"))
    total = lambda n: F.round(F.aggregate("p.centres", F.lit(0.0), lambda s, c: s + c[n]), 6).alias(n)
    return df.select("path", "p.face_count", F.round("p.dominant_face", 6).alias("dominant_face"), total("cx"), total("cy"), "p.composition", "p.orientation")


@query(
    "P22_effective_ppi",
    """WITH c AS (SELECT p_partkey, p_size * 100 AS w, p_retailprice AS h, (p_partkey % 7) * 300 AS cw, 900 + p_partkey % 600 AS ch FROM part)
    SELECT p_partkey, round(least(w / cw, h / ch) * 300, 6) AS ppi FROM c WHERE cw > 0 AND least(w / cw, h / ch) * 300 < 150""",
)
def effective_ppi(spark, d):
    ppi = B.effective_ppi(F.col("p_size") * 100, F.col("p_retailprice"), (F.col("p_partkey") % 7) * 300, 900 + F.col("p_partkey") % 600, 300)
    return table(spark, d, "part").select("p_partkey", ppi.alias("ppi")).filter(F.col("ppi") < 150).withColumn("ppi", F.round("ppi", 6))


# -- written and read back ---------------------------------------------------------------- #
@query(
    "S9_manifest_round_trip",
    PHOTOS + "SELECT project, path, category, quality, usable, faces_detected, tier FROM records",
)
def manifest_round_trip(spark, d):
    recs = V.records(spark, d).select(
        F.col("project").cast("string").alias("project"), "path", "category", "quality", "usable", "faces_detected", "tier",
        F.lit("dropped on reading").alias("unknown_field"),
    )
    folder = scratch_dir(spark, "manifest")
    manifest_files.write_manifest({"photos": recs}, folder)
    back = manifest_files.read_manifest(spark, folder)["photos"]
    return back.select(F.col("project").cast("long").alias("project"), "path", "category", "quality", "usable", "faces_detected", "tier")


@query("S10_write_by_category", PHOTOS + "SELECT category, path, quality FROM records")
def write_by_category(spark, d):
    folder = scratch_dir(spark, "sorted")
    sinks.write_by_category(V.records(spark, d).select("path", "quality", "category"), folder)
    return spark.read.parquet(folder).select("category", "path", "quality")
