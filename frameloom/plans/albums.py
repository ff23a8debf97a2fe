"""Queries over albums: rankings, sections, stories, timelines, events, colours."""

from __future__ import annotations

from pyspark.sql import functions as F

from frameloom.functions import colour as C
from frameloom.operators import events as E
from frameloom.operators import selection as sel
from frameloom.operators import timeline as T
from frameloom.plans import views as V
from frameloom.plans.photos import PHOTOS, answers
from frameloom.plans.registry import dealt, query, table, with_views
from frameloom.sources.vision import parse_vision_json

ALBUM = with_views(V.ALBUM)
TOKENS = with_views(V.ALBUM, V.ALBUM_TOKENS)
SHOTS = with_views(V.SHOTS)

# -- timeline ------------------------------------------------------------------- #
SEGMENTS = """, gaps AS (SELECT *, CASE WHEN epoch_us(captured_at) - epoch_us(lag(captured_at) OVER w) > {us} THEN 1 ELSE 0 END AS opens FROM shots
    WINDOW w AS (PARTITION BY project ORDER BY captured_at, path)),
  segments AS (SELECT project, path, captured_at, CAST(sum(opens) OVER (PARTITION BY project ORDER BY captured_at, path ROWS UNBOUNDED PRECEDING) AS BIGINT) AS segment FROM gaps)"""


def segmented(spark, d, seconds):
    return T.gap_segments(V.shots(spark, d), ["project"], "captured_at", "path", seconds)


@query("W1_gap_segments", SHOTS + SEGMENTS.format(us=2700 * 10**6) + "SELECT project, path, segment FROM segments")
def gap_segments(spark, d):
    return segmented(spark, d, T.EVENT_GAP_SECONDS).select("project", "path", "segment")


@query("W1_gap_segments_6h", SHOTS + SEGMENTS.format(us=21600 * 10**6) + "SELECT project, path, segment FROM segments")
def gap_segments_6h(spark, d):
    return segmented(spark, d, 21600).select("project", "path", "segment")


@query(
    "W2_segment_bounds",
    SHOTS + SEGMENTS.format(us=86400 * 10**6)
    + """SELECT project, segment, min(captured_at) AS start_time, max(captured_at) AS end_time, arg_min(path, (captured_at, path)) AS first_path, count(*) AS photos
    FROM segments GROUP BY project, segment""",
)
def segment_bounds(spark, d):
    return T.segment_bounds(segmented(spark, d, 86400), ["project"], "captured_at", "path")


# -- rankings --------------------------------------------------------------------- #
@query(
    "T1_rank_by_quality",
    ALBUM + "SELECT project, path, row_number() OVER (PARTITION BY project ORDER BY coalesce(quality, 0) DESC, path) - 1 AS pos FROM album",
)
def rank_by_quality(spark, d):
    return sel.ranked(V.album(spark, d), ["project"], sel.quality_order("quality", "path")).select("project", "path", "pos")


@query(
    "T2_chronological",
    """WITH s AS (SELECT event_id, user_id, CASE WHEN event_id % 10 = 0 THEN NULL ELSE ts END AS t FROM events)
    SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY t NULLS FIRST, event_id) - 1 AS pos FROM s""",
)
def chronological(spark, d):
    df = table(spark, d, "events").withColumn("t", F.when(F.col("event_id") % 10 != 0, F.col("ts")))
    return sel.ranked(df, ["user_id"], sel.time_order("t", "event_id")).select("event_id", "pos")


# Per customer, an album has a cover, highlights and a closing.
POOLS = """, pools AS (SELECT *, max(is_best_shot) OVER (PARTITION BY project) AS any_best FROM album),
  covers AS (SELECT project, path, quality FROM (SELECT *, row_number() OVER (PARTITION BY project ORDER BY faces_detected DESC, coalesce(quality, 0) DESC, path) AS r
    FROM pools WHERE is_best_shot OR NOT any_best) WHERE r = 1),
  lights AS (SELECT p.project, p.path, row_number() OVER (PARTITION BY p.project ORDER BY coalesce(p.quality, 0) DESC, p.path) - 1 AS pos FROM pools p
    ANTI JOIN covers c ON c.project = p.project AND c.path = p.path WHERE is_best_shot OR NOT any_best),
  last_ones AS (SELECT project, path, row_number() OVER (PARTITION BY project ORDER BY taken, path) - 1 AS pos FROM
    (SELECT *, row_number() OVER (PARTITION BY project ORDER BY taken DESC, path DESC) AS back FROM album) WHERE back <= 8)"""


@query("T3_highlights", ALBUM + POOLS + "SELECT project, path FROM lights WHERE pos < 24")
def highlights(spark, d):
    df = V.album(spark, d)
    front = sel.cover(df, ["project"], "path", "quality", "is_best_shot", "faces_detected")
    return sel.highlights(df, ["project"], "path", "quality", "is_best_shot", front).select("project", "path")


@query("T4_closing", ALBUM + POOLS + "SELECT project, path, pos FROM last_ones")
def closing(spark, d):
    last = sel.closing(V.album(spark, d), ["project"], "taken", "path")
    return sel.ranked(last, ["project"], sel.time_order("taken", "path")).select("project", "path", "pos")


@query("T5_cover", ALBUM + POOLS + "SELECT project, path, quality FROM covers")
def cover(spark, d):
    return sel.cover(V.album(spark, d), ["project"], "path", "quality", "is_best_shot", "faces_detected").select("project", "path", "quality")


# The same with verdicts that are missing, in whole projects too, and photos that belong to no project.
HOLES = """, holes AS (SELECT * REPLACE (CASE WHEN project % 5 <> 0 THEN project END AS project,
    CASE WHEN project % 3 <> 0 AND path % 10 <> 1 THEN is_best_shot END AS is_best_shot, CASE WHEN path % 10 <> 2 THEN faces_detected END AS faces_detected) FROM album)"""
HOLE_POOLS = HOLES + """, pools AS (SELECT *, max(coalesce(is_best_shot, false)) OVER (PARTITION BY project) AS any_best FROM holes),
  covers AS (SELECT project, path, quality FROM (SELECT *, row_number() OVER (PARTITION BY project ORDER BY coalesce(faces_detected, false) DESC, coalesce(quality, 0) DESC, path) AS r
    FROM pools WHERE coalesce(is_best_shot, false) OR NOT any_best) WHERE r = 1),
  lights AS (SELECT p.project, p.path, row_number() OVER (PARTITION BY p.project ORDER BY coalesce(p.quality, 0) DESC, p.path) - 1 AS pos FROM pools p
    ANTI JOIN covers c ON c.project IS NOT DISTINCT FROM p.project AND c.path = p.path WHERE coalesce(is_best_shot, false) OR NOT any_best)"""


def album_with_holes(spark, d):
    end, project = F.col("path") % 10, F.col("project")
    return V.album(spark, d).select(
        "path", "quality", F.when(project % 5 != 0, project).alias("project"),
        F.when((project % 3 != 0) & (end != 1), F.col("is_best_shot")).alias("is_best_shot"),
        F.when(end != 2, F.col("faces_detected")).alias("faces_detected"),
    )


@query("T3_highlights_missing", ALBUM + HOLE_POOLS + "SELECT project, path FROM lights WHERE pos < 24")
def highlights_missing(spark, d):
    df = album_with_holes(spark, d)
    front = sel.cover(df, ["project"], "path", "quality", "is_best_shot", "faces_detected")
    return sel.highlights(df, ["project"], "path", "quality", "is_best_shot", front).select("project", "path")


@query("T5_cover_missing", ALBUM + HOLE_POOLS + "SELECT project, path, quality FROM covers")
def cover_missing(spark, d):
    return sel.cover(album_with_holes(spark, d), ["project"], "path", "quality", "is_best_shot", "faces_detected").select("project", "path", "quality")


@query(
    "T7_browse_order",
    """WITH f AS (SELECT doc_id, concat(CASE WHEN doc_id % 2 = 0 THEN upper(source) ELSE source END, '-', doc_id, '.JPG') AS name, doc_id % 4 AS c FROM documents)
    SELECT doc_id, row_number() OVER (ORDER BY c, lower(name), doc_id) - 1 AS pos FROM f""",
)
def browse(spark, d):
    from frameloom.functions.quality import CATEGORIES

    df = table(spark, d, "documents").select(
        "doc_id", F.concat(F.when(F.col("doc_id") % 2 == 0, F.upper("source")).otherwise(F.col("source")), F.lit("-"), F.col("doc_id").cast("string"), F.lit(".JPG")).alias("name"),
        F.get(F.lit(list(CATEGORIES)), (F.col("doc_id") % 4).cast("int")).alias("category"),
    )
    order = [*sel.browse_order(df, "category", F.col("name")), F.col("doc_id")]
    return sel.ranked(df, [], order).select("doc_id", "pos")


@query("T8_pagination", "SELECT c_custkey, c_name FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 50 OFFSET 100")
def pagination(spark, d):
    return sel.page(table(spark, d, "customer"), [F.col("c_acctbal").desc(), F.col("c_custkey")], 50, 100).select("c_custkey", "c_name")


W4_SQL = """, r AS (SELECT *, row_number() OVER (PARTITION BY project ORDER BY quality DESC, path) - 1 AS q, count(*) OVER (PARTITION BY project) AS n FROM {src}),
    s AS (SELECT *, row_number() OVER (PARTITION BY project ORDER BY path) - 1 AS p, count(*) OVER (PARTITION BY project) AS total FROM r WHERE q < 3 * {count}),
    k AS (SELECT * FROM s CROSS JOIN (SELECT unnest(range(0, {count})) AS slot) WHERE n > {count} AND p >= (slot * total) // {count} AND p < ((slot + 1) * total) // {count}),
    w AS (SELECT *, row_number() OVER (PARTITION BY project, slot ORDER BY quality DESC, p) AS best FROM k)
    SELECT project, path, q AS pick FROM r WHERE n <= {count} UNION ALL SELECT project, path, slot AS pick FROM w WHERE best = 1"""


@query("W4_spread_selection", ALBUM + W4_SQL.format(src="album", count=3))
def spread_selection(spark, d):
    return sel.spread_selection(V.album(spark, d), ["project"], "path", "quality", 3).select("project", "path", "pick")


@query("W4_spread_selection_shoot", PHOTOS + W4_SQL.format(src="records", count=9))
def spread_selection_shoot(spark, d):
    return sel.spread_selection(V.records(spark, d).select("project", "path", "quality"), ["project"], "path", "quality", 9).select("project", "path", "pick")


@query(
    "W12_section_opener",
    ALBUM + "SELECT path, path = min(path) OVER (PARTITION BY project, kind) AS is_opener FROM album",
)
def openers(spark, d):
    return sel.section_openers(V.album(spark, d), ["project"], "kind", "path").select("path", "is_opener")


# -- people on photos and sections --------------------------------------------------- #
@query(
    "A7_photos_with",
    TOKENS + """SELECT path, list_contains(persons, 'bride') AS with_bride, list_has_all(persons, ['bride', 'groom']) AS couple,
    persons = ['bride'] AS bride_alone FROM tokens""",
)
def photos_with(spark, d):
    p = F.col("persons")
    return V.album_tokens(spark, d).select(
        "path", sel.has_label(p, "bride").alias("with_bride"), sel.has_all(p, F.lit(["bride", "groom"])).alias("couple"),
        sel.has_only(p, "bride").alias("bride_alone"),
    )


SECTION = "SELECT project, {n} AS ordinal, '{name}' AS section, row_number() OVER (PARTITION BY project ORDER BY {order}) - 1 AS pos, path FROM {src} WHERE {test}"
BY_QUALITY, BY_TIME = "coalesce(quality, 0) DESC, path", "taken NULLS FIRST, path"


def _sections_sql():
    tests = [
        ("Cover", "list_has_all(persons, ['bride', 'groom'])"), ("Couple", "list_has_all(persons, ['bride', 'groom'])"),
        ("Bride", "persons = ['bride']"), ("Close", "list_contains(persons, 'close_family')"),
    ]
    parts = [SECTION.format(n=i, name=n, order=BY_QUALITY, src="tokens", test=f"kind <> 'P' AND {t}") for i, (n, t) in enumerate(tests)]
    parts[0] = f"SELECT * FROM ({parts[0]}) WHERE pos < 1"
    parts[3] = f"SELECT * FROM ({parts[3]}) WHERE pos < 2"
    return " UNION ALL ".join(parts)


RULE_SPECS = (
    {"name": "Cover", "kind": "cover"},
    {"name": "Couple", "kind": "couple", "labels": ("bride", "groom")},
    {"name": "Bride", "kind": "solo", "label": "bride"},
    {"name": "Close", "kind": "group", "label": "close_family", "limit": 2},
)


def rule_sections(spark, d):
    return sel.rule_sections(
        V.album_tokens(spark, d), RULE_SPECS, ["project"], "path", "quality", "persons", eligible=F.col("kind") != "P"
    )


@query("U1_rule_sections", TOKENS + _sections_sql())
def sections(spark, d):
    return rule_sections(spark, d)


@query(
    "U1_event_section",
    SHOTS + SEGMENTS.format(us=86400 * 10**6) + """SELECT project, 0 AS ordinal, 'Second day' AS section, pos, path FROM
    (SELECT project, path, segment, row_number() OVER (PARTITION BY project, segment ORDER BY captured_at, path) - 1 AS pos FROM segments) WHERE segment = 1 AND pos < 4""",
)
def event_section(spark, d):
    seg = segmented(spark, d, 86400)
    placed = sel.ranked(seg, ["project", "segment"], sel.time_order("captured_at", "path"))
    spec = [{"name": "Second day", "kind": "event", "event_index": 1, "limit": 4}]
    return sel.rule_sections(seg, spec, ["project"], "path", "path", "path", events=placed)


@query(
    "U2_sticky_edits",
    ALBUM + """, auto AS (SELECT project, path, row_number() OVER (PARTITION BY project ORDER BY coalesce(quality, 0) DESC, path) - 1 AS pos FROM album WHERE path % 2 = 0),
    base AS (SELECT project, path, min((src, pos)) AS place FROM (SELECT project, path, 0 AS src, pos FROM auto UNION ALL SELECT project, path, 1 AS src, path AS pos FROM album WHERE path % 5 IN (0, 1)) GROUP BY project, path),
    kept AS (SELECT b.*, w.path AS wish FROM base b LEFT JOIN (SELECT project, path FROM album WHERE path % 3 = 0) w ON w.project = b.project AND w.path = b.path WHERE b.path % 7 <> 0)
    SELECT project, row_number() OVER (PARTITION BY project ORDER BY -wish NULLS LAST, place, path) - 1 AS pos, path FROM kept""",
)
def sticky(spark, d):
    df = V.album(spark, d)
    auto = sel.ranked(df.filter(F.col("path") % 2 == 0), ["project"], sel.quality_order("quality", "path")).select("project", "path", "pos")
    added = df.filter((F.col("path") % 5).isin(0, 1)).select("project", "path", F.col("path").alias("pos"))
    removed = df.filter(F.col("path") % 7 == 0).select("project", "path")
    explicit = df.filter(F.col("path") % 3 == 0).select("project", "path", (-F.col("path")).alias("pos"))
    return sel.sticky_edits(auto, added, removed, explicit, ["project"])


STORY = ALBUM + POOLS + "SELECT * FROM (" + " UNION ALL ".join(
    [
        "SELECT project, 0 AS ordinal, 'Cover' AS section, 0::BIGINT AS pos, path FROM covers",
        "SELECT project, 1 AS ordinal, 'Highlights' AS section, pos, path FROM lights WHERE pos < 24",
        SECTION.format(n=2, name="Ceremony", order=BY_TIME, src="album", test="true"),
        SECTION.format(n=3, name="Family", order=BY_QUALITY, src="album", test="face_count >= 3"),
        SECTION.format(n=4, name="Portraits", order=BY_QUALITY, src="album", test="face_count = 1"),
        "SELECT project, 5 AS ordinal, 'Closing' AS section, pos, path FROM last_ones",
    ]
) + ")"


def story_sections(spark, d):
    return sel.story(V.album(spark, d), ["project"], "path", "quality", "taken", "is_best_shot", "faces_detected", "face_count")


@query("U3_story", STORY)
def story(spark, d):
    return story_sections(spark, d)


PEOPLE_TESTS = [
    ("Couple", "list_has_all(persons, ['bride', 'groom'])"), ("Bride", "persons = ['bride']"), ("Groom", "persons = ['groom']"),
    ("Bride Family", "list_contains(persons, 'family_bride')"), ("Groom Family", "list_contains(persons, 'family_groom')"),
    ("Close Family", "list_contains(persons, 'close_family')"),
]


@query(
    "U3_story_with_people",
    TOKENS + POOLS + """, fronts AS (SELECT project, path FROM (SELECT *, row_number() OVER (PARTITION BY project ORDER BY list_has_all(persons, ['bride', 'groom']) DESC, coalesce(quality, 0) DESC, path) AS r FROM tokens) WHERE r = 1)
    SELECT project, 0 AS ordinal, 'Cover' AS section, 0::BIGINT AS pos, path FROM fronts UNION ALL """
    + " UNION ALL ".join(SECTION.format(n=i + 1, name=n, order=BY_QUALITY, src="tokens", test=t) for i, (n, t) in enumerate(PEOPLE_TESTS))
    + """ UNION ALL SELECT * FROM (SELECT project, 7 AS ordinal, 'Highlights' AS section, row_number() OVER (PARTITION BY project ORDER BY coalesce(quality, 0) DESC, path) - 1 AS pos, path FROM tokens ANTI JOIN fronts USING (project, path)) WHERE pos < 24 UNION ALL """
    + SECTION.format(n=8, name="Ceremony", order=BY_TIME, src="tokens", test="true")
    + " UNION ALL SELECT project, 9 AS ordinal, 'Closing' AS section, pos, path FROM last_ones",
)
def story_with_people(spark, d):
    return sel.story_with_people(V.album_tokens(spark, d), ["project"], "path", "quality", "taken", "persons")


@query(
    "U4_referenced_assets",
    "WITH story AS (" + STORY + """), spreads AS (SELECT o_custkey AS project, o_orderkey AS path, o_orderkey AS pos FROM orders),
    seen AS (SELECT project, path, min((src, ordinal, pos)) AS place FROM (SELECT project, path, 0 AS src, ordinal, pos FROM story UNION ALL SELECT project, path, 1, 0, pos FROM spreads) GROUP BY project, path)
    SELECT project, row_number() OVER (PARTITION BY project ORDER BY place, path) - 1 AS pos, path FROM seen""",
)
def referenced(spark, d):
    story = story_sections(spark, d)
    spreads = V.album(spark, d).select("project", F.lit(0).alias("ordinal"), F.col("path").alias("pos"), "path")
    return sel.referenced_assets(story, spreads, ["project"])


@query(
    "U5_all_photos",
    "WITH story AS (" + STORY + ") SELECT project, row_number() OVER (PARTITION BY project ORDER BY ordinal, pos) - 1 AS pos, path FROM story",
)
def all_photos(spark, d):
    return sel.all_photos(story_sections(spark, d), ["project"])


@query("A23_section_sizes", "WITH story AS (" + STORY + ") SELECT project, ordinal, section, count(*) AS photos FROM story GROUP BY ALL")
def section_sizes(spark, d):
    return sel.section_sizes(story_sections(spark, d), ["project"])


# -- colours ---------------------------------------------------------------------------- #
HSV = """, f AS (SELECT *, r / 255e0 AS rr, g / 255e0 AS gg, b / 255e0 AS bb FROM {src}),
  m AS (SELECT *, greatest(rr, gg, bb) AS v, least(rr, gg, bb) AS lo FROM f),
  h AS (SELECT *, CASE WHEN v = lo THEN 0e0 WHEN v = rr THEN (gg - bb) / (v - lo) WHEN v = gg THEN (bb - rr) / (v - lo) + 2e0 ELSE (rr - gg) / (v - lo) + 4e0 END AS sector FROM m),
  hsv AS (SELECT *, (CASE WHEN sector < 0 THEN sector / 6e0 + 1e0 ELSE sector / 6e0 END) * 360e0 AS hue, CASE WHEN v = 0 THEN 0e0 ELSE (v - lo) / v END AS s FROM h),
  ruled AS (SELECT *, CASE WHEN s < 0.18e0 AND s >= 0.08e0 AND v >= 0.55e0 AND (hue <= 65 OR hue >= 350) THEN 1 WHEN s < 0.18e0 THEN 2 WHEN hue BETWEEN 40 AND 70 AND v >= 0.4e0 THEN 3
    WHEN hue BETWEEN 80 AND 160 THEN 4 WHEN hue BETWEEN 340 AND 360 OR hue BETWEEN 0 AND 20 THEN 5 WHEN hue BETWEEN 20 AND 40 AND v >= 0.4e0 THEN 6 ELSE 7 END AS rule FROM hsv),
  based AS (SELECT *, least(1e0, greatest(0e0, (CASE rule WHEN 1 THEN 0.18e0 - s + 0.3e0 WHEN 2 THEN 0.5e0 ELSE s END) * 0.65e0 + 0.35e0)) * least(1e0, greatest(0.4e0, v)) AS base,
    CASE rule WHEN 3 THEN 55e0 WHEN 4 THEN 120e0 WHEN 5 THEN 5e0 WHEN 6 THEN 30e0 END AS centre FROM ruled),
  named AS (SELECT *, CASE rule WHEN 1 THEN 'Reception' WHEN 2 THEN 'Portraits' WHEN 3 THEN 'Haldi' WHEN 4 THEN 'Mehndi' WHEN 5 THEN 'Baraat' WHEN 6 THEN 'Reception' ELSE 'Ceremony' END AS event,
    CASE WHEN rule = 7 THEN 0.4e0 ELSE round(least(1e0, greatest(0e0, CASE WHEN centre IS NULL THEN base ELSE base * 0.5e0 + greatest(0e0, 1e0 - abs(hue - centre) / 45e0) * 0.5e0 END)), 3) END AS confidence FROM based)"""


@query(
    "F7_hue",
    with_views(V.COLOURS) + HSV.format(src="colours") + "SELECT id, round(hue, 6) AS hue, round(s, 6) AS s, round(v, 6) AS v FROM hsv",
)
def hue(spark, d):
    df = V.colours(spark, d).withColumn("c", C.hsv("r", "g", "b"))
    return df.select("id", *[F.round(F.col(f"c.{n}"), 6).alias(n) for n in ("hue", "s", "v")])


@query("P23_colour_event", with_views(V.COLOURS) + HSV.format(src="colours") + "SELECT id, event, confidence FROM named")
def colour_event(spark, d):
    return V.colours(spark, d).withColumn("e", C.colour_event("r", "g", "b")).select("id", "e.event", "e.confidence")


@query(
    "P24_event_name",
    with_views(V.COLOURS) + HSV.format(src="colours") + """SELECT id, CASE WHEN event <> 'Ceremony' AND confidence >= 0.45e0 THEN event END AS strict_name,
    CASE WHEN s >= 0.35e0 AND v >= 0.4e0 AND hue BETWEEN 40 AND 70 THEN 'Haldi' END AS loose_name FROM named""",
)
def event_names(spark, d):
    df = V.colours(spark, d).withColumn("e", C.colour_event("r", "g", "b"))
    return df.select("id", C.colour_event_name(F.col("e")).alias("strict_name"), C.loose_event_name("r", "g", "b").alias("loose_name"))


def _tint_sql(c, t):
    return f"CAST(round_even({c} * (1e0 - {t}e0) + 255e0 * {t}e0, 0) AS INTEGER)"


@query(
    "P25_theme",
    with_views(V.COLOURS) + HSV.format(src="colours")
    + f"""SELECT id, printf('#%02X%02X%02X', CAST(r AS INTEGER), CAST(g AS INTEGER), CAST(b AS INTEGER)) AS hex, printf('#%02X%02X%02X', {_tint_sql('r', 0.66)}, {_tint_sql('g', 0.66)}, {_tint_sql('b', 0.66)}) AS tint,
    CASE WHEN confidence >= 0.5e0 THEN printf('#%02X%02X%02X', {_tint_sql('pr', 0.62)}, {_tint_sql('pg', 0.62)}, {_tint_sql('pb', 0.62)}) END AS background, CASE WHEN confidence >= 0.5e0 THEN accent END AS accent
    FROM named LEFT JOIN (VALUES ('Haldi', 245, 205, 60, '#B07814'), ('Mehndi', 70, 160, 80, '#22602E'), ('Baraat', 196, 52, 48, '#781818'), ('Reception', 208, 168, 92, '#966E28')) p(ev, pr, pg, pb, accent) ON p.ev = event""",
)
def theme(spark, d):
    df = V.colours(spark, d).withColumn("t", C.themed_background(C.colour_event("r", "g", "b")))
    return df.select(
        "id", C.to_hex("r", "g", "b").alias("hex"), C.to_hex(*[C.tint(c) for c in ("r", "g", "b")]).alias("tint"),
        F.col("t.background").alias("background"), F.col("t.accent").alias("accent"),
    )


def _gain_sql(target, current, dead, low, high):
    ratio = f"({target} / {current})"
    return f"""CASE WHEN {current} <= 1e-6 THEN {high}e0 ELSE greatest({low}e0, least({high}e0, CASE WHEN abs({ratio} - 1e0) <= {dead}e0 THEN 1e0 ELSE ({ratio} - 1e0) * 0.5e0 + 1e0 END)) END"""


@query(
    "P20_edit_recipe",
    with_views(V.MEDIA) + f""", c AS (SELECT path, l_quantity * 5 AS r, (l_partkey % 256)::DOUBLE AS g, l_discount * 2000 AS b, l_tax * 3000 AS luma, l_quantity * 1.5e0 AS sd FROM media)
    SELECT path, round({_gain_sql('((r + g + b) / 3e0)', 'r', 0.06, 0.85, 1.18)}, 6) AS gain_r, round({_gain_sql('((r + g + b) / 3e0)', 'g', 0.06, 0.85, 1.18)}, 6) AS gain_g,
    round({_gain_sql('((r + g + b) / 3e0)', 'b', 0.06, 0.85, 1.18)}, 6) AS gain_b, round({_gain_sql('0.5e0', '(luma / 255e0)', 0.12, 0.8, 1.4)}, 6) AS exposure,
    round({_gain_sql('0.22e0', '(sd / 255e0)', 0.08, 0.92, 1.15)}, 6) AS contrast FROM c""",
)
def edit_recipe(spark, d):
    df = V.media(spark, d).select(
        "path", (F.col("l_quantity") * 5).alias("r"), (F.col("l_partkey") % 256).cast("double").alias("g"), (F.col("l_discount") * 2000).alias("b"),
        (F.col("l_tax") * 3000).alias("luma"), (F.col("l_quantity") * 1.5).alias("sd"),
    )
    df = df.withColumn("e", C.edit_recipe("r", "g", "b", "luma", "sd"))
    return df.select("path", *[F.round(F.col(f"e.{n}"), 6).alias(n) for n in ("gain_r", "gain_g", "gain_b", "exposure", "contrast")])


# Photos of a project are line items; each has four pixel colours made from its own columns.
PIXELS = """sampled_pixels AS (SELECT project, path, (l_partkey * k * 7 % 256)::INTEGER AS r, (l_orderkey * k * 13 % 256)::INTEGER AS g, (l_suppkey * k * 29 % 200)::INTEGER AS b FROM media, (SELECT unnest(range(1, 5)) AS k))"""
SAMPLED = """, placed AS (SELECT *, row_number() OVER (PARTITION BY project ORDER BY path) - 1 AS p, count(*) OVER (PARTITION BY project) AS n FROM media),
  picked AS (SELECT DISTINCT project, path FROM placed, (SELECT unnest(range(0, 8)) AS i) WHERE n <= 8 OR p = CAST(floor(i * (n / 8e0)) AS BIGINT))"""


@query("S5_even_sample", with_views(V.MEDIA) + SAMPLED + "SELECT project, path FROM picked")
def even_sample(spark, d):
    return E.even_sample(V.media(spark, d).select("project", "path"), ["project"], [F.col("path")]).select("project", "path")


DOMINANT = """, px AS (SELECT *, greatest(r, g, b) AS hi, least(r, g, b) AS lo FROM sampled_pixels JOIN picked USING (project, path)),
  fl AS (SELECT *, (CASE WHEN hi > 0 THEN (hi - lo) / hi::DOUBLE ELSE 0e0 END) > 0.25e0 AND hi / 255e0 > 0.2e0 AS vivid FROM px),
  mean AS (SELECT project, count(*) AS n, count(*) FILTER (vivid) AS c, avg(r) AS ar, avg(g) AS ag, avg(b) AS ab, avg(r) FILTER (vivid) AS vr, avg(g) FILTER (vivid) AS vg, avg(b) FILTER (vivid) AS vb FROM fl GROUP BY project),
  mood AS (SELECT project, CAST(round_even(CASE WHEN c > 0 AND c >= n * 0.04e0 THEN vr ELSE ar END, 0) AS INTEGER) AS r, CAST(round_even(CASE WHEN c > 0 AND c >= n * 0.04e0 THEN vg ELSE ag END, 0) AS INTEGER) AS g,
    CAST(round_even(CASE WHEN c > 0 AND c >= n * 0.04e0 THEN vb ELSE ab END, 0) AS INTEGER) AS b FROM mean)"""


def mood_colours(spark, d):
    df = V.media(spark, d)
    picked = E.even_sample(df.select("project", "path", "l_partkey", "l_orderkey", "l_suppkey"), ["project"], [F.col("path")])
    k = F.explode(F.lit([1, 2, 3, 4])).alias("k")
    px = picked.select("*", k).select(
        "project", (F.col("l_partkey") * F.col("k") * 7 % 256).cast("int").alias("r"),
        (F.col("l_orderkey") * F.col("k") * 13 % 256).cast("int").alias("g"), (F.col("l_suppkey") * F.col("k") * 29 % 200).cast("int").alias("b"),
    )
    return E.dominant_colour(px, ["project"])


@query("S5_dominant_colour", with_views(V.MEDIA, PIXELS) + SAMPLED + DOMINANT + "SELECT project, r, g, b FROM mood")
def dominant_colour(spark, d):
    return mood_colours(spark, d)


# -- event names -------------------------------------------------------------------------- #
def _keywords_sql():
    pairs = []
    for n, (event, words) in enumerate(E.EVENT_KEYWORDS.items()):
        pairs += [f"('{event}', {n}, '{w}')" for w in words]
    return f"(VALUES {', '.join(pairs)}) k(event, ord, word)"


WORDS = f"""words AS (SELECT doc_id, lang, unnest(string_split(text, ' ')) AS label, generate_subscripts(string_split(text, ' '), 1) AS spot FROM documents),
  hits AS (SELECT DISTINCT doc_id, lang, spot, event, ord, CASE WHEN spot % 4 = 0 THEN 1e0 ELSE (1 + spot % 8) / 8e0 END AS conf FROM words JOIN {_keywords_sql()} ON contains(lower(label), word)),
  scores AS (SELECT doc_id, any_value(lang) AS lang, event, any_value(ord) AS ord, sum(conf) AS score, min(spot) AS seen FROM hits GROUP BY doc_id, event),
  votes AS (SELECT doc_id, event, score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, seen, ord) AS r FROM scores) WHERE r = 1)"""


def label_votes(spark, d):
    # Every fourth label lacks its confidence.
    docs = dealt(table(spark, d, "documents"), "doc_id").select("doc_id", F.split("text", " ").alias("labels"))
    sure = F.transform("labels", lambda _, i: F.when((i + 1) % 4 != 0, (1 + (i + 1) % 8) / 8.0))
    return E.label_votes(docs.withColumn("sure", sure), ["doc_id"], "labels", "sure")


@query("A8_label_vote", f"WITH {WORDS} SELECT doc_id, event, score FROM votes")
def label_vote(spark, d):
    return label_votes(spark, d)


PHOTO_EVENTS = f"""WITH {WORDS}, cols AS (SELECT doc_id AS id, CAST(doc_id * 37 % 256 AS INTEGER) AS r, CAST(doc_id * 91 % 256 AS INTEGER) AS g, CAST(doc_id * 53 % 256 AS INTEGER) AS b FROM documents WHERE doc_id % 3 > 0)
  {HSV.format(src='cols')}, photo_events AS (SELECT d.doc_id, concat(d.lang, '/', d.source) AS grp, CASE WHEN v.score >= 20 THEN v.event WHEN n.id IS NOT NULL THEN n.event ELSE 'Ceremony' END AS event,
    CASE WHEN v.score >= 20 THEN least(1e0, v.score / 2e0) WHEN n.id IS NOT NULL THEN n.confidence ELSE 0e0 END AS confidence,
    CASE WHEN v.score >= 20 THEN 'labels' WHEN n.id IS NOT NULL THEN 'color' ELSE 'unknown' END AS source
    FROM documents d LEFT JOIN votes v ON v.doc_id = d.doc_id LEFT JOIN named n ON n.id = d.doc_id)"""


def photo_events(spark, d):
    votes = label_votes(spark, d)
    one = F.struct(*[(F.col("doc_id") * m % 256).cast("int").alias(c) for m, c in ((37, "r"), (91, "g"), (53, "b"))])
    colours = F.when(F.col("doc_id") % 3 > 0, F.array(one)).otherwise(F.array().cast("array<struct<r:int,g:int,b:int>>"))
    docs = table(spark, d, "documents").select("doc_id", F.concat("lang", F.lit("/"), "source").alias("grp"))
    named = E.photo_event(F.col("event"), F.col("score"), colours, minimum=20.0)
    return docs.join(votes, "doc_id", "left").select("doc_id", "grp", named.alias("e"))


@query("A9_photo_event", PHOTO_EVENTS + "SELECT doc_id, event, confidence, source FROM photo_events")
def photo_event(spark, d):
    return photo_events(spark, d).select("doc_id", "e.event", "e.confidence", "e.source")


GROUP_EVENTS = """, tally AS (SELECT grp, event, sum(confidence) AS total, min(doc_id) AS first_doc FROM photo_events WHERE confidence > 0 GROUP BY grp, event),
  sizes AS (SELECT grp, count(*) AS n, max(CASE WHEN confidence > 0 AND source = 'labels' THEN 2 WHEN confidence > 0 THEN 1 ELSE 0 END) AS src FROM photo_events GROUP BY grp),
  best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY total DESC, first_doc) AS r FROM tally) WHERE r = 1),
  group_events AS (SELECT s.grp, coalesce(b.event, 'Ceremony') AS event, CASE WHEN b.total IS NULL THEN 0e0 ELSE least(1e0, b.total / s.n) END AS confidence, CASE s.src WHEN 2 THEN 'labels' WHEN 1 THEN 'color' ELSE 'unknown' END AS source
    FROM sizes s LEFT JOIN best b ON b.grp = s.grp)"""


def group_events(spark, d):
    flat = photo_events(spark, d).select("doc_id", "grp", "e.event", "e.confidence", "e.source")
    return E.group_event(flat, ["grp"], "event", "confidence", "source", "doc_id")


@query("A10_group_event", PHOTO_EVENTS + GROUP_EVENTS + "SELECT grp, event, round(confidence, 6) AS confidence, source FROM group_events")
def group_event(spark, d):
    return group_events(spark, d).withColumn("confidence", F.round("confidence", 6))


@query(
    "A11_event_name",
    PHOTO_EVENTS + GROUP_EVENTS + """, moods AS (SELECT event, confidence, s, v, hue, id FROM named),
    firsts AS (SELECT concat(lang, '/', source) AS grp, min(doc_id) AS idx FROM documents GROUP BY 1)
    SELECT g.grp, coalesce(CASE WHEN g.confidence > 0.6e0 THEN g.event END, CASE WHEN m.event <> 'Ceremony' AND m.confidence >= 0.45e0 THEN m.event END,
      CASE WHEN m.s >= 0.35e0 AND m.v >= 0.4e0 AND m.hue BETWEEN 40 AND 70 THEN 'Haldi' END, concat('Event ', f.idx + 1)) AS name
    FROM group_events g LEFT JOIN firsts f ON f.grp = g.grp LEFT JOIN moods m ON m.id = f.idx""",
)
def event_name(spark, d):
    groups = group_events(spark, d)
    firsts = table(spark, d, "documents").groupBy(F.concat("lang", F.lit("/"), "source").alias("grp")).agg(F.min("doc_id").alias("idx"))
    # A group whose first document has no colour goes by its number.
    rgb = [F.when(F.col("idx") % 3 > 0, F.col("idx") * m % 256).cast("int") for m in (37, 91, 53)]
    # The vote is weakened here so that the colour rules and the number get their turn.
    sure = F.when(F.col("confidence") > 0.6, F.col("confidence")).otherwise(0.0)
    return groups.join(firsts, "grp", "left").select("grp", E.event_name(F.col("event"), sure, *rgb, F.col("idx")).alias("name"))


@query(
    "J16_event_brains",
    SHOTS + SEGMENTS.format(us=21600 * 10**6) + """, brains AS (SELECT event_id AS path, CASE WHEN event_id % 7 = 0 THEN 0 ELSE 3 END AS labels FROM events WHERE event_id % 2 = 0)
    SELECT project, segment, count(b.path) AS analysed, coalesce(CAST(sum(labels) AS BIGINT), 0) AS labels FROM segments s LEFT JOIN brains b ON b.path = s.path GROUP BY project, segment""",
)
def event_brains(spark, d):
    brains = answers(spark, d).filter(F.col("event_id") % 2 == 0).select(
        F.col("event_id").alias("path"), F.size(parse_vision_json("answer")["labels"]).alias("n"), F.lit(1).alias("hit")
    )
    return segmented(spark, d, 21600).join(brains, "path", "left").groupBy("project", "segment").agg(
        F.count("hit").alias("analysed"), F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("labels")
    )
