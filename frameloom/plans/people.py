"""Queries over faces and people."""

from __future__ import annotations

from pyspark.sql import functions as F

from frameloom.functions.vectors import threshold_for
from frameloom.operators import people as P
from frameloom.operators import selection as sel
from frameloom.plans import views as V
from frameloom.plans.registry import query, table, with_views
from frameloom.session import cut

FACES = with_views(V.FACES)
LIMIT = 0.6
SUM = "list_sum(list_transform(range(1, 65), lambda i: {a}[i] * {b}[i]))"
DOT = SUM.format(a="x.v", b="y.v")


@query(
    "J4_cosine_pairs",
    FACES + f"SELECT x.vec_id AS a, y.vec_id AS b, round(1e0 - {DOT}, 6) AS distance FROM faces x JOIN faces y ON x.vec_id < y.vec_id WHERE 1e0 - {DOT} <= {LIMIT}e0",
)
def cosine_pairs(spark, d):
    return P.cosine_pairs(V.faces(spark, d, filled=True), [], "vec_id", "v", LIMIT).withColumn("distance", F.round("distance", 6))


# Known people stand for clusters where a cluster is only an input.
CENTROIDS = """, means AS (SELECT label, i, avg(v[i]) AS m, count(*) AS size FROM faces, (SELECT unnest(range(1, 65)) AS i) GROUP BY label, i),
  cents AS (SELECT label, any_value(size) AS size, list(m / n ORDER BY i) AS c FROM (SELECT *, sqrt(sum(m * m) OVER (PARTITION BY label)) AS n FROM means) GROUP BY label)"""


@query(
    "A4_centroid",
    FACES + CENTROIDS + "SELECT label, size, i AS element, round(c[i], 6) AS value FROM cents, (SELECT unnest(range(1, 65)) AS i)",
)
def centroid(spark, d):
    c = P.centroids(V.faces(spark, d), ["label"], "v", V.DIM)
    return c.select("label", "size", F.posexplode("centroid").alias("p", "value")).select(
        "label", "size", (F.col("p") + 1).cast("long").alias("element"), F.round("value", 6).alias("value")
    )


PROFILES = ", profiles AS (SELECT label, count(*) AS size, count(DISTINCT image) AS photos, min(image) AS representative FROM faces GROUP BY label HAVING count(*) >= 2)"


def profiles(spark, d):
    return P.cluster_profiles(V.faces(spark, d), ["label"], "image")


@query("A5_cluster_profile", FACES + PROFILES + "SELECT * FROM profiles")
def cluster_profile(spark, d):
    return profiles(spark, d)


@query("T6_review_order", FACES + PROFILES + "SELECT label, size, row_number() OVER (ORDER BY size DESC, label) - 1 AS pos FROM profiles")
def review_order(spark, d):
    return sel.ranked(profiles(spark, d), [], P.review_order("label")).select("label", "size", "pos")


ROLES = "(SELECT * FROM (VALUES (0, 'bride', NULL), (1, 'groom', NULL), (2, 'mother', 'bride'), (3, 'relative', 'groom'), (4, '', NULL), (5, 'friend', 'groom'), (6, 'mother', 'groom')) t(cluster, label, side))"


def roles(spark, d):
    """Labels of the known people; the clusters come from the given table."""
    names = F.lit(["bride", "groom", "mother", "relative", "", "friend", "mother"])
    sides = F.array(*[F.lit(s).cast("string") for s in (None, None, "bride", "groom", None, "groom", "groom")])
    return table(spark, d, "embeddings").select(F.col("label").alias("cluster")).distinct().filter(F.col("cluster") < 7).select(
        "cluster", F.get(names, F.col("cluster")).alias("label"), F.get(sides, F.col("cluster")).alias("side")
    )


def members(spark, d):
    return V.faces(spark, d).select("vec_id", "image", F.col("label").alias("cluster"))


TOKENS_SQL = f""", roles AS {ROLES}, toks AS (SELECT cluster, unnest(CASE label WHEN 'mother' THEN ['family_' || side, 'close_family'] WHEN 'relative' THEN ['family_' || side] WHEN '' THEN [] ELSE [label] END) AS token FROM roles),
  present AS (SELECT DISTINCT image, token FROM faces f JOIN toks t ON t.cluster = f.label)"""


@query("A6_persons_per_photo", FACES + TOKENS_SQL + "SELECT image, string_agg(token, ',' ORDER BY token) AS persons FROM present GROUP BY image")
def persons_per_photo(spark, d):
    out = P.persons_per_photo(members(spark, d), roles(spark, d), [], "image")
    return out.select("image", F.array_join("persons", ",").alias("persons"))


@query("J15_people_present", FACES + TOKENS_SQL + "SELECT DISTINCT image, r.label FROM faces f JOIN roles r ON r.cluster = f.label WHERE r.label <> ''")
def people_present(spark, d):
    return P.people_present(members(spark, d), roles(spark, d), [], "image")


@query(
    "T9_labelled_clusters",
    FACES + PROFILES + TOKENS_SQL + "SELECT p.label AS cluster, r.label, size, row_number() OVER (ORDER BY size DESC, p.label) - 1 AS pos FROM profiles p JOIN roles r ON r.cluster = p.label WHERE r.label <> ''",
)
def labelled_clusters(spark, d):
    named = P.labelled_clusters(profiles(spark, d).withColumnRenamed("label", "cluster"), roles(spark, d), [])
    return sel.ranked(named, [], P.review_order("cluster")).select("cluster", "label", "size", "pos")


# The faces of every second known person are a project, which grows with the table. Its saved labels are the centroids of every other face, its clusters all
# faces of a label.
J5_SQL = """WITH RECURSIVE """ + V.FACES + """, spread AS (SELECT (label % 2)::BIGINT AS project, vec_id, label, i, v[i] AS x FROM faces, (SELECT unnest(range(1, 65)) AS i)),
  means AS (SELECT project, label, i, avg(x) AS m, avg(x) FILTER (vec_id % 2 = 0) AS half FROM spread GROUP BY ALL),
  cents AS (SELECT project, label, list(m ORDER BY i) AS c, sqrt(sum(m * m)) AS n FROM means GROUP BY ALL),
  saved AS (SELECT project, label, list(half ORDER BY i) AS c, sqrt(sum(half * half)) AS n FROM means WHERE half IS NOT NULL GROUP BY ALL),
  near AS (SELECT s.project, s.label AS ordinal, k.label AS cluster, 1e0 - list_sum(list_transform(range(1, 65), lambda i: s.c[i] / s.n * (k.c[i] / k.n))) AS distance FROM saved s JOIN cents k ON k.project = s.project),
  cand AS (SELECT * FROM near WHERE distance <= 1.05e0),
  walk AS (SELECT project, -1 AS ordinal, []::INTEGER[] AS taken, NULL::INTEGER AS cluster, NULL::DOUBLE AS distance FROM (SELECT DISTINCT project FROM saved)
    UNION ALL SELECT project, ordinal + 1, CASE WHEN pick IS NULL THEN taken ELSE list_append(taken, pick) END, pick, gap FROM (
      SELECT w.project, w.ordinal, w.taken, arg_min(c.cluster, (c.distance, -c.cluster)) AS pick, min(c.distance) AS gap
      FROM walk w LEFT JOIN cand c ON c.project = w.project AND c.ordinal = w.ordinal + 1 AND NOT list_contains(w.taken, c.cluster)
      WHERE w.ordinal < 60 GROUP BY w.project, w.ordinal, w.taken))
  SELECT project, ordinal, concat('person ', ordinal) AS label, cluster, round(distance, 6) AS distance FROM walk WHERE cluster IS NOT NULL"""


@query("J5_nearest_label", J5_SQL)
def nearest_label(spark, d):
    f = V.faces(spark, d).withColumn("project", (F.col("label") % 2).cast("long"))
    saved = P.centroids(f.filter(F.col("vec_id") % 2 == 0), ["project", "label"], "v", V.DIM).select(
        "project", F.col("label").alias("ordinal"), F.concat(F.lit("person "), F.col("label").cast("string")).alias("label"), "centroid"
    )
    clusters = P.centroids(f, ["project", "label"], "v", V.DIM).select("project", F.col("label").alias("cluster"), "centroid")
    bound = P.nearest_labels(saved, clusters, ["project"], 1.05)
    return bound.select("project", "ordinal", "label", "cluster", F.round("distance", 6).alias("distance"))


@query(
    "C4_threshold_by_backend",
    """SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 0.55e0 WHEN 1 THEN 0.4e0 WHEN 2 THEN 0.55e0 WHEN 3 THEN 0.55e0 ELSE 0.55e0 END AS threshold FROM part""",
)
def thresholds(spark, d):
    names = F.lit([" ArcFace", "SFACE ", "buffalo_l", "insightface", "something else"])
    return table(spark, d, "part").select("p_partkey", threshold_for(F.get(names, (F.col("p_partkey") % 5).cast("int"))).alias("threshold"))


# -- clusters: the faces of every fourth known person are one project, which grows with the table ------ #
NEAR = 0.75
LINKAGE = "WITH RECURSIVE " + V.FACES + f""", placed AS (SELECT *, (label % 4)::BIGINT AS project, row_number() OVER (PARTITION BY label % 4 ORDER BY vec_id) AS i FROM faces),
  pairs AS (SELECT x.project, x.i, y.i AS j, 1e0 - {DOT} AS d FROM placed x JOIN placed y ON x.project = y.project AND x.i < y.i),
  walk AS (SELECT project, 0 AS step, list(vec_id ORDER BY i) AS cl FROM placed GROUP BY project
    UNION ALL SELECT project, step + 1, list_transform(cl, lambda c: CASE WHEN c = b THEN a ELSE c END) FROM (
      SELECT project, step, cl, a, b, row_number() OVER (PARTITION BY project ORDER BY d, a, b) AS r FROM (
        SELECT w.project, w.step, w.cl, least(w.cl[p.i], w.cl[p.j]) AS a, greatest(w.cl[p.i], w.cl[p.j]) AS b, avg(d) AS d
        FROM walk w JOIN pairs p ON p.project = w.project AND w.cl[p.i] <> w.cl[p.j] GROUP BY ALL) WHERE d <= {NEAR}e0) WHERE r = 1),
  last AS (SELECT project, arg_max(cl, step) AS cl FROM walk GROUP BY project),
  grouped AS (SELECT p.project, p.vec_id, p.image, p.label, cl[i] AS cluster FROM placed p JOIN last USING (project))"""


def clustered(spark, d):
    f = V.faces(spark, d).withColumn("project", (F.col("label") % 4).cast("long"))
    return cut(P.average_linkage_clusters(f, ["project"], "vec_id", "v", NEAR, V.DIM).select("project", "vec_id", "image", "label", "cluster"))


CLUSTER_PROFILES = ", profiles AS (SELECT project, cluster, count(*) AS size, count(DISTINCT image) AS photos, min(image) AS representative FROM grouped GROUP BY project, cluster)"


@query(
    "C2_average_linkage",
    LINKAGE + CLUSTER_PROFILES + """ SELECT project, row_number() OVER (PARTITION BY project ORDER BY size DESC, representative, cluster) - 1 AS cluster_id, cluster, size, photos, representative FROM profiles WHERE size >= 2""",
)
def clusters(spark, d):
    profiles_ = P.cluster_profiles(clustered(spark, d), ["project", "cluster"], "image")
    return P.numbered_clusters(profiles_, ["project"]).select("project", "cluster_id", "cluster", "size", "photos", "representative")


@query(
    "C5_group_by_person",
    LINKAGE + CLUSTER_PROFILES + """, named AS (SELECT *, row_number() OVER (PARTITION BY project ORDER BY size DESC, representative, cluster) AS n FROM profiles),
    kept AS (SELECT project, cluster, concat('Person ', n) AS person FROM named WHERE photos >= 3)
    SELECT DISTINCT g.project, person, image FROM grouped g JOIN kept k ON k.project = g.project AND k.cluster = g.cluster
    UNION ALL SELECT DISTINCT project, 'Everyone', image FROM grouped WHERE project NOT IN (SELECT project FROM kept)""",
)
def by_person(spark, d):
    c = clustered(spark, d)
    return P.group_by_person(c, c, ["project"], "image")


@query(
    "A21_purity",
    LINKAGE + """, n AS (SELECT project, cluster, label, count(*) AS n FROM grouped GROUP BY ALL), m AS (SELECT project, cluster, max(n) AS major, sum(n) AS n FROM n GROUP BY ALL)
    SELECT count(*) AS clusters_found, round(sum(major) / sum(n), 6) AS purity, (SELECT count(DISTINCT label) FROM faces) AS true_people FROM m""",
)
def purity(spark, d):
    # A cluster is known by its smallest face, so its name is unique over all projects.
    return P.purity(clustered(spark, d), "cluster", "label").withColumn("purity", F.round("purity", 6))


@query(
    "A21_purity_of_images",
    FACES + """, n AS (SELECT image, label, count(*) AS n FROM faces GROUP BY ALL), m AS (SELECT image, max(n) AS major, sum(n) AS n FROM n GROUP BY image)
    SELECT count(*) AS clusters_found, round(sum(major) / sum(n), 6) AS purity, (SELECT count(DISTINCT label) FROM faces) AS true_people FROM m""",
)
def purity_of_images(spark, d):
    return P.purity(V.faces(spark, d), "image", "label").withColumn("purity", F.round("purity", 6))


PAIRS = FACES + f", pairs AS (SELECT x.label = y.label AS same, 1e0 - {DOT} AS d FROM faces x JOIN faces y ON x.vec_id < y.vec_id)"


@query(
    "A19_pair_distances",
    PAIRS + """SELECT count(*) FILTER (same) AS same_pairs, round(avg(d) FILTER (same), 6) AS same_mean, round(max(d) FILTER (same), 6) AS same_max,
    count(*) FILTER (NOT same) AS diff_pairs, round(avg(d) FILTER (NOT same), 6) AS diff_mean, round(min(d) FILTER (NOT same), 6) AS diff_min,
    round(avg(d) FILTER (NOT same) - avg(d) FILTER (same), 6) AS separation FROM pairs""",
)
def pair_distances(spark, d):
    out = P.separation(P.pair_statistics(V.faces(spark, d), [], "vec_id", "v", "label"), [])
    return out.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes])


@query(
    "A20_best_threshold",
    PAIRS + """, t AS (SELECT DISTINCT round(d, 3) AS t FROM pairs), s AS (SELECT t, (count(*) FILTER (same AND d <= t) + count(*) FILTER (NOT same AND d > t)) / count(*) AS accuracy FROM t, pairs GROUP BY t)
    SELECT t AS threshold, round(accuracy, 6) AS accuracy FROM s ORDER BY accuracy DESC, t LIMIT 1""",
)
def best_threshold(spark, d):
    return P.best_threshold(V.faces(spark, d), "vec_id", "v", "label").withColumn("accuracy", F.round("accuracy", 6))


@query(
    "A22_mean_norm",
    "SELECT round(avg(sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x)))), 6) AS mean_norm, count(*) AS vectors FROM embeddings",
)
def mean_norm(spark, d):
    return P.mean_norm(table(spark, d, "embeddings"), "embedding").withColumn("mean_norm", F.round("mean_norm", 6))


@query(
    "F3_unit_vectors",
    FACES + "SELECT vec_id, round(list_sum(list_transform(v, lambda x: x * x)), 6) AS squared, round(v[1], 6) AS first FROM faces",
)
def unit_vectors(spark, d):
    squared = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    return V.faces(spark, d).select("vec_id", F.round(squared, 6).alias("squared"), F.round(F.get("v", F.lit(0)), 6).alias("first"))


@query(
    "F4_cosine_distance",
    FACES + f"SELECT x.vec_id, round(1e0 - {DOT}, 6) AS distance FROM faces x JOIN faces y ON y.vec_id = x.vec_id + 1",
)
def cosine_distance(spark, d):
    from frameloom.functions.vectors import cosine_distance

    f = V.faces(spark, d)
    other = f.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("w"))
    return f.join(other, "vec_id").select("vec_id", F.round(cosine_distance(F.col("v"), F.col("w")), 6).alias("distance"))


@query(
    "S4_sign_hash",
    with_views(V.HASHES) + "SELECT path, hash FROM hashes",
)
def sign_hash(spark, d):
    return V.hashes(spark, d)
