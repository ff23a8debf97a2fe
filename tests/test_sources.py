import json
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from frameloom.functions.quality import category, is_usable, quality_score, quality_tier
from frameloom.functions.scrub import scrub_json, scrub_text
from frameloom.operators.events import dominant_colour, or_neutral
from frameloom.operators.timeline import gap_segments
from frameloom.sources import cache, images, manifest_files, scan, sinks


def write_png(path, rgb):
    h, w, _ = rgb.shape
    raw = b"".join(b"\0" + rgb[y].astype(np.uint8).tobytes() for y in range(h))
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    path.write_bytes(
        b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")
    )


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("shoot")
    rnd = np.random.default_rng(0)
    y, x = np.mgrid[0:96, 0:128]
    waves = sum(
        rnd.normal(scale=14) * np.cos(np.pi * u * (x + 0.5) / 128) * np.cos(np.pi * v * (y + 0.5) / 96)
        for u in range(8) for v in range(8)
    )
    smooth = np.stack([128 + waves, 120 + waves, 110 + waves], axis=2).clip(0, 250).astype(int)
    (root / "sub" / "Skip Me").mkdir(parents=True)
    write_png(root / "smooth.PNG", smooth)
    write_png(root / "near.png", (smooth + rnd.integers(0, 3, smooth.shape)).clip(0, 255))
    write_png(root / "sub" / "noise.png", rnd.integers(0, 256, (96, 128, 3)))
    write_png(root / "sub" / "Skip Me" / "out.png", smooth)
    (root / "sub" / "broken.png").write_bytes(b"not an image")
    (root / "notes.txt").write_text("x")
    return root, smooth


def test_scan(spark, folder):
    got = [r.path.split("/")[-1] for r in scan.scan_media(spark, str(folder[0]), exclude=["skip me"]).collect()]
    assert sorted(got) == ["broken.png", "near.png", "noise.png", "smooth.PNG"]
    paths = [r.path for r in scan.scan_media(spark, str(folder[0])).collect()]
    assert paths == sorted(paths) and len(paths) == 5
    with pytest.raises(Exception):
        scan.scan_media(spark, str(folder[0] / "missing")).count()


def test_features(spark, folder):
    root, smooth = folder
    rows = {r.path.split("/")[-1]: r for r in images.image_features(images.read_images(spark, str(root))).collect()}
    assert not rows["broken.png"].readable and rows["broken.png"].phash is None
    gray = np.rint(smooth @ np.array([0.299, 0.587, 0.114]))
    one = rows["smooth.PNG"]
    assert one.brightness == pytest.approx(gray.mean()) and one.contrast == pytest.approx(gray.std())
    assert one.r_mean == pytest.approx(smooth[:, :, 0].mean())
    padded = np.pad(gray, 1, mode="reflect")
    lap = np.array([[padded[i, j + 1] + padded[i + 2, j + 1] + padded[i + 1, j] + padded[i + 1, j + 2] - 4 * padded[i + 1, j + 1] for j in range(128)] for i in range(96)])
    assert one.blur_score == pytest.approx(lap.var())
    bits = lambda a, b: bin((a ^ b) & (1 << 64) - 1).count("1")
    assert bits(one.phash, rows["near.png"].phash) <= 5 < bits(one.phash, rows["noise.png"].phash)
    assert rows["noise.png"].blur_score > 100 > one.blur_score
    good, bad = scan.quarantine_split(images.read_images(spark, str(root)), F.col("height") < 0)
    assert (good.count(), bad.count()) == (4, 2)


def test_injected_kernel_and_regions(spark, folder):
    out = images.image_features(images.read_images(spark, str(folder[0])), lambda row: {"n": len(row["data"])}, "path string, n long")
    assert {r.n for r in out.collect()} == {96 * 128 * 3, None}
    gray = np.zeros((20, 20))
    gray[5:10, 5:10] = np.arange(25).reshape(5, 5)
    sharp = images.region_sharpness(gray, [(0.2, 0.2, 0.4, 0.4), (0.9, 0.9, 0.01, 0.01)])
    assert sharp[0] > 0 and sharp[1] is None


def test_embedding_backend(spark):
    crops = spark.createDataFrame([(1, b"a"), (2, b"")], "id long, crop binary")
    out = images.embed_faces(crops, lambda batch: [[float(len(c)), 0.0] for c in batch], ["id"], "id long, vector array<float>")
    assert [(r.id, r.vector) for r in out.collect()] == [(1, [1.0, 0.0])]


def test_dominant_colour(spark, folder):
    px = images.image_pixels(images.read_images(spark, str(folder[0]))).withColumn("g0", F.lit(1))
    row = dominant_colour(px.select("g0", "r", "g", "b"), ["g0"]).first()
    assert all(0 <= v <= 255 for v in (row.r, row.g, row.b))
    gray = spark.createDataFrame([(1, 100, 100, 100)] * 99 + [(1, 200, 0, 0)], "k int, r int, g int, b int")
    assert tuple(dominant_colour(gray, ["k"]).first())[1:] == (101, 99, 99)
    empty = or_neutral(spark.createDataFrame([(2,)], "k int"), dominant_colour(gray, ["k"]), ["k"]).first()
    assert tuple(empty) == (2, 210, 210, 210)


def test_manifest_round_trip(spark, tmp_path):
    photos = spark.createDataFrame([("p", "a.jpg", "Review", ["bride"])], "project string, path string, category string, persons array<string>")
    manifest_files.write_manifest({"photos": photos.withColumn("unknown", F.lit(1))}, str(tmp_path / "m"))
    back = manifest_files.read_manifest(spark, str(tmp_path / "m"))
    row = back["photos"].first()
    assert (row.path, row.persons, row.quality) == ("a.jpg", ["bride"], None) and "unknown" not in back["photos"].columns
    assert back["sections"].count() == 0 and set(back) == set(manifest_files.PARTS)


def test_write_by_category(spark, tmp_path):
    df = spark.createDataFrame([("x/a.jpg", "Review"), ("y/a.jpg", "Review"), ("z/a_1.jpg", "Review"), ("z/a.jpg", "Blurry")], "path string, category string")
    named = sinks.unique_names(df, "path")
    got = {(r.path, r.target) for r in named.collect()}
    names = [t for _, t in got]
    assert ("x/a.jpg", "a.jpg") in got and ("z/a.jpg", "a.jpg") in got
    review = [r.target for r in named.collect() if r.category == "Review"]
    assert len(set(review)) == 3 and len(names) == 4
    sinks.write_by_category(named, str(tmp_path / "out"))
    assert {p.name for p in (tmp_path / "out").iterdir() if p.is_dir()} == {f"category={c}" for c in ("BestShots", "Duplicates", "Blurry", "Review")}


def test_cache(spark):
    old = spark.createDataFrame([("q", "a", 1, 10, "x"), ("f", "a", 1, 10, "y")], "namespace string, path string, size long, mtime_s long, payload string")
    files = spark.createDataFrame([("q", "a", 1, 10), ("q", "b", 2, 10), ("f", "a", 1, 11)], "namespace string, path string, size long, mtime_s long")
    assert {(r.namespace, r.path) for r in cache.to_recompute(files, old).collect()} == {("q", "b"), ("f", "a")}
    new = cache.upsert_cache(old, spark.createDataFrame([("f", "a", 1, 11, "z"), ("f", "gone", None, None, "z")], old.schema))
    assert {tuple(r) for r in new.collect()} == {("q", "a", 1, 10, "x"), ("f", "a", 1, 11, "z")}


def test_exact_gap_stays_together(spark):
    rows = [("a", "2024-01-01 10:00:00"), ("b", "2024-01-01 10:45:00"), ("c", "2024-01-01 11:30:01")]
    df = spark.createDataFrame(rows, "path string, t string").withColumn("t", F.col("t").cast("timestamp_ntz"))
    got = {r.path: r.segment for r in gap_segments(df, [], "t", "path").collect()}
    assert got == {"a": 0, "b": 0, "c": 1}
    with pytest.raises(ValueError):
        gap_segments(df, [], "t", "path", -1)


def test_quality_edges(spark):
    df = spark.createDataFrame([(0.0, 127.5, 64.0, True), (-5.0, 0.0, 0.0, False), (1e9, 127.5, 640.0, True)], "b double, l double, c double, f boolean")
    q = [r[0] for r in df.select(quality_score("b", "l", "c", "f")).collect()]
    assert q == [50.0, 0.0, 100.0]
    use = spark.createDataFrame([(15.0, 12.0), (14.9, 100.0), (20.0, 243.1)], "s double, b double").select(is_usable("s", "b"))
    assert [r[0] for r in use.collect()] == [True, False, False]
    tiers = spark.createDataFrame([(90.0,), (75.0,), (60.0,), (59.99,), (None,)], "s double").select(quality_tier("s"))
    assert [r[0] for r in tiers.collect()] == ["Hero", "BestShots", "Review", "Low", None]
    flags = spark.createDataFrame([(True, True, False), (False, True, False), (False, False, False), (None, None, None)], "b boolean, d boolean, u boolean")
    got = flags.select(category(F.col("b"), F.col("d"), F.col("u"))).collect()
    assert [r[0] for r in got] == ["BestShots", "Duplicates", "Blurry", "Review"]


def test_scrubbing(spark):
    lines = {
        "read C:\\Users\\Amy\\Pictures\\Wedding Day\\img 1.JPG ok": "read <photo.jpg> ok",
        "open D:\\Clients\\Priya": "open <path>",
        "in /home/amy/app.log and /Users/bob/x": "in /home/<user>/app.log and /Users/<user>/x",
        "at E:\\a b\\notes.txt end": "at <path> end",
        "plain text": "plain text",
        'say "E:\\one two\\b.png" and F:/c d/e.TIF.': 'say "<photo.png>" and <photo.tif>.',
        "D:\\a b G:\\c.txt x": "<path> x",
        "<D:\\a.txt>": "<D:\\a.txt>",
        "xD:\\abc": "xD:\\abc",
        "H:\\ab I:\\cd\te": "<path> <path>\te",
        "/srv/x.jpegs /srv/y.jpeg": "<photo.jpeg>",
        "": "",
    }
    df = spark.createDataFrame([(k,) for k in lines], "t string")
    assert spark.createDataFrame([(None,)], "t string").select(scrub_text("t"), scrub_json("t")).first() == (None, None)
    odd = {"{": "[redacted]", "7": "[redacted]", '{"b":1,"a":[1.5,"x\\"y",null,{}]}': '{"b":1,"a":[1.5,"x\\"y",null,{}]}', "[]": "[]"}
    assert [r[0] for r in spark.createDataFrame([(k,) for k in odd], "t string").select(scrub_json("t")).collect()] == list(odd.values())
    assert [r[0] for r in df.select(scrub_text("t")).collect()] == list(lines.values())
    deep = {"a": {"b": {"c": {"d": {"e": {"f": {"g": 1}}}}}}, "Token": "x", "list": [{"my_secret": 1, "ok": "v" * 2001}]}
    out = json.loads(spark.createDataFrame([(json.dumps(deep),)], "j string").select(scrub_json("j")).first()[0])
    assert out["Token"] == "[redacted]" and out["list"][0]["my_secret"] == "[redacted]"
    assert out["list"][0]["ok"].endswith("…[truncated]") and len(out["list"][0]["ok"]) == 2012
    assert out["a"]["b"]["c"]["d"]["e"]["f"] == {"g": "[redacted]"}


def test_halves_of_luma_round_as_the_sum_from_blue_to_red():
    tied = [(0, 20, 240), (0, 110, 70), (1, 98, 140), (2, 16, 120)]
    bgr = np.array(tied * 16, np.uint8).reshape(8, 8, 3)
    want = [round(0.114 * b + 0.587 * g + 0.299 * r) for b, g, r in tied]
    assert images.luma(bgr).reshape(-1).tolist() == want * 16


def test_a_manifest_is_gzipped(spark, tmp_path):
    """plain lines were most of what the round trip wrote."""
    from frameloom.sources import manifest_files

    photos = spark.createDataFrame([("p", "a"), ("p", None)], "project string, path string")
    manifest_files.write_manifest({"photos": photos}, str(tmp_path))
    assert [f for f in (tmp_path / "photos").glob("part-*") if f.name.endswith(".json.gz")]
    assert sorted((r.project, r.path or "") for r in manifest_files.read_manifest(spark, str(tmp_path))["photos"].collect()) == [("p", ""), ("p", "a")]
