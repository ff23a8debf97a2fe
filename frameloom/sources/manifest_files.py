"""Project manifests as JSON lines, one folder per part, read back with fixed schemas."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

BOX = "struct<x:double,y:double,w:double,h:double>"
# Parts of a project and their fields; anything else in a file is ignored on reading.
PARTS = {
    "meta": "project string, version int, source_folder string, created_at string, album_spec map<string,string>",
    "photos": (
        "project string, path string, category string, quality double, blur_score double, brightness double, "
        "contrast double, usable boolean, faces_detected boolean, face_count long, is_best_shot boolean, "
        "is_duplicate boolean, capture_time string, tier string, persons array<string>, linked_path string, "
        "edit_recipe struct<gains:array<double>,exposure:double,contrast:double,straighten:double,crop:array<double>>"
    ),
    "clusters": "project string, cluster_id long, size long, centroid array<double>, representative string, label string, side string",
    "cluster_photos": "project string, cluster_id long, path string",
    "events": "project string, event_index long, name string, start_time string, end_time string",
    "sections": "project string, ordinal int, section string, kind string, pos long, path string",
    "spreads": (
        "project string, spread_index long, section string, width_px long, height_px long, "
        "placements array<struct<path:string,frame_px:array<long>,crop:array<double>,fit:string,z_index:int>>"
    ),
    "overrides": "project string, path string, category string",
    "export": "project string, key string, value string",
}


def write_manifest(parts: Mapping[str, DataFrame], folder: str, mode: str = "overwrite") -> None:
    """Write each given part under ``folder`` as gzipped lines; a project of any size is many lines, never one."""
    for name, df in parts.items():
        if name not in PARTS:
            raise ValueError(f"unknown manifest part {name!r}")
        df.write.mode(mode).option("compression", "gzip").json(f"{folder.rstrip('/')}/{name}")


def read_manifest(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """All parts; a missing one is an empty table, a missing field is null."""
    out = {}
    for name, schema in PARTS.items():
        try:
            out[name] = spark.read.schema(schema).json(f"{folder.rstrip('/')}/{name}")
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            out[name] = spark.createDataFrame([], schema)
    return out
