"""Queries of the flatten operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from carillon.operators.flatten import flatten_manifests, manifest_records, table
from carillon.tables import load


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    positions = {k: () for k in ("medium", "track", "artist", "isrc", "waveform")}
    return manifest_records(flatten_manifests(load(spark, sf_dir, "manifests"), positions))


def p5_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The track table with its parent link."""
    flat = flatten_manifests(load(spark, sf_dir, "manifests"), {"track": ("track", "title", "duration", "audio.path")})
    return table(flat, "track", ("media_pos", "track_pos"), {"track": "track", "title": "title", "duration": "duration", "audio_path": "audio.path"}).withColumnRenamed("rec_id", "manifest_id")


def p5_artists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The track-artist table with its parent link."""
    flat = flatten_manifests(load(spark, sf_dir, "manifests"), {"artist": ("name", "role")})
    return table(flat, "artist", ("media_pos", "track_pos", "item_pos"), {"name": "name", "role": "role"}).withColumnRenamed("rec_id", "manifest_id")


def p5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The media table with the number of its tracks, joined on the parent link."""
    flat = flatten_manifests(load(spark, sf_dir, "manifests"), {"medium": ("disc", "format", "title"), "track": ()})
    media = table(flat, "medium", ("media_pos",), {"disc": "disc", "format": "format", "title": "title"})
    tracks = flat.where("kind = 'track'").groupBy("rec_id", F.get("ordinals", F.lit(0)).alias("media_pos")).agg(F.count(F.lit(1)).alias("n_tracks"))
    return media.join(tracks, ["rec_id", "media_pos"], "left").select(F.col("rec_id").alias("manifest_id"), "media_pos", "disc", "format", "title", F.coalesce("n_tracks", F.lit(0)).alias("n_tracks"))


QUERIES = {"p5_found": p5_found, "p5_tracks": p5_tracks, "p5_artists": p5_artists, "p5_media": p5_media}
SQL: dict[str, str] = {}
