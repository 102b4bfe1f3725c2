"""Queries of this subpackage, by problem, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from carillon.llm.forest import neighbours, similar_pairs
from carillon.llm.history import first_of_package
from carillon.llm.mixing import mix, shares, tidy
from carillon.llm.names import same_entity_pairs
from carillon.llm.packing import fill_report, pack
from carillon.llm.privacy import find, replace
from carillon.llm.textforms import with_forms
from carillon.llm.tokens import with_tokens
from carillon.operators.flatten import flatten_manifests, table
from carillon.session import stage
from carillon.tables import load


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return first_of_package(load(spark, sf_dir, "vectors"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return same_entity_pairs(load(spark, sf_dir, "artists"))


def _visible_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``field, rec_id, media_pos, track_pos, value``: artist names and the manifests' track titles."""
    artists = load(spark, sf_dir, "artists").select(F.lit("artists.name").alias("field"), F.col("id").alias("rec_id"), F.lit(0).alias("media_pos"), F.lit(0).alias("track_pos"), F.col("name").alias("value"))
    tracks = table(flatten_manifests(load(spark, sf_dir, "manifests"), {"track": ("title",)}), "track", ("media_pos", "track_pos"), {"value": "title"})
    return artists.unionByName(tracks.select(F.lit("tracks.title").alias("field"), "rec_id", "media_pos", "track_pos", "value"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_forms(_visible_texts(spark, sf_dir), "value").where(F.size("kinds") > 0).select("field", "rec_id", "media_pos", "track_pos")


def p3_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every value in its common form."""
    return with_forms(_visible_texts(spark, sf_dir).where("value is not null"), "value").select("field", "rec_id", "media_pos", "track_pos", "form")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_pairs(neighbours(load(spark, sf_dir, "analyzed"), "analyzed_id", "vector", 64, k=5, least=0.87))


def _findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(load(spark, sf_dir, "documents"), load(spark, sf_dir, "artists"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _findings(spark, sf_dir).select("doc_id", "kind", "start_at")


def p8_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with placeholders in place of its findings."""
    return replace(load(spark, sf_dir, "documents"), _findings(spark, sf_dir))


def _sized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's size in tokens, counted once."""
    docs = load(spark, sf_dir, "documents").select("doc_id", tidy(F.col("source")).alias("source"), "text")
    return stage(with_tokens(docs), "sizes")


def p6_packs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_sized(spark, sf_dir).select("doc_id", "n_tokens"), load(spark, sf_dir, "pack_sizes"))


def p6_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_report(p6_packs(spark, sf_dir), load(spark, sf_dir, "pack_sizes"))


def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(_sized(spark, sf_dir), load(spark, sf_dir, "mix_targets"))


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shares(_sized(spark, sf_dir), load(spark, sf_dir, "mix_targets"))


def p7_shares_large(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixes at the size of all documents' tokens, which some sources can't reach at their target share."""
    sized = _sized(spark, sf_dir)
    return shares(sized, load(spark, sf_dir, "mix_targets"), total=float(sized.agg(F.sum("n_tokens")).first()[0] or 0))


def p7_tempered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixes by temperature: own shares exponentiated, the exponent bisected to the repetition limit."""
    return mix(_sized(spark, sf_dir), load(spark, sf_dir, "mix_targets"), by="repeats")


def p7_tempered_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixes by temperature with the entropy of their target shares."""
    return shares(_sized(spark, sf_dir), load(spark, sf_dir, "mix_targets"), by="entropy")


QUERIES = {"p6_packs": p6_packs, "p6_fill": p6_fill, "p7_mix": p7_mix, "p7_shares": p7_shares, "p7_shares_large": p7_shares_large, "p7_tempered": p7_tempered, "p7_tempered_shares": p7_tempered_shares, "p8_found": p8_found, "p8_texts": p8_texts, "p1_found": p1_found, "p2_found": p2_found, "p3_found": p3_found, "p3_forms": p3_forms, "p4_found": p4_found}
SQL: dict[str, str] = {}
