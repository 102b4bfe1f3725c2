"""Choosing between sources: confidence, first non-empty, representation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def confidence(id_a: Column, id_b: Column, barcode_a: Column, barcode_b: Column, isrcs_a: Column, isrcs_b: Column, count_a: Column, count_b: Column, title_a: Column, title_b: Column) -> Column:
    """exact, confirmed, probable or none: the first rule that holds."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    isrc, count = yes(F.arrays_overlap(isrcs_a, isrcs_b)), yes((count_b > 0) & (count_a == count_b))
    title = yes((title_a != "") & (title_a == title_b))
    return (
        F.when(yes(id_a == id_b), F.lit("exact")).when(yes((barcode_b != "") & (barcode_a == barcode_b)), F.lit("confirmed"))
        .when(isrc & count, F.lit("confirmed")).when(isrc | title, F.lit("probable")).otherwise(F.lit("none"))
    )


def first_set(df: DataFrame, by: str, keys: list[str], key: str, value: str, order: str) -> DataFrame:
    """``by, value``: the first non-empty value, by the keys' priority, then order."""
    rank = F.array_position(F.array(*(F.lit(k) for k in keys)), F.col(key))
    return df.where(F.col(key).isin(*keys) & (F.col(value) != "")).groupBy(by).agg(F.min_by(value, F.struct(rank, F.col(order), F.col(value))).alias(value))


def union_first(df: DataFrame, by: str, value: str, order: str) -> DataFrame:
    """``by, values``: distinct non-empty values in the order of their first place."""
    first = df.where(F.col(value) != "").groupBy(by, value).agg(F.min(order).alias("_at"))
    return first.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", F.col(value).alias("_v")))), lambda x: x["_v"]).alias("values"))


def resolve(reps: Column, primary_ok: Column, want_id: Column, want_codec: Column, lossless: Column, codecs: tuple[str, ...] = ("flac", "wav", "alac", "aiff")) -> Column:
    """The representation to play from an array of ``(id, codec, playable)``: the first with the wanted id if it is playable, else
    the first playable with the wanted codec, else the first playable lossless one; if none is wanted or found and the primary
    can't be played, the first playable; else null, the primary."""
    first = lambda a: F.get(a, F.lit(0))
    by_id = first(F.filter(reps, lambda r: r["id"] == want_id))
    by_codec = first(F.filter(reps, lambda r: r["playable"] & (F.lower(r["codec"]) == F.lower(want_codec))))
    by_loss = first(F.filter(reps, lambda r: r["playable"] & F.lower(r["codec"]).isin(*codecs)))
    chosen = F.coalesce(F.when(by_id["playable"], by_id["id"]), F.when(want_codec.isNotNull(), by_codec["id"]), F.when(lossless, by_loss["id"]))
    return F.coalesce(chosen, F.when(~primary_ok, first(F.filter(reps, lambda r: r["playable"]))["id"]))


def cross_pairs(df: DataFrame, keys: list[str], kind: str, path: str, kinds: tuple[str, str]) -> DataFrame:
    """``keys, first, second``: keys that have both kinds, with the last path of each."""
    a, b = kinds
    at = lambda k: F.max(F.when(F.col(kind) == k, F.col(path)))
    return df.groupBy(*keys).agg(at(a).alias("first"), at(b).alias("second")).where("first is not null and second is not null")
