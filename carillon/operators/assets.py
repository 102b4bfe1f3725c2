"""Declared assets of manifests, in traversal order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from carillon.operators.flatten import MANIFEST_GROUPS, WRAPPERS, Group, flatten

_FILE = ("path", "sha256")
_KNOWN = frozenset({"path", "sha256", "role", "kind", "label", "codec", "mimeType", "lang", "id"})
_TRACK = MANIFEST_GROUPS[0].groups[0]
#: Every group of a manifest that names files.
ASSET_GROUPS = (
    Group("medium", ("media",), ("disc",), MANIFEST_GROUPS[0].known, groups=(
        Group("track", ("tracks",), ("track",), _TRACK.known, groups=(
            Group("audio", ("audio",), _FILE, _KNOWN, need="path"),
            Group("representation", ("representations",), (*_FILE, "id", "codec"), _KNOWN, need="path"),
            Group("waveform", ("waveform",), _FILE, _KNOWN | {"version", "points", "intervalMs"}, need="path"),
            Group("track_lyrics", ("lyrics",), (*_FILE, "lang"), _KNOWN, need="path"),
        )),
    )),
    *(Group(n, (n,), (*_FILE, "role"), _KNOWN, need="path") for n in ("artwork", "booklet", "lyrics", "extras", "analysis")),
)
#: The order of kinds in a packed container.
PACK_ORDER = ("audio", "representation", "waveform", "track_lyrics", "artwork", "booklet", "lyrics", "extras", "analysis")


def asset_rows(manifests: DataFrame) -> DataFrame:
    """``manifest_id, ord, kind, media_pos, track_pos, item_pos, path, sha256``: every declared file; ``ord`` is its place from 0 in
    the order of a packed container (by kind, then position)."""
    flat = flatten(manifests, "manifest_id", "manifest", ASSET_GROUPS, "media", WRAPPERS).where(F.col("kind").isin(*PACK_ORDER))
    deep = F.size("ordinals") > 1
    pos = lambda k: F.when(deep, F.get("ordinals", F.lit(k))).otherwise(F.lit(0))
    rows = flat.select(
        F.col("rec_id").alias("manifest_id"), "kind", pos(0).alias("media_pos"), pos(1).alias("track_pos"), F.element_at("ordinals", -1).alias("item_pos"), F.col("fields").getItem("path").alias("path"), F.col("fields").getItem("sha256").alias("sha256"))
    rank = F.array_position(F.array(*(F.lit(k) for k in PACK_ORDER)), F.col("kind"))
    w = Window.partitionBy("manifest_id").orderBy(rank, "media_pos", "track_pos", "item_pos")
    return rows.withColumn("ord", F.row_number().over(w) - 1)


def cover_rank(parent: Column, name: Column, path: Column, names: tuple[str, ...] = ("cover", "front", "folder"), exts: tuple[str, ...] = ("jpg", "jpeg", "png")) -> Column:
    """A sortable rank of a possible cover: the root before folders, then by name, extension, path."""
    low = F.lower(name)
    stem, ext = F.regexp_replace(low, r"\.[^.]*$", ""), F.regexp_extract(low, r"\.([^.]*)$", 1)
    at = lambda c, table: F.coalesce(F.nullif(F.array_position(F.array(*(F.lit(x) for x in table)), c), F.lit(0)) - 1, F.lit(9))
    return F.struct((parent != "").cast("int").alias("sub"), at(stem, names).alias("name"), at(ext, exts).alias("ext"), path.alias("path"))


def repair_numbers(tracks: DataFrame, by: list[str], number: str, order: list[Column], out: str = "number") -> DataFrame:
    """Track numbers as they are, or 1 to n by ``order`` for a disc on which one is missing or stands twice."""
    per = tracks.groupBy(*by).agg((F.count_if(F.col(number).isNull()) + F.count(number) - F.countDistinct(number)).alias("_bad"))
    r = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return tracks.join(per, by).withColumn(out, F.when(F.col("_bad") > 0, r).otherwise(F.col(number))).drop("_bad")


def first_installed(wanted: DataFrame, packages: DataFrame, key: str, order: str, state: str = "state") -> DataFrame:
    """Each wanted key with the first package, by ``order``, that has it and is ok."""
    ok = packages.where(F.col(state) == "ok").groupBy(key).agg(F.min_by("package", order).alias("package"))
    return wanted.join(ok, key, "left")


def neighbour_keys(near: DataFrame, by_index: DataFrame, by_path: DataFrame) -> DataFrame:
    """Neighbours named by index, else by a known path, else by the literal path."""
    a = by_index.select(F.col("index").alias("index"), F.col("key").alias("_a"))
    b = by_path.select(F.col("path").alias("path"), F.col("key").alias("_b"))
    return near.join(a, "index", "left").join(b, "path", "left").withColumn("key", F.coalesce("_a", "_b", "path")).drop("_a", "_b")


def append_page(shown: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """A page added to what is shown, without the rows already there."""
    return shown.unionByName(fresh.join(shown.select(key), key, "left_anti"))


def representation_rows(primary: DataFrame, variants: DataFrame, track: str, order: str) -> DataFrame:
    """``track, ord, id, label``: each track's primary audio as ``primary``, then its variants in their order; variants of other tracks
    are left out."""
    first = primary.select(track, F.lit(-1).cast("bigint").alias("_p"), F.lit("primary").alias("id"), "label")
    rest = variants.join(primary.select(track), track, "left_semi").select(track, F.col(order).cast("bigint").alias("_p"), "id", "label")
    w = Window.partitionBy(track).orderBy("_p")
    return first.unionByName(rest).withColumn("ord", F.row_number().over(w).cast("bigint")).drop("_p")
