"""Filtered, searched and paged reads over a hierarchical catalog. All take DataFrames and return one plan; none collects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from carillon.functions.text import ascii_lower, contains_nocase

MOST_LIMIT, MOST_OFFSET = 200, 100_000


def page(df: DataFrame, order: list[Column], limit: int = 50, offset: int = 0) -> DataFrame:
    """One page in a total order. Limits outside 1 to 200 and offsets outside 0 to 100,000 are errors."""
    if not 1 <= limit <= MOST_LIMIT or not 0 <= offset <= MOST_OFFSET:
        raise ValueError(f"limit must be from 1 to {MOST_LIMIT}, offset from 0 to {MOST_OFFSET}")
    return df.orderBy(*order).offset(offset).limit(limit)


def visible(status: Column, verify: Column | None = None, good: tuple[str, ...] = ("valid", "warning")) -> Column:
    """The gate: a status, and a verify status where there is one, that readers may see. Null is not visible."""
    ok = F.coalesce(status.isin(*good), F.lit(False))
    return ok if verify is None else ok & F.coalesce(verify.isin(*good), F.lit(False))


def first_by(df: DataFrame, key: str, order: list[Column], columns: dict[str, str]) -> DataFrame:
    """The first row of each key by ``order``: the join form of a correlated top-1 lookup. Aggregates before the shuffle."""
    pick = F.min_by(F.struct(*(F.col(c).alias(n) for c, n in columns.items())), F.struct(*order))
    return df.groupBy(key).agg(pick.alias("_p")).select(key, *(F.col(f"_p.{n}").alias(n) for n in columns.values()))


def list_page(
    groups: DataFrame, children: DataFrame, key: str, title: str, credit: str, date: str, child_id: str, gate: Column, query: str | None = None, recent: bool = False, limit: int = 50, offset: int = 0
) -> DataFrame:
    """Groups with at least one child behind the gate: number of such children and the earliest of them, searched by title or
    credit, ordered by credit, title and date (letters A to Z in any case, null credits first) or by the latest child."""
    shown = children.where(gate)
    per = shown.groupBy(key).agg(F.count(F.lit(1)).alias("n_children"), F.min(F.struct(date, child_id)).alias("_first"), F.max(date).alias("latest"))
    found = groups if query is None else groups.where(contains_nocase(F.col(title), query) | F.coalesce(contains_nocase(F.col(credit), query), F.lit(False)))
    joined = found.join(per, key).select(*found.columns, "n_children", F.col(f"_first.{child_id}").alias("first_child"), F.col(f"_first.{date}").alias("first_date"), "latest")
    order = [F.col("latest").desc(), F.col(key).desc()] if recent else [ascii_lower(F.col(credit)).asc_nulls_first(), ascii_lower(F.col(title)), F.col("first_date"), F.col(key)]
    return page(joined, order, limit, offset)


def credits(links: DataFrame, names: DataFrame, parent: str, link_key: str, name_key: str, name: str = "name", position: str = "position") -> DataFrame:
    """``parent, credits``: the credited names of each parent in order of position. A name repeated at one position counts once."""
    joined = links.join(names.select(F.col(name_key).alias("_k"), F.col(name).alias("_name")), F.col(link_key) == F.col("_k"))
    return joined.groupBy(parent).agg(F.transform(F.array_sort(F.collect_set(F.struct(F.col(position).alias("p"), F.col(link_key).alias("i"), F.col("_name").alias("n")))), lambda x: x["n"]).alias("credits"))


def distinct_by_first(df: DataFrame, key: str, value: str, position: str) -> DataFrame:
    """``key, values``: a key's distinct values in the order in which each first occurs."""
    first = df.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.min(position).alias("_at"))
    return first.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", F.col(value).alias("_v")))), lambda x: x["_v"]).alias("values"))


def nest(parents: DataFrame, children: DataFrame, key: str, child_order: list[str], child_fields: list[str], name: str) -> DataFrame:
    """Parents with their children as an array of structs in order; parents without children have an empty one."""
    order = F.struct(*(F.col(c).alias(f"o{k}") for k, c in enumerate(child_order)))
    packed = children.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order.alias("o"), F.struct(*child_fields).alias("v")))).alias("_a"))
    packed = packed.select(key, F.transform("_a", lambda x: x["v"]).alias(name))
    empty = F.array().cast(packed.schema[name].dataType)
    return parents.join(packed, key, "left").withColumn(name, F.coalesce(name, empty))


def first_n(df: DataFrame, key: str, order: list[Column], n: int, rank: str = "rank") -> DataFrame:
    """The first ``n`` rows of each key, numbered from 1."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col(rank) <= n)


def authorized(sessions: DataFrame, tokens: DataFrame, now: Column) -> DataFrame:
    """Sessions whose own and whose token's revocation is unset and that haven't expired: expiry at this instant still counts."""
    live = tokens.where("revoked_at is null").select(F.col("token_hash").alias("_t"))
    return sessions.where(F.col("revoked_at").isNull() & (F.col("expires_at") >= now)).join(live, F.col("token_hash") == F.col("_t"), "left_semi")


def having_several(df: DataFrame, key: str, value: str, more_than: int = 1) -> DataFrame:
    """Keys with more than so many distinct values."""
    return df.groupBy(key).agg(F.countDistinct(value).alias("n_values")).where(F.col("n_values") > more_than)


def release_assets(assets: DataFrame) -> DataFrame:
    """Assets of releases as a whole, not of a track."""
    return assets.where("track_id is null")


def track_lyrics(assets: DataFrame, whole_release: bool = False) -> DataFrame:
    """Lyrics of tracks. Asked for a whole release, only those of a track and with a digest that isn't empty."""
    rows = assets.where("kind = 'lyrics'")
    return rows.where("track_id is not null and sha256 is not null and sha256 <> ''") if whole_release else rows


def served_assets(assets: DataFrame) -> DataFrame:
    """Assets of the kinds that are handed out."""
    return assets.where(F.col("kind").isin("artwork", "booklet", "lyrics"))
