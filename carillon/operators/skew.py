"""Joins and ranks that stay whole and balanced when one key holds a large part of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A key is heavy when it holds more than one row in HEAVY_SHARE; so there are at most HEAVY_SHARE heavy keys, whatever the size.
HEAVY_SHARE = 1000


def heavy_keys(df: DataFrame, key: str, total: int, least: int = 10_000) -> DataFrame:
    """Keys with more than ``max(least, total / HEAVY_SHARE)`` rows: at most HEAVY_SHARE of them. Counted with map-side combining."""
    limit = max(least, total // HEAVY_SHARE)
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > limit).select(key)


def lookup_join(big: DataFrame, small: DataFrame, key: str, heavy: DataFrame | None, how: str = "inner") -> DataFrame:
    """``big`` joined to ``small``, in which ``key`` is unique (or nearly). Rows of heavy keys meet a broadcast of the heavy
    keys' few rows (at most HEAVY_SHARE keys, see ``heavy_keys``), all others a shuffled join whose groups are bounded.
    Null keys match nothing: an inner join drops those rows, a left join keeps them. Columns other than ``key`` must not clash."""
    if heavy is None:
        return big.join(small, key, how)
    few = F.broadcast(heavy)
    return big.join(few, key, "left_anti").join(small, key, how).unionByName(
        big.join(few, key, "left_semi").join(F.broadcast(small.join(few, key, "left_semi")), key, how)
    )


def first_k(df: DataFrame, key: list[str], order: list[Column], k: int, rank: str = "_rank") -> DataFrame:
    """The first ``k`` rows of each key. Spark cuts each map task's share to ``k`` per key before the shuffle (WindowGroupLimit),
    so a heavy key moves at most ``k`` rows a task."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def global_rank(df: DataFrame, order: list[Column], rank: str = "rank") -> DataFrame:
    """Each row's place from 1 in one order of all rows, without any task that sees more than its part: rows are range-sorted and
    written, one count a part comes to the driver, and a row's place is its part's start plus its place there."""
    from carillon.session import stage

    spark = df.sparkSession
    placed = df.orderBy(*order).withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    placed = stage(placed, "ranked")
    counts = sorted((r[0], r[1]) for r in placed.groupBy("_part").agg(F.count(F.lit(1))).collect())
    starts, total = [], 0
    for part, n in counts:
        starts.append((part, total))
        total += n
    table = F.broadcast(spark.createDataFrame(starts, "_part int, _start bigint"))  # one row a part
    return placed.join(table, "_part").withColumn(rank, F.col("_start") + F.col("_at") + 1).drop("_part", "_at", "_start")
