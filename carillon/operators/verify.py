"""Declared assets against an inventory of files, with ordered findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from carillon.functions.text import path_fault


def findings(assets: DataFrame, inventory: DataFrame, most_object: int = 2**34) -> DataFrame:
    """``ord, path, severity, finding``: for each declared asset (``ord, path, digest``) the first fault: unsafe path, missing file,
    too large, digest differs. Good assets give no row."""
    inv = inventory.select("path", F.col("size").alias("_size"), F.col("digest").alias("_digest"), F.lit(True).alias("_there"))
    joined = assets.join(inv, "path", "left")
    fault = (
        F.when(path_fault(F.col("path")).isNotNull(), F.lit("unsafe path")).when(F.col("_there").isNull(), F.lit("missing")).when(F.col("_size") > most_object, F.lit("too large"))
        .when(~F.col("digest").eqNullSafe(F.col("_digest")), F.lit("digest differs"))
    )
    return joined.select("ord", "path", F.lit("error").alias("severity"), fault.alias("finding")).where("finding is not null")


def unreferenced(inventory: DataFrame, assets: DataFrame, meta: Column) -> DataFrame:
    """Files that no asset names, but for those that are ``meta``."""
    return inventory.where(~meta).join(assets.select("path").distinct(), "path", "left_anti")


def over_budget(objects: DataFrame, by: str, order: str, digest: str, size: str, budget: int) -> DataFrame:
    """``by, order, digest, used``: objects from which on a package's budget is exceeded; an object that stands there twice counts
    once, at its first place."""
    first = objects.groupBy(by, digest).agg(F.min(F.struct(order, size)).alias("_f")).select(by, digest, F.col(f"_f.{order}").alias(order), F.col(f"_f.{size}").alias(size))
    run = F.sum(size).over(Window.partitionBy(by).orderBy(order, digest).rowsBetween(Window.unboundedPreceding, 0))
    return first.withColumn("used", run).where(F.col("used") > budget).select(by, order, digest, "used")


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that stand in more than one row."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def same_members(a: DataFrame, b: DataFrame, by: str, member: list[str]) -> DataFrame:
    """``by, equal``: whether both sides have the same members, for every key on either side."""
    x = a.select(by, *member).distinct().withColumn("_a", F.lit(1))
    y = b.select(by, *member).distinct().withColumn("_b", F.lit(1))
    both = x.join(y, [by, *member], "full_outer")
    return both.groupBy(by).agg(F.bool_and(F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("equal"))


def waveform_fault(size: Column, points: Column, interval_ms: Column, duration_s: Column) -> Column:
    """A waveform's fault: a size other than two bytes a point, or a length that is over two buckets from the track's."""
    return F.when(size != points * 2, F.lit("size differs")).when(F.abs(points * interval_ms - duration_s * 1000) > 2 * interval_ms, F.lit("duration differs"))
