"""As-of lookups, positions by running sums, sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def as_of(left: DataFrame, right: DataFrame, by: list[str], left_at: str, right_at: str, right_seq: str, values: list[str]) -> DataFrame:
    """Each left row with ``values`` of the last right row at or before it in its group; by ties the last in ``right_seq``; null
    before the first. Union and one window: each side is shuffled once and nothing is multiplied. Columns of the two sides must
    not clash outside ``by``."""
    pay = F.struct(*values)
    l = left.select(*left.columns, F.col(left_at).alias("_at"), F.lit(1).alias("_side"), F.lit(None).cast("bigint").alias("_seq"), F.lit(None).cast(right.select(pay.alias("p")).schema[0].dataType).alias("_pay"))
    r = right.select(*(F.col(c) if c in by else F.lit(None).cast(left.schema[c].dataType).alias(c) for c in left.columns), F.col(right_at).alias("_at"), F.lit(0).alias("_side"), F.col(right_seq).cast("bigint").alias("_seq"), pay.alias("_pay"))
    w = Window.partitionBy(*by).orderBy("_at", "_side", "_seq").rowsBetween(Window.unboundedPreceding, 0)
    out = l.unionByName(r).withColumn("_hit", F.last("_pay", ignorenulls=True).over(w)).where("_side = 1")
    return out.select(*left.columns, *(F.col(f"_hit.{v}").alias(v) for v in values))


def prefix_positions(df: DataFrame, by: str, order: list[str], length: str, start: str = "start") -> DataFrame:
    """Each row's start: the sum of the lengths before it in its group."""
    w = Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(start, F.coalesce(F.sum(length).over(w), F.lit(0)))


def sessions(events: DataFrame, by: str, at: str, gap_seconds: int) -> DataFrame:
    """``by, session, first_at, last_at, n``: a session lasts while each event comes at most the gap after the one before it: at
    exactly the gap it still lasts."""
    w = Window.partitionBy(by).orderBy(at)
    us = F.unix_micros(F.col(at).cast("timestamp"))
    new = (us - F.lag(us).over(w) > gap_seconds * 1_000_000).cast("int")
    marked = events.withColumn("_new", F.coalesce(new, F.lit(1))).withColumn("session", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(by, "session").agg(F.min(at).alias("first_at"), F.max(at).alias("last_at"), F.count(F.lit(1)).alias("n"))
