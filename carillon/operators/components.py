"""Connected components by alternating large-star and small-star steps on written stages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from carillon.operators.skew import heavy_keys, lookup_join
from carillon.session import StageLog


def _least(edges: DataFrame, node: str, other: str) -> DataFrame:
    return edges.groupBy(F.col(node).alias("u")).agg(F.min(other).alias("m"))


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60, log: StageLog | None = None) -> DataFrame:
    """Components of an undirected graph given by bigint pairs.

    Returns ``node, root``: one row per node that has an edge, ``root`` the least node of its component. Self-loops give a row of
    their own; rows with a null end are ignored; repeated edges count once; an empty input gives an empty table. The number of
    rounds grows with the logarithm of the longest path; each round moves each edge once, with minima combined before the
    shuffle, and a node with very many edges is joined apart (``lookup_join``). Only one number a round comes to the driver.
    Of the written stages only the result stays; ``log`` is the caller's, which then deletes it with its own.
    """
    spark = edges.sparkSession
    own = StageLog(spark)
    a, b = F.col(src).cast("bigint"), F.col(dst).cast("bigint")

    def write(df: DataFrame) -> tuple[DataFrame, tuple[int, int | None]]:
        """A stage of edges, and its count and signature, taken while it is written."""
        seen = Observation()
        out = own.stage(df.observe(seen, F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("mark")), "cc-edges")
        return out, (seen.get["n"], seen.get["mark"])

    both = edges.where(a.isNotNull() & b.isNotNull()).select(a.alias("s"), b.alias("d"))
    nodes = own.stage(both.select(F.col("s").alias("node")).union(both.select("d")).distinct(), "cc-nodes")
    cur, (n, mark) = write(both.where("s <> d").select(F.greatest("s", "d").alias("u"), F.least("s", "d").alias("v")).distinct())
    for _ in range(max_rounds):
        if n == 0:
            break
        # large star: every neighbour above the node hangs on the node's least neighbour
        sym = cur.select("u", "v").union(cur.select("v", "u").toDF("u", "v"))
        # at most HEAVY_SHARE keys come to the driver
        heavy = spark.createDataFrame(heavy_keys(sym, "u", 2 * n).collect(), "u bigint") if n > 100_000 else None
        mins = _least(sym, "u", "v").select("u", F.least("u", "m").alias("m"))
        large = lookup_join(sym, mins, "u", heavy).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: every neighbour below the node, and the node, hang on the least
        low = _least(large, "u", "v")
        hang = lookup_join(large, low, "u", heavy).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        nxt, now = write(hang.union(low.select("u", F.col("m").alias("v"))).distinct())
        own.drop(cur)
        cur, before, (n, mark) = nxt, (n, mark), now
        if (n, mark) == before:
            break
    else:
        raise RuntimeError("components did not settle")
    root = cur.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))
    out = (log or own).stage(nodes.join(root, "node", "left").select("node", F.coalesce("root", "node").alias("root")), "cc-out")
    own.close(out)
    return out
