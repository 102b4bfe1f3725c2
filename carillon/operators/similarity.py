"""Exact search by cosine inside partitions, and pooling of vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from carillon.functions.vector import cosine, unit


def top_k(vectors: DataFrame, seed: list[float], id_col: str, vec_col: str, k: int = 20, within: Column | None = None) -> DataFrame:
    """``id, score, rank``: the ``k`` vectors nearest to one seed, by cosine, then id. One pass and a bounded sort
    (TakeOrderedAndProject); vectors without a cosine are left out; ``within`` prunes the partition before."""
    rows = vectors if within is None else vectors.where(within)
    scored = rows.select(F.col(id_col).alias("id"), cosine(F.col(vec_col), F.array(*(F.lit(float(x)) for x in seed))).alias("score")).where("score is not null")
    best = scored.orderBy(F.col("score").desc(), F.col("id")).limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.col("score").desc(), F.col("id"))))  # k rows


def group_top_k(queries: DataFrame, vectors: DataFrame, group: str, id_col: str, vec_col: str, k: int = 10) -> DataFrame:
    """``id, nbr, score, rank``: for each query vector the ``k`` nearest others of its group, exactly. Queries meet only their
    group's vectors (an equi-join), scores stay JVM-side, and each map task keeps ``k`` rows a query (WindowGroupLimit)."""
    q = queries.select(F.col(group).alias("_g"), F.col(id_col).alias("id"), unit(F.col(vec_col)).alias("qv")).where("qv is not null")
    v = vectors.select(F.col(group).alias("_g"), F.col(id_col).alias("nbr"), unit(F.col(vec_col)).alias("vv")).where("vv is not null")
    both = q.join(v, "_g").where("id <> nbr").select("id", "nbr", F.aggregate(F.zip_with("qv", "vv", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x).alias("score"))
    w = Window.partitionBy("id").orderBy(F.col("score").desc(), F.col("nbr"))
    return both.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def block_top_k(queries: DataFrame, vectors: DataFrame, id_col: str, vec_col: str, k: int = 10, block: int = 2048) -> DataFrame:
    """``id, nbr, score, rank``: for each query vector the ``k`` nearest others of the whole collection, exactly. Both sides are cut
    into blocks by hash, each block of queries meets each block of vectors in one matrix product, and a block gives at most ``k``
    rows a query; so no pair is ever a row. Vectors without a cosine are left out."""
    n_q, n_v = (max(1, -(-d.count() // block)) for d in (queries, vectors))
    side = lambda d: d.select(F.col(id_col).cast("bigint").alias("id"), unit(F.col(vec_col)).alias("v")).where("v is not null")
    part = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    q = side(queries).select("id", "v", part(n_q).alias("qb"), F.explode(F.sequence(F.lit(0), F.lit(n_v - 1))).alias("vb"))
    c = side(vectors).select("id", "v", part(n_v).alias("vb"), F.explode(F.sequence(F.lit(0), F.lit(n_q - 1))).alias("qb"))

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        ids, nbrs = np.asarray(a["id"]), np.asarray(b["id"])
        if not len(ids) or not len(nbrs):
            return pa.table({"id": pa.array([], pa.int64()), "nbr": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        x, y = a["v"].to_pylist(), b["v"].to_pylist()
        out = ([], [], [])
        for dim in {len(v) for v in x}:
            i = np.array([n for n, v in enumerate(x) if len(v) == dim])
            j = np.array([n for n, v in enumerate(y) if len(v) == dim], dtype=int)
            if not len(j):
                continue
            score = np.array([x[n] for n in i]) @ np.array([y[n] for n in j]).T
            score[ids[i][:, None] == nbrs[j][None, :]] = -np.inf
            best = np.lexsort((np.broadcast_to(nbrs[j], score.shape), -score), axis=1)[:, :k]
            top = np.take_along_axis(score, best, axis=1)
            keep = top > -np.inf
            for to, v in zip(out, (np.repeat(ids[i], keep.sum(axis=1)), nbrs[j][best][keep], top[keep])):
                to.append(v)
        cat = [np.concatenate(o) if o else np.zeros(0) for o in out]
        return pa.table({"id": pa.array(cat[0].astype("i8")), "nbr": pa.array(cat[1].astype("i8")), "score": pa.array(cat[2])})

    found = q.groupBy("qb", "vb").cogroup(c.groupBy("qb", "vb")).applyInArrow(run, "id bigint, nbr bigint, score double")
    w = Window.partitionBy("id").orderBy(F.col("score").desc(), F.col("nbr"))
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def centroids(vectors: DataFrame, keys: list[str], vec_col: str) -> DataFrame:
    """``keys, dim, value``: per group the mean of its unit vectors brought to length one, one row a dimension. Groups of unlike
    lengths or with a zero mean are left out. Sums per dimension combine before the shuffle, so a large group costs its task
    one row a dimension."""
    u = vectors.select(*keys, unit(F.col(vec_col)).alias("u")).where("u is not null")
    dims = u.groupBy(*keys).agg(F.min(F.size("u")).alias("lo"), F.max(F.size("u")).alias("hi")).where("lo = hi").select(*keys)
    mean = u.select(*keys, F.posexplode("u").alias("dim", "x")).groupBy(*keys, "dim").agg(F.avg("x").alias("m"))
    norm = mean.groupBy(*keys).agg(F.sqrt(F.sum(F.col("m") * F.col("m"))).alias("n")).where("n > 0")
    return mean.join(norm, keys).join(dims, keys, "left_semi").select(*keys, "dim", (F.col("m") / F.col("n")).alias("value"))


def nearest_centroids(cent: DataFrame, key: str, k: int = 10) -> DataFrame:
    """``id, nbr, score, rank``: of each centroid the ``k`` nearest others, exactly, by blocks (``block_top_k``): no pair is ever a row."""
    whole = cent.groupBy(F.col(key).alias("id")).agg(F.array_sort(F.collect_list(F.struct("dim", "value"))).alias("l")).select("id", F.transform("l", lambda x: x["value"]).alias("v"))
    return block_top_k(whole, whole, "id", "v", k)


def hit_rate(neighbours: DataFrame, groups: DataFrame, id_col: str, group: str) -> DataFrame:
    """``hits, total, rate`` over all neighbours: those that share their query's group."""
    a = groups.select(F.col(id_col).alias("id"), F.col(group).alias("ga"))
    b = groups.select(F.col(id_col).alias("nbr"), F.col(group).alias("gb"))
    same = neighbours.join(a, "id").join(b, "nbr").select((F.col("ga") == F.col("gb")).cast("int").alias("hit"))
    return same.agg(F.coalesce(F.sum("hit"), F.lit(0)).alias("hits"), F.count(F.lit(1)).alias("total"), F.avg("hit").alias("rate"))
