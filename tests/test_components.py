import random

from carillon.operators.components import connected_components
from carillon.operators.skew import first_k, heavy_keys, lookup_join
from pyspark.sql import functions as F


def _plain(edges):
    par = {}

    def find(x):
        while par.setdefault(x, x) != x:
            x = par[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        par[max(x, y)] = min(x, y)
    return {x: find(x) for x in list(par)}


def test_components_random_chain_star(spark):
    random.seed(3)
    edges = [(random.randrange(300), random.randrange(300)) for _ in range(200)] + [(1000 + k, 1001 + k) for k in range(60)] + [(2000, 2001 + k) for k in range(200)] + [(5, 5), (7, 7)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges + edges[:50], "src bigint, dst bigint")).collect()}
    assert got == _plain(edges)


def test_components_empty_and_null(spark):
    assert connected_components(spark.createDataFrame([(None, 1), (2, None)], "src bigint, dst bigint")).count() == 0


def test_lookup_join_with_a_heavy_key(spark):
    big = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 50 == 1, None).otherwise(F.col("id")).alias("k"), "id")
    small = spark.range(2000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    heavy = heavy_keys(big, "k", 3000, least=100)
    assert [r.k for r in heavy.collect()] == [7]
    for how in ("inner", "left"):
        a, b = lookup_join(big, small, "k", heavy, how), big.join(small, "k", how)
        assert a.exceptAll(b).count() == b.exceptAll(a).count() == 0


def test_first_k(spark):
    df = spark.range(100).select((F.col("id") % 3).alias("g"), "id")
    assert sorted((r.g, r.id) for r in first_k(df, ["g"], [F.col("id").desc()], 2).collect()) == [(0, 96), (0, 99), (1, 94), (1, 97), (2, 95), (2, 98)]


def test_components_with_a_heavy_node(spark):
    star = spark.range(1, 150_001).select(F.lit(1_000_000).alias("src"), F.col("id").alias("dst"))
    tail = spark.range(200_000, 200_050).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    got = connected_components(star.unionByName(tail)).groupBy("root").count().collect()
    assert {(r.root, r["count"]) for r in got} == {(1, 150_001), (200_000, 51)}
