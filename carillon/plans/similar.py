"""Similarity queries over ``embeddings`` (partitioned by label) and ``analyzed``."""

from __future__ import annotations

from pyspark.sql import functions as F

from carillon.functions import vector as V
from carillon.operators import evaluate as E
from carillon.operators import similarity as S
from carillon.tables import load

SEED = [((7 * k) % 13 - 6) / 6.0 for k in range(64)]
SEED_SQL = "[" + ",".join(repr(x) for x in SEED) + "]::DOUBLE[]"
COS = "list_cosine_similarity({}::DOUBLE[], {}::DOUBLE[])"


def _emb(s, d):
    return load(s, d, "embeddings")


def sim_topk(s, d):
    """The twenty nearest to one seed, of all vectors."""
    got = S.top_k(_emb(s, d), SEED, "vec_id", "embedding", 20)
    return got.select("id", F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


def sim_topk_analyzed(s, d):
    """Over vectors of which some are null, short, zero or not finite: those have no cosine."""
    got = S.top_k(load(s, d, "analyzed"), SEED, "analyzed_id", "vector", 50)
    return got.select("id", F.round("score", 6).alias("score"))


def sim_group_topk(s, d):
    e = _emb(s, d)
    got = S.group_top_k(e.where("vec_id % 20 = 0"), e, "label", "vec_id", "embedding", 10)
    return got.select("id", "nbr", F.col("rank").cast("bigint").alias("rank"))


def sim_pool(s, d):
    return S.centroids(_emb(s, d), ["label"], "embedding").select("label", F.col("dim").cast("bigint").alias("dim"), F.round("value", 6).alias("value"))


def sim_album_nearest(s, d):
    """The three nearest other labels of each label, by the centroids of their vectors."""
    near = S.nearest_centroids(S.centroids(_emb(s, d), ["label"], "embedding"), "label", 3)
    return near.select(F.col("id").alias("label"), F.col("nbr").alias("other"), F.col("rank").cast("bigint").alias("rank"), F.round("score", 6).alias("score"))


def sim_block_topk(s, d):
    """The five nearest of the whole collection for every 20th vector, in blocks."""
    e = _emb(s, d)
    got = S.block_top_k(e.where("vec_id % 20 = 0"), e, "vec_id", "embedding", 5)
    return got.select("id", "nbr", F.col("rank").cast("bigint").alias("rank"))


def sim_hit_rate(s, d):
    e = _emb(s, d)
    near = S.block_top_k(e.where("vec_id % 20 = 0"), e, "vec_id", "embedding", 5)
    got = S.hit_rate(near, e, "vec_id", "label")
    return got.select("hits", "total", F.round("rate", 6).alias("rate"))


def sim_support(s, d):
    """Numbers other than zero, how far the energy is spread, share of very small energy, distance from length one."""
    v = F.col("embedding")
    return _emb(s, d).select("vec_id", V.nonzero(v).alias("nonzero"), F.round(V.participation(v), 5).alias("spread"), F.round(V.small_energy(v, 0.01), 8).alias("small"), F.round(V.norm_deviation(v), 5).alias("off"))


def sim_mean_orders(s, d):
    """Mean of the vectors brought to length one, against the mean of the unit vectors: their cosine is the drift between orders."""
    e = _emb(s, d).select("label", F.posexplode(V.doubles(F.col("embedding"))).alias("dim", "x"))
    plain = e.groupBy("label", "dim").agg(F.avg("x").alias("x"))
    units = S.centroids(_emb(s, d), ["label"], "embedding")
    both = plain.join(units, ["label", "dim"])
    return both.groupBy("label").agg(F.round(F.sum(F.col("x") * F.col("value")) / F.sqrt(F.sum(F.col("x") * F.col("x"))), 6).alias("cosine"))


def sim_finite(s, d):
    """How many vectors of each length are usable."""
    v = F.col("vector")
    return load(s, d, "analyzed").groupBy(F.coalesce(F.size(v), F.lit(-1)).alias("dims")).agg(F.count(F.lit(1)).alias("n"), F.count_if(V.finite(v) & (V.l2_norm(v) > 0)).alias("usable"))


def sim_sets_status(s, d):
    """Vectors per set, sets without any included."""
    sets = s.range(12).select(F.col("id").cast("int").alias("label"))
    return sets.join(_emb(s, d).groupBy("label").agg(F.count(F.lit(1)).alias("n")), "label", "left").select("label", F.coalesce("n", F.lit(0)).alias("n"))


def _two_rankings(s, d):
    """Each query's ranking by all 64 numbers, and by the vectors with the last 16 dropped."""
    e = _emb(s, d)
    cut = e.select("vec_id", "label", F.slice("embedding", 1, 48).alias("embedding"))
    ask = lambda x: S.group_top_k(x.where("vec_id % 20 = 0"), x, "label", "vec_id", "embedding", 10)
    return ask(e), ask(cut)


def eval_jaccard(s, d):
    a, b = _two_rankings(s, d)
    la, lb = E.ranked_lists(a, "id", "nbr", "rank", 10, "la"), E.ranked_lists(b, "id", "nbr", "rank", 10, "lb")
    ks = [F.round(E.jaccard(F.slice("la", 1, k), F.slice("lb", 1, k)), 6).alias(f"j{k}") for k in (1, 5, 10)]
    return la.join(lb, "id").select("id", *ks, F.round(E.overlap(F.col("la"), F.col("lb")), 6).alias("overlap"))


def eval_displacement(s, d):
    a, b = _two_rankings(s, d)
    moved = E.displacement(a, b, "id", "nbr", "rank")
    return E.nearest_rank(moved, "moved", [0, 50, 90, 95, 100]).select(F.col("p").cast("bigint").alias("p"), F.col("value").cast("bigint").alias("value"))


def eval_reversals(s, d):
    a, b = _two_rankings(s, d)
    return E.reversals(a, b, "id", "nbr", "rank").select(F.col("x").alias("a"), F.col("y").alias("b"))


def eval_margin(s, d):
    a, _ = _two_rankings(s, d)
    return E.margin(a, "id", "score", "rank", 5).select("id", F.round("margin", 6).alias("margin"))


_TWO = """
WITH q AS (SELECT vec_id, label, embedding::DOUBLE[] e, embedding[1:48]::DOUBLE[] c FROM embeddings),
a AS (SELECT q.vec_id id, v.vec_id nbr, list_cosine_similarity(q.e, v.e) score, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_cosine_similarity(q.e, v.e) DESC, v.vec_id) AS rank
      FROM q JOIN q v ON q.label = v.label AND q.vec_id <> v.vec_id WHERE q.vec_id % 20 = 0 QUALIFY rank <= 10),
b AS (SELECT q.vec_id id, v.vec_id nbr, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_cosine_similarity(q.c, v.c) DESC, v.vec_id) AS rank
      FROM q JOIN q v ON q.label = v.label AND q.vec_id <> v.vec_id WHERE q.vec_id % 20 = 0 QUALIFY rank <= 10)
"""
_CENT = """
WITH u AS (SELECT label, generate_subscripts(embedding, 1) - 1 AS dim, unnest(embedding::DOUBLE[]) / sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS x FROM embeddings),
m AS (SELECT label, dim, avg(x) m FROM u GROUP BY 1, 2),
c AS (SELECT label, dim, m / sqrt(sum(m * m) OVER (PARTITION BY label)) AS value FROM m)
"""
_FINITE = "len(list_filter(vector, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(vector) > 0"
QUERIES = {f.__name__: f for f in (
    sim_topk, sim_topk_analyzed, sim_group_topk, sim_pool, sim_album_nearest, sim_block_topk, sim_hit_rate, sim_support, sim_mean_orders, sim_finite, sim_sets_status, eval_jaccard, eval_displacement, eval_reversals, eval_margin,
)}
SQL = {
    "sim_topk": f"SELECT vec_id id, round({COS.format('embedding', SEED_SQL)}, 6) score, row_number() OVER (ORDER BY {COS.format('embedding', SEED_SQL)} DESC, vec_id) AS rank FROM embeddings QUALIFY rank <= 20",
    "sim_topk_analyzed": f"WITH g AS (SELECT * FROM analyzed WHERE {_FINITE} AND len(vector) = 64 AND len(list_filter(vector, lambda x: x <> 0)) > 0) SELECT analyzed_id id, round({COS.format('vector', SEED_SQL)}, 6) score FROM g ORDER BY {COS.format('vector', SEED_SQL)} DESC, analyzed_id LIMIT 50",
    "sim_group_topk": _TWO + "SELECT id, nbr, rank FROM a",
    "sim_pool": _CENT + "SELECT label, dim, round(value, 6) AS value FROM c",
    "sim_album_nearest": _CENT + ", p AS (SELECT x.label, y.label AS other, sum(x.value * y.value) s FROM c x JOIN c y ON x.dim = y.dim AND x.label <> y.label GROUP BY 1, 2) SELECT label::BIGINT AS label, other::BIGINT AS other, row_number() OVER (PARTITION BY label ORDER BY s DESC, other) AS rank, round(s, 6) score FROM p QUALIFY rank <= 3",
    "sim_block_topk": "WITH q AS (SELECT vec_id, embedding::DOUBLE[] e FROM embeddings) SELECT q.vec_id AS id, v.vec_id AS nbr, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_cosine_similarity(q.e, v.e) DESC, v.vec_id) AS rank FROM q JOIN q v ON q.vec_id <> v.vec_id WHERE q.vec_id % 20 = 0 QUALIFY rank <= 5",
    "sim_hit_rate": "WITH q AS (SELECT vec_id, label, embedding::DOUBLE[] e FROM embeddings), n AS (SELECT q.label a, v.label b FROM q JOIN q v ON q.vec_id <> v.vec_id WHERE q.vec_id % 20 = 0 QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY list_cosine_similarity(q.e, v.e) DESC, v.vec_id) <= 5) SELECT count(*) FILTER (a = b) hits, count(*) total, round(avg((a = b)::INT), 6) rate FROM n",
    "sim_support": """WITH e AS (SELECT vec_id, embedding::DOUBLE[] v FROM embeddings) SELECT vec_id, len(list_filter(v, lambda x: x <> 0))::INT nonzero,
        round(pow(list_sum(list_transform(v, lambda x: x * x)), 2) / list_sum(list_transform(v, lambda x: x * x * x * x)), 5) spread,
        round(coalesce(list_sum(list_transform(list_filter(v, lambda x: abs(x) < 0.01), lambda x: x * x)), 0) / list_sum(list_transform(v, lambda x: x * x)), 8) small,
        round(abs(sqrt(list_sum(list_transform(v, lambda x: x * x))) - 1), 5) off FROM e""",
    "sim_mean_orders": _CENT + ", p AS (SELECT label, dim, avg(x) x FROM (SELECT label, generate_subscripts(embedding, 1) - 1 AS dim, unnest(embedding::DOUBLE[]) x FROM embeddings) GROUP BY 1, 2) SELECT label, round(sum(x * value) / sqrt(sum(x * x)), 6) cosine FROM p JOIN c USING (label, dim) GROUP BY 1",
    "sim_finite": f"SELECT coalesce(len(vector), -1)::INT dims, count(*) n, count(*) FILTER ({_FINITE} AND len(list_filter(vector, lambda x: x <> 0)) > 0) usable FROM analyzed GROUP BY 1",
    "sim_sets_status": "SELECT r.range::INT label, count(vec_id) n FROM range(12) r LEFT JOIN embeddings ON label = r.range GROUP BY 1",
    "eval_jaccard": _TWO + """, l AS (SELECT a.id, list(a.nbr ORDER BY rank) la FROM a GROUP BY 1), r AS (SELECT b.id, list(b.nbr ORDER BY rank) lb FROM b GROUP BY 1)
        SELECT id, round(len(list_intersect(la[1:1], lb[1:1])) / len(list_distinct(la[1:1] || lb[1:1])), 6) j1, round(len(list_intersect(la[1:5], lb[1:5])) / len(list_distinct(la[1:5] || lb[1:5])), 6) j5,
        round(len(list_intersect(la, lb)) / len(list_distinct(la || lb)), 6) j10, round(len(list_intersect(la, lb)) / greatest(len(la), len(lb)), 6) overlap FROM l JOIN r USING (id)""",
    "eval_displacement": _TWO + ", m AS (SELECT abs(a.rank - b.rank) moved, row_number() OVER (ORDER BY abs(a.rank - b.rank)) - 1 AS r, count(*) OVER () n FROM a JOIN b USING (id, nbr)) SELECT p, moved AS value FROM m JOIN (VALUES (0), (50), (90), (95), (100)) t(p) ON r = CASE WHEN p = 100 THEN n - 1 ELSE (n - 1) * p // 100 END",
    "eval_reversals": _TWO + "SELECT DISTINCT x.nbr a, y.nbr b FROM a x JOIN a y ON x.id = y.id AND x.nbr < y.nbr JOIN b u ON u.id = x.id AND u.nbr = x.nbr JOIN b v ON v.id = x.id AND v.nbr = y.nbr WHERE (x.rank - y.rank) * (u.rank - v.rank) < 0",
    "eval_margin": _TWO + "SELECT id, round(max(score) FILTER (rank = 5) - max(score) FILTER (rank = 6), 6) margin FROM a WHERE rank IN (5, 6) GROUP BY 1",
}
for _k in ("eval_displacement",):
    SQL[_k] = SQL[_k].replace("SELECT p, moved AS value", "SELECT p::BIGINT AS p, moved AS value")
