"""Statistics of evaluations, and sampling."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from carillon.functions import hashing as H
from carillon.functions import vector as V
from carillon.functions.text import relation
from carillon.operators import evaluate as E
from carillon.operators.linkage import cross_pairs
from carillon.tables import load


def eval_spearman(s, d):
    """Rank correlation of size and price of parts per brand: both have many ties."""
    got = E.spearman(load(s, d, "part"), ["p_brand"], "p_size", "p_retailprice")
    return got.select("p_brand", "n", F.round("rho", 6).alias("rho"))


def eval_percentiles(s, d):
    got = E.nearest_rank(load(s, d, "lineitem"), "l_extendedprice", [0, 1, 25, 50, 75, 95, 99, 100])
    return got.select(F.col("p").cast("bigint").alias("p"), F.round("value", 4).alias("value"))


def eval_compare(s, d):
    """Change of the cosine to the label's first vector when numbers are cut to two decimals: most, mean, least, crossings of 0."""
    e = load(s, d, "embeddings").select("vec_id", "label", V.doubles(F.col("embedding")).alias("v"))
    first = e.groupBy("label").agg(F.min_by("v", "vec_id").alias("w"), F.min("vec_id").alias("first_id"))
    cut = F.transform("v", lambda x: F.floor(x * 100) / 100)
    j = e.join(first, "label").select("label", V.cosine(F.col("v"), F.col("w")).alias("a"), V.cosine(cut, F.col("w")).alias("b"), V.l2_norm(cut).alias("n"))
    dv = F.abs(F.col("a") - F.col("b"))
    return j.groupBy("label").agg(F.round(F.max(dv), 6).alias("most"), F.round(F.avg(dv), 6).alias("mean"), F.count_if(F.signum("a") != F.signum("b")).alias("crossings"), F.round(F.min("n"), 5).alias("norm_lo"), F.round(F.max("n"), 5).alias("norm_hi"))


def eval_safety(s, d):
    """Per label the vector that strays farthest from length one, the least support, how many stray over a bound."""
    e = load(s, d, "embeddings").select("label", "vec_id", V.norm_deviation(F.col("embedding")).alias("off"), V.nonzero(F.col("embedding")).alias("nz"))
    return e.groupBy("label").agg(F.max_by("vec_id", F.struct("off", -F.col("vec_id"))).alias("worst"), F.min("nz").alias("support"), F.count_if(F.col("off") > 1e-7).alias("affected"))


def eval_zscore(s, d):
    got = E.zscores(load(s, d, "supplier"), ["s_nationkey"], "s_acctbal")
    return got.select("s_suppkey", F.round("z", 5).alias("z"))


def eval_finite(s, d):
    """Mean, least and most of finite durations only."""
    x = load(s, d, "tracks").withColumn("v", F.when(F.col("has_duration") == 1, F.col("duration")).otherwise(F.lit(float("nan"))))
    got = E.finite_stats(x, ["source_store"], "v")
    return got.select("source_store", F.round("mean", 5).alias("mean"), F.round("least", 5).alias("least"), F.round("most", 5).alias("most"), "n")


def eval_strata(s, d):
    got = E.strata(load(s, d, "customer"), ["c_mktsegment"], [F.col("c_acctbal").desc(), F.col("c_custkey")], 5)
    return got.groupBy("c_mktsegment", "stratum").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("c_acctbal"), 4).alias("mean"))


def eval_evenly(s, d):
    return E.evenly_spaced(load(s, d, "customer").select("c_custkey", "c_mktsegment"), ["c_mktsegment"], [F.col("c_custkey")], 12).select("c_mktsegment", "c_custkey")


def eval_split(s, d):
    return load(s, d, "tracks").select("id", H.assign_split(F.col("uid"), 80, 10).alias("split"))


def eval_sample_ids(s, d):
    """Ids of training samples, and the first bits of their digests as targets."""
    t = load(s, d, "tracks").select("id", F.sha2(F.concat_ws("|", "uid", F.col("track_number").cast("string")), 256).alias("sample_id"), H.target_bits(F.col("uid"), 12).alias("bits"))
    return t.select("id", "sample_id", F.array_join(F.transform("bits", lambda b: b.cast("string")), "").alias("bits"))


def eval_queries_by_hash(s, d):
    """The member of the lowest hash of each of the first groups by hash."""
    return E.by_hash(load(s, d, "tracks"), F.col("uid"), "media_id", "id", 25)


def eval_bce(s, d):
    """Mean binary cross-entropy of a made-up logit per event type."""
    e = load(s, d, "events").select("event_type", ((F.col("value") - 50) / 25.0).alias("l"), (F.col("user_id") % 2).cast("double").alias("t"))
    return e.groupBy("event_type").agg(F.round(F.avg(E.bce_with_logits(F.col("l"), F.col("t"))), 6).alias("loss"))


def eval_gates(s, d):
    """A gate per label: over 20 vectors are needed; then none may stray from length one by over a bound."""
    g = load(s, d, "embeddings").groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.max(V.norm_deviation(F.col("embedding"))).alias("off"))
    return g.select("label", F.when(F.col("n") < 21, F.lit("not-evaluated")).when(F.col("off") <= 2.0**-10, F.lit("pass")).otherwise(F.lit("fail")).alias("state"))


def eval_verdict(s, d):
    return E.verdict(eval_gates(s, d), "state")


def eval_cross_codec(s, d):
    """Media of which some track is in one codec and some in another."""
    t = load(s, d, "tracks").select("media_id", "source_audio_codec", "uid")
    return cross_pairs(t, ["media_id"], "source_audio_codec", "uid", ("flac", "alac"))


def eval_leakage(s, d):
    """Codes that stand both in the training and in the test part."""
    t = load(s, d, "tracks").where("isrc is not null").select("isrc", H.assign_split(F.col("uid"), 50, 0).alias("split"))
    return t.where("split = 'train'").select("isrc").intersect(t.where("split = 'test'").select("isrc"))


def eval_pools(s, d):
    """Pairs of neighbouring tracks by how they are related."""
    links = load(s, d, "track_artists").where("position = 1").groupBy(F.col("track_id").alias("id")).agg(F.min("artist_id").alias("artist"))
    t = load(s, d, "tracks").join(links, "id").select("id", "media_id", "artist")
    n = t.select((F.col("id") - 1).alias("id"), F.col("media_id").alias("m2"), F.col("artist").alias("a2"))
    rel = relation(F.col("artist"), F.col("media_id"), F.col("a2"), F.col("m2"))
    return t.join(n, "id").groupBy(rel.alias("relation")).agg(F.count(F.lit(1)).alias("n"))


def eval_strata_stats(s, d):
    """Counts and means of given strata, those without rows at 0."""
    want = s.createDataFrame([("click",), ("view",), ("share",)], "event_type string")
    got = load(s, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"))
    return want.join(got, "event_type", "left").select("event_type", F.coalesce("n", F.lit(0)).alias("n"), F.round(F.coalesce("mean", F.lit(0.0)), 5).alias("mean"))


def eval_digest(s, d):
    """One digest per medium over its tracks' ids in order, with counts of tracks with and without a duration."""
    t = load(s, d, "tracks").groupBy("media_id").agg(F.array_sort(F.collect_list("uid")).alias("u"), F.count_if(F.col("has_duration") == 1).alias("good"), F.count_if(F.coalesce(F.col("has_duration"), F.lit(0)) != 1).alias("bad"))
    return t.select("media_id", F.sha2(F.array_join("u", "\n"), 256).alias("digest"), "good", "bad")


def eval_stride(s, d):
    """Mean and number of each user's events when only every k-th is taken, for several k."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = load(s, d, "events").withColumn("f", F.row_number().over(w) - 1).select("user_id", "value", "f", F.explode(F.array(*(F.lit(k) for k in (1, 2, 4)))).alias("stride"))
    return e.where("f % stride = 0").groupBy("stride").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 5).alias("mean"))


def eval_assign_ids(s, d):
    """Ids by the order in which codes first occur."""
    first = load(s, d, "tracks").where("isrc is not null").groupBy("media_id", "isrc").agg(F.min(F.struct("track_number", "id")).alias("f"))
    r = F.row_number().over(Window.partitionBy("media_id").orderBy("f", "isrc"))
    return first.select("media_id", "isrc", F.format_string("T%03d", r).alias("label"))


def eval_stratified(s, d):
    """Twelve customers over the range of balances, segments and nations used evenly."""
    c = load(s, d, "customer").select("c_custkey", "c_mktsegment", "c_nationkey", "c_acctbal", F.sha2(F.col("c_custkey").cast("string"), 256).alias("key"))
    got = E.stratified_pick(c, [F.col("c_acctbal").desc(), F.col("c_custkey")], "key", ["c_nationkey", "c_mktsegment"], 12)
    return got.select("bucket", "c_custkey")


def eval_global_rank(s, d):
    """Every line's place by price, then keys."""
    from carillon.operators.skew import global_rank

    o = load(s, d, "orders").select("o_orderkey", "o_totalprice")
    return global_rank(o, [F.col("o_totalprice").desc(), F.col("o_orderkey")]).select("o_orderkey", "rank")


def eval_sets_equal(s, d):
    """Whether two sides hold the same keys: both differences must be empty."""
    a = load(s, d, "orders").select(F.col("o_custkey").alias("k"), F.lit(1).alias("a"), F.lit(0).alias("b"))
    b = load(s, d, "customer").select(F.col("c_custkey").alias("k"), F.lit(0).alias("a"), F.lit(1).alias("b"))
    per = a.unionByName(b).groupBy("k").agg(F.max("a").alias("a"), F.max("b").alias("b"))
    got = per.agg(F.count_if(F.expr("b = 0")).alias("only_a"), F.count_if(F.expr("a = 0")).alias("only_b"))
    return got.select("only_a", "only_b", ((F.col("only_a") == 0) & (F.col("only_b") == 0)).alias("equal"))


QUERIES = {f.__name__: f for f in (
    eval_spearman, eval_percentiles, eval_compare, eval_safety, eval_zscore, eval_finite, eval_strata, eval_evenly, eval_split, eval_sample_ids, eval_queries_by_hash, eval_bce, eval_gates, eval_verdict,
    eval_cross_codec, eval_leakage, eval_pools, eval_strata_stats, eval_digest, eval_stride, eval_assign_ids, eval_sets_equal, eval_stratified, eval_global_rank,
)}
_SPLIT = "CASE WHEN ('0x' || substr(sha256({0}), 1, 2))::INT * 100 // 256 < {1} THEN 'train' WHEN ('0x' || substr(sha256({0}), 1, 2))::INT * 100 // 256 < {2} THEN 'validation' ELSE 'test' END"
_NORM = "sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x)))"
_GATES = f"SELECT label, CASE WHEN count(*) < 21 THEN 'not-evaluated' WHEN max(abs({_NORM} - 1)) <= pow(2, -10) THEN 'pass' ELSE 'fail' END state FROM embeddings GROUP BY 1"
SQL = {
    "eval_global_rank": "SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders",
    "eval_spearman": "WITH r AS (SELECT p_brand, rank() OVER (PARTITION BY p_brand ORDER BY p_size) + (count(*) OVER (PARTITION BY p_brand, p_size) - 1) / 2.0 x, rank() OVER (PARTITION BY p_brand ORDER BY p_retailprice) + (count(*) OVER (PARTITION BY p_brand, p_retailprice) - 1) / 2.0 y FROM part) SELECT p_brand, count(*) n, round(corr(x, y), 6) rho FROM r GROUP BY 1",
    "eval_percentiles": "WITH r AS (SELECT l_extendedprice v, row_number() OVER (ORDER BY l_extendedprice) - 1 AS r, count(*) OVER () n FROM lineitem) SELECT p::BIGINT AS p, round(v, 4) AS value FROM r JOIN (VALUES (0), (1), (25), (50), (75), (95), (99), (100)) t(p) ON r = CASE WHEN p = 100 THEN n - 1 ELSE (n - 1) * p // 100 END",
    "eval_compare": "WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] v, list_transform(embedding::DOUBLE[], lambda x: floor(x * 100) / 100) c FROM embeddings), f AS (SELECT label, arg_min(v, vec_id) w FROM e GROUP BY 1), j AS (SELECT label, list_cosine_similarity(v, w) a, list_cosine_similarity(c, w) b, sqrt(list_inner_product(c, c)) n FROM e JOIN f USING (label)) SELECT label, round(max(abs(a - b)), 6) most, round(avg(abs(a - b)), 6) mean, count(*) FILTER (sign(a) <> sign(b)) crossings, round(min(n), 5) norm_lo, round(max(n), 5) norm_hi FROM j GROUP BY 1",
    "eval_safety": f"WITH e AS (SELECT label, vec_id, abs({_NORM} - 1) off, len(list_filter(embedding, lambda x: x <> 0)) nz FROM embeddings) SELECT label, arg_max(vec_id, off) worst, min(nz)::INT support, count(*) FILTER (off > 1e-7) affected FROM e GROUP BY 1",
    "eval_zscore": "SELECT s_suppkey, round(coalesce((s_acctbal - avg(s_acctbal) OVER w) / nullif(stddev_pop(s_acctbal) OVER w, 0), 0), 5) z FROM supplier WINDOW w AS (PARTITION BY s_nationkey)",
    "eval_finite": "WITH t AS (SELECT source_store, CASE WHEN has_duration = 1 AND NOT isnan(duration) AND NOT isinf(duration) THEN duration END v FROM tracks) SELECT source_store, round(avg(v), 5) mean, round(min(v), 5) AS least, round(max(v), 5) most, count(v) n FROM t GROUP BY 1",
    "eval_strata": "WITH r AS (SELECT c_mktsegment, c_acctbal, (row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) * 5 - 1) // count(*) OVER (PARTITION BY c_mktsegment) AS stratum FROM customer) SELECT c_mktsegment, stratum, count(*) n, round(avg(c_acctbal), 4) mean FROM r GROUP BY 1, 2",
    "eval_evenly": "WITH r AS (SELECT c_mktsegment, c_custkey, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) - 1 r, count(*) OVER (PARTITION BY c_mktsegment) n FROM customer) SELECT DISTINCT c_mktsegment, c_custkey FROM r, range(12) i WHERE n <= 12 OR r = i.range * n // 12",
    "eval_split": f"SELECT id, {_SPLIT.format('uid', 80, 90)} split FROM tracks",
    "eval_sample_ids": "SELECT id, sha256(concat_ws('|', uid, track_number::VARCHAR)) sample_id, substr(('0x' || substr(sha256(uid), 1, 3))::INT::BIT::VARCHAR, 21) bits FROM tracks",
    "eval_queries_by_hash": "SELECT media_id, arg_min(id, sha256(uid)) AS id FROM tracks GROUP BY 1 ORDER BY sha256(media_id::VARCHAR), media_id LIMIT 25",
    "eval_bce": "WITH e AS (SELECT event_type, (value - 50) / 25.0 l, (user_id % 2)::DOUBLE t FROM events) SELECT event_type, round(avg(greatest(l, 0) - l * t + ln(1 + exp(-abs(l)))), 6) loss FROM e GROUP BY 1",
    "eval_gates": _GATES,
    "eval_verdict": f"WITH g AS ({_GATES}) SELECT CASE WHEN count(*) FILTER (state = 'fail') > 0 THEN 'fail' WHEN count(*) FILTER (state = 'not-evaluated') > 0 OR count(*) = 0 THEN 'not-evaluated' ELSE 'pass' END verdict FROM g",
    "eval_cross_codec": "SELECT media_id, max(uid) FILTER (source_audio_codec = 'flac') AS first, max(uid) FILTER (source_audio_codec = 'alac') AS second FROM tracks GROUP BY 1 HAVING count(*) FILTER (source_audio_codec = 'flac') > 0 AND count(*) FILTER (source_audio_codec = 'alac') > 0",
    "eval_leakage": f"WITH t AS (SELECT isrc, {_SPLIT.format('uid', 50, 50)} split FROM tracks WHERE isrc IS NOT NULL) SELECT isrc FROM t WHERE split = 'train' INTERSECT SELECT isrc FROM t WHERE split = 'test'",
    "eval_pools": "WITH l AS (SELECT track_id id, min(artist_id) artist FROM track_artists WHERE position = 1 GROUP BY 1), t AS (SELECT id, media_id, artist FROM tracks JOIN l USING (id)) SELECT CASE WHEN a.artist = b.artist AND a.media_id = b.media_id THEN 'same_album' WHEN a.artist = b.artist THEN 'same_artist' ELSE 'different_artist' END relation, count(*) n FROM t a JOIN t b ON b.id = a.id + 1 GROUP BY 1",
    "eval_strata_stats": "SELECT e AS event_type, count(event_id) n, round(coalesce(avg(value), 0), 5) mean FROM (VALUES ('click'), ('view'), ('share')) t(e) LEFT JOIN events ON event_type = e GROUP BY 1",
    "eval_digest": "SELECT media_id, sha256(string_agg(uid, chr(10) ORDER BY uid)) digest, count(*) FILTER (has_duration = 1) good, count(*) FILTER (coalesce(has_duration, 0) <> 1) bad FROM tracks GROUP BY 1",
    "eval_stride": "WITH f AS (SELECT value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS f FROM events) SELECT k::INT AS stride, count(*) n, round(avg(value), 5) mean FROM f, (VALUES (1), (2), (4)) t(k) WHERE f % k = 0 GROUP BY 1",
    "eval_assign_ids": "WITH f AS (SELECT media_id, isrc, track_number, id FROM tracks WHERE isrc IS NOT NULL QUALIFY row_number() OVER (PARTITION BY media_id, isrc ORDER BY track_number NULLS FIRST, id) = 1) SELECT media_id, isrc, 'T' || lpad((row_number() OVER (PARTITION BY media_id ORDER BY track_number NULLS FIRST, id, isrc))::VARCHAR, greatest(3, len((row_number() OVER (PARTITION BY media_id ORDER BY track_number NULLS FIRST, id, isrc))::VARCHAR))::INT, '0') AS label FROM f",
    "eval_sets_equal": "WITH a AS (SELECT DISTINCT o_custkey FROM orders), b AS (SELECT c_custkey o_custkey FROM customer), x AS (SELECT count(*) n FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b)), y AS (SELECT count(*) n FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)) SELECT x.n only_a, y.n only_b, x.n = 0 AND y.n = 0 equal FROM x, y",
}
