"""Queries over manifests as documents and over declared assets."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from carillon.functions import documents as D
from carillon.operators import assets as A
from carillon.operators import evaluate as E
from carillon.operators import kernels as K
from carillon.operators import temporal as T
from carillon.operators.series import resample
from carillon.plans.series import _frames
from carillon.tables import load


def manifest_assets(s, d):
    """Every declared file of every manifest in the order of a packed container."""
    got = A.asset_rows(load(s, d, "manifests"))
    return got.select("manifest_id", "ord", "kind", "media_pos", "track_pos", "item_pos", "path")


def manifest_asset_counts(s, d):
    return A.asset_rows(load(s, d, "manifests")).groupBy("manifest_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("path").alias("paths"), F.count_if(F.col("kind") == "representation").alias("representations"))


def manifest_canonical(s, d):
    """Manifests that say the same have one canonical text: its digest, or the fault."""
    c = load(s, d, "manifests").select("manifest_id", D.canonical_json(F.col("manifest")).alias("c"))
    return c.select("manifest_id", F.sha2(F.col("c.text"), 256).alias("fingerprint"), F.col("c.fault").alias("fault"))


def number_formats(s, d):
    return load(s, d, "events").select("event_id", D.number_text(F.col("value")).alias("text"))


def track_number_repair(s, d):
    """Track numbers of a medium, renumbered where one is missing or stands twice."""
    t = load(s, d, "tracks").select("id", "media_id", "track_number", "title")
    return A.repair_numbers(t, ["media_id"], "track_number", [F.col("track_number").asc_nulls_last(), F.col("id")]).select("id", F.col("number").cast("int").alias("number"))


def cover_pick(s, d):
    """Each folder's best cover among files made of the analyses."""
    a = load(s, d, "analyzed").where("path is not null").select((F.col("analyzed_id") % 50).alias("folder"), F.when(F.col("analyzed_id") % 4 == 0, F.lit("")).otherwise(F.lit("cd1")).alias("parent"), F.concat(F.element_at(F.array(F.lit("Front"), F.lit("cover"), F.lit("x")), (F.col("analyzed_id") % 3 + 1).cast("int")), F.lit("."), F.element_at(F.array(F.lit("png"), F.lit("jpg")), (F.col("analyzed_id") % 2 + 1).cast("int"))).alias("name"), F.format_string("%06d", "analyzed_id").alias("path"))
    return a.groupBy("folder").agg(F.min(A.cover_rank(F.col("parent"), F.col("name"), F.col("path"))).alias("r")).select("folder", F.col("r.path").alias("path"))


def first_installed(s, d):
    """Each album's first package that is ok."""
    o = load(s, d, "orders").select(F.col("o_custkey").alias("album"), F.col("o_orderkey").alias("package"), F.when(F.col("o_orderstatus") == "F", F.lit("ok")).otherwise(F.lit("pending")).alias("state"))
    return A.first_installed(load(s, d, "customer").select(F.col("c_custkey").alias("album")), o, "album", "package")


def appended_page(s, d):
    """All customers in two pages by balance, of which the second repeats the upper end of the first."""
    c = load(s, d, "customer").select("c_custkey", "c_name", "c_acctbal")
    return A.append_page(c.where("c_acctbal < 5000"), c.where("c_acctbal >= 4000"), "c_custkey").select("c_custkey", "c_name")


def boundary_events(s, d):
    """Positions played through an order's lines: where the line changes, and the end, once."""
    l = load(s, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.sum(F.col("l_quantity").cast("bigint")).alias("length"))
    p = T.prefix_positions(l, "l_orderkey", ["l_linenumber"], "length").withColumn("total", F.sum("length").over(Window.partitionBy("l_orderkey")))
    ticks = p.select("l_orderkey", "total").distinct().select("l_orderkey", "total", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("total") + 20, F.lit(10).cast("bigint"))).alias("pos"))
    at = T.as_of(ticks, p.select("l_orderkey", "start", "l_linenumber"), ["l_orderkey"], "pos", "start", "l_linenumber", ["l_linenumber"])
    w = Window.partitionBy("l_orderkey").orderBy("pos")
    now = F.when(F.col("pos") >= F.col("total"), F.lit(-1)).otherwise(F.col("l_linenumber"))
    seen = at.withColumn("now", now).withColumn("was", F.lag("now").over(w)).where("was is null or now <> was")
    return seen.select("l_orderkey", "pos", F.when(F.col("now") == -1, F.lit("end")).when(F.col("was").isNull(), F.lit("start")).otherwise(F.lit("boundary")).alias("event"))


def fetch_cache(s, d):
    """Which analyses a cache by audio digest and profile already holds, and which are left to do."""
    a = load(s, d, "analyzed").where("source_sha256 is not null").select("analyzed_id", "source_sha256")
    cache = a.where("analyzed_id % 3 = 0").select("source_sha256").distinct().withColumn("hit", F.lit(True))
    return a.join(cache, "source_sha256", "left").groupBy(F.coalesce("hit", F.lit(False)).alias("hit")).agg(F.count(F.lit(1)).alias("n"))


def worlds_identical(s, d):
    """For each k, in how many queries two rankings agree place by place."""
    from carillon.plans.similar import _two_rankings

    a, b = _two_rankings(s, d)
    la, lb = E.ranked_lists(a, "id", "nbr", "rank", 10, "la"), E.ranked_lists(b, "id", "nbr", "rank", 10, "lb")
    k = F.explode(F.array(*(F.lit(x) for x in (1, 5, 10)))).alias("k")
    both = la.join(lb, "id").select("la", "lb", k)
    return both.groupBy("k").agg(F.count_if(F.slice("la", F.lit(1), F.col("k")) == F.slice("lb", F.lit(1), F.col("k"))).alias("same"), F.count(F.lit(1)).alias("n"))


def track_loudness(s, d):
    """Loudness and true peak of each user's stream, drawn out and put on a tone, as a track at 8,000 samples a second."""
    slow = resample(_frames(s, d), "user_id", "frame", "x", 1, 60)
    f = slow.select("user_id", "frame", F.lit(0).alias("channel"), (F.col("value") * F.sin(F.col("frame") * 0.9)).alias("sample"))
    got = K.loudness(f, "user_id", 8000)
    return got.select("user_id", F.round("lufs", 3).alias("lufs"), F.round("peak_db", 3).alias("peak_db"))


QUERIES = {f.__name__: f for f in (
    manifest_assets, manifest_asset_counts, manifest_canonical, number_formats, track_number_repair, cover_pick, first_installed, appended_page, boundary_events, fetch_cache, worlds_identical, track_loudness,
)}
from carillon.plans.similar import _TWO  # noqa: E402

SQL = {
    "number_formats": "SELECT event_id, CASE WHEN value = floor(value) THEN value::BIGINT::VARCHAR ELSE value::VARCHAR END text FROM events",
    "track_number_repair": "WITH t AS (SELECT id, track_number, count(*) FILTER (track_number IS NULL) OVER w + count(track_number) OVER w bad, media_id FROM tracks WINDOW w AS (PARTITION BY media_id)), u AS (SELECT media_id, count(DISTINCT track_number) u FROM tracks GROUP BY 1) SELECT id, CASE WHEN bad - u > 0 THEN row_number() OVER (PARTITION BY t.media_id ORDER BY track_number NULLS LAST, id) ELSE track_number END::INT AS number FROM t JOIN u ON u.media_id = t.media_id",
    "cover_pick": "WITH a AS (SELECT analyzed_id % 50 folder, CASE WHEN analyzed_id % 4 = 0 THEN 0 ELSE 1 END sub, CASE analyzed_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 0 ELSE 9 END nm, CASE WHEN analyzed_id % 2 = 0 THEN 2 ELSE 0 END ex, lpad(analyzed_id::VARCHAR, 6, '0') AS path FROM analyzed WHERE path IS NOT NULL) SELECT folder, path FROM a QUALIFY row_number() OVER (PARTITION BY folder ORDER BY sub, nm, ex, path) = 1",
    "first_installed": "SELECT c_custkey album, min(o_orderkey) AS package FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'F' GROUP BY 1",
    "appended_page": "SELECT c_custkey, c_name FROM customer",
    "boundary_events": "WITH l AS (SELECT l_orderkey, l_linenumber, sum(l_quantity::BIGINT)::BIGINT AS length FROM lineitem GROUP BY 1, 2), p AS (SELECT *, coalesce(sum(length) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) st, sum(length) OVER (PARTITION BY l_orderkey) tot FROM l), t AS (SELECT l_orderkey, tot::BIGINT tot, unnest(range(0, tot::BIGINT + 21, 10)) pos FROM (SELECT DISTINCT l_orderkey, tot FROM p)), n AS (SELECT t.l_orderkey, pos, CASE WHEN pos >= t.tot THEN -1 ELSE max(l_linenumber) END nw FROM t JOIN p ON p.l_orderkey = t.l_orderkey AND st <= pos GROUP BY 1, 2, t.tot), w AS (SELECT *, lag(nw) OVER (PARTITION BY l_orderkey ORDER BY pos) was FROM n) SELECT l_orderkey, pos, CASE WHEN nw = -1 THEN 'end' WHEN was IS NULL THEN 'start' ELSE 'boundary' END event FROM w WHERE was IS NULL OR nw <> was",
    "fetch_cache": "WITH a AS (SELECT analyzed_id, source_sha256 s FROM analyzed WHERE source_sha256 IS NOT NULL) SELECT s IN (SELECT s FROM a WHERE analyzed_id % 3 = 0) hit, count(*) n FROM a GROUP BY 1",
    "worlds_identical": _TWO + ", la AS (SELECT id, list(nbr ORDER BY rank) la FROM a GROUP BY 1), lb AS (SELECT id, list(nbr ORDER BY rank) lb FROM b GROUP BY 1) SELECT k, count(*) FILTER (la[1:k] = lb[1:k]) same, count(*) n FROM la JOIN lb USING (id), (VALUES (1), (5), (10)) t(k) GROUP BY 1",
}
