"""Snapshots reconciled, and inventories verified. The older snapshot is made of the table itself with some rows altered by id."""

from __future__ import annotations

from pyspark.sql import functions as F

from carillon.operators import reconcile as R
from carillon.operators import verify as Y
from carillon.operators.catalog import authorized
from carillon.tables import load


def _snapshots(s, d):
    """Parts: the old lack every 7th; in the new every 11th is gone and every 5th has another price."""
    p = load(s, d, "part").select("p_partkey", "p_brand", "p_retailprice")
    old = p.where("p_partkey % 7 <> 3")
    new = p.where("p_partkey % 11 <> 4").withColumn("p_retailprice", F.when(F.col("p_partkey") % 5 == 0, F.col("p_retailprice") + 1).otherwise(F.col("p_retailprice")))
    return old, new


def merge_upsert(s, d):
    """New rows win, unless they are cheaper or equal."""
    old, new = _snapshots(s, d)
    got = R.upsert(old, new, ["p_partkey"], F.col("new_p_retailprice") > F.col("old_p_retailprice"))
    return got.select("p_partkey", "p_brand", F.round("p_retailprice", 2).alias("price"))


def merge_replace_slice(s, d):
    """Every brand in the new slice is replaced as a whole."""
    old, new = _snapshots(s, d)
    got = R.replace_slice(old, new.where("p_brand < 'Brand#2'"), "p_brand")
    return got.groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("p_retailprice"), 2).alias("price"))


def _packages(s, d):
    """Packages by path: the old ones are those of the early batches; the new lack every 6th, have every 9th at another path, and every 10th with other content."""
    v = load(s, d, "vectors").where("manifest is not null").select("vector_id", F.col("manifest").alias("path"), F.sha2(F.col("vector_id").cast("string"), 256).alias("digest"), F.sha2(F.concat(F.lit("f"), F.col("vector_id").cast("string")), 256).alias("finger"), "batch_no")
    old = v.where("batch_no < 6")
    new = v.where("vector_id % 6 <> 1").select("vector_id", F.when(F.col("vector_id") % 9 == 2, F.concat(F.lit("moved/"), "path")).otherwise(F.col("path")).alias("path"), F.when(F.col("vector_id") % 10 == 3, F.sha2(F.lit("x"), 256)).otherwise(F.col("digest")).alias("digest"), "finger", "batch_no")
    return old, new


def merge_classify(s, d):
    old, new = _packages(s, d)
    return R.classify(old, new, "path", "digest", "finger").select("path", "action")


def merge_scan_result(s, d):
    """The classification as counts."""
    return merge_classify(s, d).groupBy("action").agg(F.count(F.lit(1)).alias("n"))


def merge_sweep(s, d):
    """Orders not seen this time become unavailable, but for those that are pending."""
    o = load(s, d, "orders").select("o_orderkey", "o_orderstatus")
    got = R.sweep(o, o.where("o_orderkey % 4 <> 0"), "o_orderkey", "o_orderstatus", "U", ("P",))
    return got.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


def merge_match_rows(s, d):
    """Tracks matched to those of before, by place and content, else by the only content."""
    t = load(s, d, "tracks").select("media_id", "id", F.coalesce(F.col("track_number"), F.lit(0)).alias("pos"), F.coalesce(F.col("source_audio_md5"), F.sha2(F.coalesce("isrc", F.lit("")), 256)).alias("digest"))
    new = t.select("media_id", (F.col("id") + 1_000_000).alias("id"), F.when(F.col("id") % 5 == 0, F.col("pos") + 50).otherwise(F.col("pos")).alias("pos"), F.when(F.col("id") % 8 == 0, F.lit("")).otherwise(F.col("digest")).alias("digest"))
    got = R.match_rows(t, new, "media_id")
    return got.select("new_id", "old_id")


def merge_ownership(s, d):
    """Outcomes of ownership, counted."""
    from carillon.plans.ingest import merge_owners

    return merge_owners(s, d).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


def merge_artists(s, d):
    """Typed names linked to the artists already known: half of them, and the typed names are those of all in upper case."""
    a = load(s, d, "artists").select("id", "name", F.col("musicbrainz_id").alias("anchor"))
    typed = a.select(F.when(F.col("id") % 3 == 0, F.translate("name", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")).otherwise(F.col("name")).alias("name"), "anchor")
    return R.link_or_add(typed, a.where("id % 2 = 1")).select("name", "id")


def merge_unique_names(s, d):
    t = load(s, d, "tracks").where("title is not null").select("media_id", "id", F.concat_ws("/", F.col("media_id").cast("string"), "title").alias("file"))
    return R.unique_names(t, "file", [F.col("id")]).select("id", F.col("unique_name").alias("file"))


def token_operations(s, d):
    """Tokens valid at an instant: not revoked and not expired before it."""
    e = load(s, d, "events")
    now = F.lit("2024-01-20 00:00:00").cast("timestamp_ntz")
    t = e.where("event_type = 'signup'").select(F.col("event_id").alias("token_hash"), F.when(F.col("event_id") % 5 == 0, F.col("ts")).alias("revoked_at"))
    x = e.where("event_type = 'signup'").select(F.col("event_id").alias("token_hash"), (F.col("ts") + F.expr("INTERVAL 10 DAYS")).alias("expires_at"), F.lit(None).cast("timestamp_ntz").alias("revoked_at"))
    return authorized(x, t, now).agg(F.count(F.lit(1)).alias("valid"))


def _assets(s, d):
    """Declared assets with an inventory in which some are missing, changed or too many."""
    a = load(s, d, "analyzed").where("path is not null").select(F.col("analyzed_id").alias("ord"), F.when(F.col("analyzed_id") % 50 == 0, F.concat(F.lit("../"), "path")).otherwise(F.col("path")).alias("path"), F.col("source_sha256").alias("digest"))
    per = a.groupBy("path").agg(F.min("ord").alias("ord"), F.min_by("digest", "ord").alias("digest"))
    inv = per.where("ord % 13 <> 0").select("path", (F.col("ord") * 1000).cast("bigint").alias("size"), F.when(F.col("ord") % 17 == 0, F.lit("x")).otherwise(F.col("digest")).alias("digest"))
    extra = per.where("ord % 19 = 0").select(F.concat(F.lit("extra/"), "path").alias("path"), F.lit(5).cast("bigint").alias("size"), F.lit("y").alias("digest"))
    return a, inv.unionByName(extra)


def verify_findings(s, d):
    a, inv = _assets(s, d)
    return Y.findings(a, inv, 900_000).select("ord", "finding")


def verify_report(s, d):
    """Errors by kind, and whether all is well."""
    f = verify_findings(s, d)
    return f.groupBy("finding").agg(F.count(F.lit(1)).alias("n"))


def verify_unreferenced(s, d):
    a, inv = _assets(s, d)
    return Y.unreferenced(inv, a, F.col("path") == "manifest.json").select("path")


def verify_missing(s, d):
    """Customers without a large order."""
    return load(s, d, "customer").join(load(s, d, "orders").where("o_totalprice > 400000").select("o_custkey"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


def verify_budget(s, d):
    l = load(s, d, "lineitem").groupBy("l_orderkey", "l_linenumber", "l_partkey").agg(F.sum(F.col("l_quantity").cast("bigint")).alias("size"))
    return Y.over_budget(l, "l_orderkey", "l_linenumber", "l_partkey", "size", 100).select("l_orderkey", "l_linenumber", "l_partkey", F.col("used").cast("bigint").alias("used"))


def verify_duplicates(s, d):
    return Y.duplicates(load(s, d, "lineitem"), ["l_orderkey", "l_linenumber"])


def verify_members(s, d):
    """Whether each medium's track numbers are the same set in both halves of the ids."""
    t = load(s, d, "tracks").where("track_number is not null")
    return Y.same_members(t.where("id % 2 = 0"), t.where("id % 3 <> 0"), "media_id", ["track_number"])


def verify_waveforms(s, d):
    """Analyses whose number of points or length doesn't fit."""
    a = load(s, d, "analyzed").where("duration_seconds is not null and patch_count is not null")
    pts = F.floor(F.col("duration_seconds") * 10).cast("bigint") + F.when(F.col("analyzed_id") % 4 == 0, 5).otherwise(0)
    f = Y.waveform_fault(pts * 2 + (F.col("analyzed_id") % 6 == 0).cast("int"), pts, F.lit(100), F.col("duration_seconds"))
    return a.select("analyzed_id", f.alias("fault")).where("fault is not null")


QUERIES = {f.__name__: f for f in (
    merge_upsert, merge_replace_slice, merge_classify, merge_scan_result, merge_sweep, merge_match_rows, merge_ownership, merge_artists, merge_unique_names, token_operations, verify_findings, verify_report,
    verify_unreferenced, verify_missing, verify_budget, verify_duplicates, verify_members, verify_waveforms,
)}
_P = "o AS (SELECT * FROM part WHERE p_partkey % 7 <> 3), n AS (SELECT p_partkey, p_brand, CASE WHEN p_partkey % 5 = 0 THEN p_retailprice + 1 ELSE p_retailprice END p_retailprice FROM part WHERE p_partkey % 11 <> 4)"
_V = """v AS (SELECT vector_id, manifest AS path, batch_no FROM vectors WHERE manifest IS NOT NULL), o AS (SELECT path, vector_id::VARCHAR dg, vector_id f FROM v WHERE batch_no < 6),
n AS (SELECT CASE WHEN vector_id % 9 = 2 THEN 'moved/' || path ELSE path END AS path, CASE WHEN vector_id % 10 = 3 THEN 'x' ELSE vector_id::VARCHAR END dg, vector_id f FROM v WHERE vector_id % 6 <> 1),
k AS (SELECT coalesce(o.path, n.path) AS path, o.dg od, n.dg nd, o.path op, n.path np, o.f fo, n.f fn FROM o FULL JOIN n ON o.path = n.path), g AS (SELECT fo FROM k WHERE np IS NULL),
c AS (SELECT path, CASE WHEN op IS NULL THEN CASE WHEN fn IN (SELECT fo FROM g) THEN 'moved' ELSE 'added' END WHEN np IS NULL THEN 'gone' WHEN od = nd THEN 'unchanged' ELSE 'updated' END AS action FROM k)"""
_A = """a AS (SELECT analyzed_id ord, CASE WHEN analyzed_id % 50 = 0 THEN '../' || path ELSE path END AS path, source_sha256 digest FROM analyzed WHERE path IS NOT NULL), p AS (SELECT path, min(ord) ord, arg_min(digest, ord) digest FROM a GROUP BY 1),
i AS (SELECT path, ord * 1000 AS size, CASE WHEN ord % 17 = 0 THEN 'x' ELSE digest END digest FROM p WHERE ord % 13 <> 0 UNION ALL SELECT 'extra/' || path, 5, 'y' FROM p WHERE ord % 19 = 0),
f AS (SELECT ord, CASE WHEN a.path LIKE '../%' THEN 'unsafe path' WHEN i.path IS NULL THEN 'missing' WHEN size > 900000 THEN 'too large' WHEN a.digest IS DISTINCT FROM i.digest THEN 'digest differs' END finding FROM a LEFT JOIN i ON a.path = i.path)"""
SQL = {
    "merge_upsert": f"WITH {_P} SELECT coalesce(o.p_partkey, n.p_partkey) p_partkey, coalesce(o.p_brand, n.p_brand) p_brand, round(CASE WHEN o.p_partkey IS NULL OR n.p_retailprice > o.p_retailprice THEN n.p_retailprice ELSE o.p_retailprice END, 2) price FROM o FULL JOIN n ON o.p_partkey = n.p_partkey",
    "merge_replace_slice": f"WITH {_P}, w AS (SELECT * FROM n WHERE p_brand < 'Brand#2'), r AS (SELECT p_partkey, p_brand, p_retailprice FROM o WHERE p_brand NOT IN (SELECT p_brand FROM w) UNION ALL SELECT * FROM w) SELECT p_brand, count(*) n, round(sum(p_retailprice), 2) price FROM r GROUP BY 1",
    "merge_classify": f"WITH {_V} SELECT path, action FROM c",
    "merge_scan_result": f"WITH {_V} SELECT action, count(*) n FROM c GROUP BY 1",
    "merge_sweep": "SELECT CASE WHEN o_orderkey % 4 = 0 AND o_orderstatus <> 'P' THEN 'U' ELSE o_orderstatus END o_orderstatus, count(*) n FROM orders GROUP BY 1",
    "merge_artists": "WITH a AS (SELECT id, name, musicbrainz_id m FROM artists), t AS (SELECT CASE WHEN id % 3 = 0 THEN translate(name, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') ELSE name END AS name, m FROM a), f AS (SELECT translate(name, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') l, min(name) AS name, min(m) m FROM t GROUP BY 1), k AS (SELECT * FROM a WHERE id % 2 = 1) SELECT name, coalesce((SELECT min(id) FROM k WHERE k.m = f.m), (SELECT min(id) FROM k WHERE k.name = f.name), (SELECT min(id) FROM k WHERE translate(k.name, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') = f.l)) AS id FROM f",
    "merge_unique_names": "WITH t AS (SELECT id, media_id || '/' || title f FROM tracks WHERE title IS NOT NULL), r AS (SELECT *, row_number() OVER (PARTITION BY f ORDER BY id) r FROM t) SELECT id, CASE WHEN r = 1 THEN f ELSE f || ' (' || r || ')' END file FROM r",
    "token_operations": "SELECT count(*) AS valid FROM events WHERE event_type = 'signup' AND event_id % 5 <> 0 AND ts + INTERVAL 10 DAYS >= TIMESTAMP '2024-01-20 00:00:00'",
    "verify_findings": f"WITH {_A} SELECT ord, finding FROM f WHERE finding IS NOT NULL",
    "verify_report": f"WITH {_A} SELECT finding, count(*) n FROM f WHERE finding IS NOT NULL GROUP BY 1",
    "verify_unreferenced": f"WITH {_A} SELECT path FROM i WHERE path <> 'manifest.json' AND path NOT IN (SELECT path FROM a)",
    "verify_missing": "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)",
    "verify_budget": "WITH l AS (SELECT l_orderkey, l_linenumber, l_partkey, sum(l_quantity::BIGINT)::BIGINT AS size FROM lineitem GROUP BY 1, 2, 3), f AS (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_partkey ORDER BY l_linenumber) = 1), u AS (SELECT *, sum(size) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey ROWS UNBOUNDED PRECEDING)::BIGINT used FROM f) SELECT l_orderkey, l_linenumber, l_partkey, used FROM u WHERE used > 100",
    "verify_duplicates": "SELECT l_orderkey, l_linenumber, count(*) n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1",
    "verify_members": "WITH x AS (SELECT DISTINCT media_id, track_number FROM tracks WHERE track_number IS NOT NULL AND id % 2 = 0), y AS (SELECT DISTINCT media_id, track_number FROM tracks WHERE track_number IS NOT NULL AND id % 3 <> 0) SELECT coalesce(x.media_id, y.media_id) media_id, bool_and(x.media_id IS NOT NULL AND y.media_id IS NOT NULL) equal FROM x FULL JOIN y ON x.media_id = y.media_id AND x.track_number = y.track_number GROUP BY 1",
    "verify_waveforms": "WITH a AS (SELECT analyzed_id, duration_seconds d, floor(duration_seconds * 10)::BIGINT + CASE WHEN analyzed_id % 4 = 0 THEN 5 ELSE 0 END p FROM analyzed WHERE duration_seconds IS NOT NULL AND patch_count IS NOT NULL), f AS (SELECT analyzed_id, CASE WHEN analyzed_id % 6 = 0 THEN 'size differs' WHEN abs(p * 100 - d * 1000) > 200 THEN 'duration differs' END fault FROM a) SELECT * FROM f WHERE fault IS NOT NULL",
}
