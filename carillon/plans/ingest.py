"""Scans of packages, ownership, artists, assets and sets reconciled with what is on record; small reads and scalars beside them."""

from __future__ import annotations

from pyspark.sql import functions as F

from carillon.functions import text as X
from carillon.operators import catalog as C
from carillon.operators import evaluate as E
from carillon.operators import reconcile as R
from carillon.operators.assets import representation_rows
from carillon.tables import load


def _scan(s, d):
    """Packages on record: those of the early batches; candidates: all later or unchanged ones, some moved, altered or broken."""
    v = load(s, d, "vectors").where("manifest is not null").groupBy(F.col("manifest").alias("path")).agg(F.min("vector_id").alias("k"), F.min("batch_no").alias("b"))
    status = F.element_at(F.array(*(F.lit(x) for x in ("valid", "warning", "invalid", "unavailable", "conflict"))), (F.col("k") % 5 + 1).cast("int"))
    packages = v.where("b < 6").select("path", status.alias("status"), F.lit("unverified").alias("verify_status"), F.concat(F.lit("m"), F.col("k")).alias("manifest_sha256"), F.concat(F.lit("f"), F.col("k") % 400).alias("fingerprint"))
    body = F.when(F.col("k") % 13 == 0, "unreadable").when(F.col("k") % 11 == 0, "invalid").otherwise("valid")
    candidates = v.where("k % 7 <> 3").select(
        F.when(F.col("k") % 4 == 1, F.concat(F.lit("new/"), "path")).otherwise(F.col("path")).alias("path"), body.alias("body"), F.when(F.col("k") % 3 == 0, "other").otherwise(F.concat(F.lit("m"), F.col("k"))).alias("manifest_sha256"),
        F.concat(F.lit("f"), F.col("k") % 400).alias("fingerprint"), (F.col("k") % 6 == 2).cast("int").alias("missing"), (F.col("k") % 9 == 4).cast("int").alias("errors"), (F.col("k") % 8 == 5).cast("int").alias("warnings"))
    return packages, candidates


def scan_actions(s, d):
    return R.scan_actions(*_scan(s, d))


def scan_actions_verified(s, d):
    return R.scan_actions(*_scan(s, d), verify=True)


def scan_counts(s, d):
    """A scan's result: added and updated of what is ingested or invalid, moved, unchanged, invalid."""
    p, c = _scan(s, d)
    a = R.scan_actions(p, c).join(p.select("path", F.lit(True).alias("had")), "path", "left")
    n = lambda x: F.count_if(F.coalesce(x, F.lit(False)))
    broken, kept = F.col("action") == "invalid", F.col("had").isNotNull()
    return a.agg(n((F.col("action") == "ingest") & ~kept).alias("added"), n((F.col("action").isin("ingest", "invalid")) & kept).alias("updated"), n(F.col("action") == "moved").alias("moved"), n(F.col("action").isin("unchanged", "refresh")).alias("same"), n(broken & ~kept).alias("invalid"))


def merge_owners(s, d):
    """Of the packages with one release key, in the order of their path, who owns, mirrors or conflicts."""
    v = load(s, d, "vectors").where("release_key is not null and manifest is not null").groupBy("release_key", F.col("manifest").alias("path")).agg(F.max(F.coalesce("fingerprint", F.lit(""))).alias("fingerprint"), F.min("batch_no").alias("batch_no"))
    owners = v.where("batch_no = 0").groupBy("release_key").agg(F.min("path").alias("path"), F.min_by("fingerprint", "path").alias("fingerprint")).withColumn("present", F.length("path") % 2 == 0)
    return R.arbitrate(v.where("batch_no > 0"), owners, "release_key").select(F.col("k").alias("release_key"), "path", "outcome")


def merge_artists_full(s, d):
    """Artists after all names were typed again: half of the artists are known, some without what the other half says of them."""
    a = load(s, d, "artists").select("id", "name", F.nullif(F.trim("sort_name"), F.lit("")).alias("sort_name"), F.col("musicbrainz_id").alias("anchor"))
    known = a.where("id % 2 = 1").select("id", "name", F.when(F.col("id") % 3 > 0, F.col("sort_name")).alias("sort_name"), F.when(F.col("id") % 5 > 0, F.col("anchor")).alias("anchor"))
    typed = a.select(F.when(F.col("id") % 3 == 0, F.translate("name", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")).otherwise(F.col("name")).alias("name"), "sort_name", "anchor")
    return R.upsert_artists(known, typed)


def merge_assets(s, d):
    """Rows of credits synchronised by role and artist, null meeting null."""
    t = load(s, d, "track_artists").select("track_id", "artist_id", "role", "position").withColumn("o", F.xxhash64("track_id", "artist_id", "role", "position"))
    old = t.groupBy("track_id", "artist_id", "role", "position").agg(F.count(F.lit(1)).alias("c")).where("(track_id + artist_id) % 5 <> 0")
    new = t.groupBy("track_id", "artist_id", "role", "position").agg(F.count(F.lit(1)).alias("c")).where("(track_id + artist_id) % 7 <> 0").withColumn("role", F.when(F.col("artist_id") % 11 == 0, F.lit(None)).otherwise(F.col("role")))
    got = R.sync_rows(old, new, "track_id", ["role", "artist_id"], "position")
    return got.groupBy("track_id", "action").agg(F.count(F.lit(1)).alias("n"))


def merge_release_content(s, d):
    """Media brought to their new content as a whole: tracks matched and kept, added or gone, and their number of each."""
    t = load(s, d, "tracks").select("media_id", "id", F.coalesce(F.col("track_number"), F.lit(0)).alias("pos"), F.coalesce(F.col("source_audio_md5"), F.sha2(F.coalesce("isrc", F.lit("")), 256)).alias("digest"))
    new = t.where("id % 9 <> 4").select("media_id", (F.col("id") + 1_000_000_000).alias("id"), F.when(F.col("id") % 5 == 0, F.col("pos") + 50).otherwise(F.col("pos")).alias("pos"), F.when(F.col("id") % 8 == 0, F.lit("")).otherwise(F.col("digest")).alias("digest"))
    met = R.match_rows(t, new, "media_id").select("owner", "new_id", "old_id")
    kept = met.groupBy(F.col("owner").alias("media_id")).agg(F.count("old_id").alias("kept"), F.count_if(F.col("old_id").isNull()).alias("added"))
    had = t.groupBy("media_id").agg(F.count(F.lit(1)).alias("had"))
    return had.join(kept, "media_id", "left").select("media_id", F.coalesce("kept", F.lit(0)).alias("kept"), F.coalesce("added", F.lit(0)).alias("added"), (F.col("had") - F.coalesce("kept", F.lit(0))).alias("gone"))


def _orders_as_packages(s, d):
    o = load(s, d, "orders")
    status = F.when(F.col("o_orderkey") % 6 == 0, F.lit(None)).otherwise(F.element_at(F.array(*(F.lit(x) for x in ("valid", "warning", "conflict", "unavailable", "invalid"))), (F.col("o_orderkey") % 5 + 1).cast("int")))
    return o.select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 4).alias("release_id"), status.alias("status"), F.when(F.col("o_orderkey") % 3 > 0, F.col("o_orderpriority")).alias("verify_status"), "o_orderdate")


def package_candidates(s, d):
    """Packages that are to be verified: present ones; one without a status is not present."""
    return _orders_as_packages(s, d).where(R.present(F.col("status"))).select("id")


def package_verified(s, d):
    """Verdicts on every second package: none changes a package in conflict or without a status."""
    p = _orders_as_packages(s, d)
    v = p.where("id % 2 = 0").select("id", F.lit("checksum-failed").alias("status"), F.lit("checksum-failed").alias("verify_status"))
    return R.set_verified(p, v, "id").groupBy("status", "verify_status").agg(F.count(F.lit(1)).alias("n"))


def package_rows(s, d):
    """Packages as they are read: release 0 is none, missing texts are empty."""
    p = _orders_as_packages(s, d)
    return p.select("id", F.nullif("release_id", F.lit(0)).alias("release_id"), F.coalesce("status", F.lit("")).alias("status"), F.coalesce("verify_status", F.lit("")).alias("verify_status"))


def set_operations(s, d):
    """Sets wanted by label and shape against those on record, and those made active."""
    e = load(s, d, "embeddings").select(F.col("label").cast("string").alias("fingerprint"), F.size("embedding").alias("dimensions"), F.lit(1).alias("encoding"))
    sets = e.distinct().where("int(fingerprint) % 3 <> 0").select("fingerprint", F.col("fingerprint").cast("bigint").alias("id"), F.when(F.col("fingerprint").cast("int") % 4 == 1, F.col("dimensions") + 1).otherwise(F.col("dimensions")).alias("dimensions"), "encoding")
    got = R.ensure_sets(sets, e)
    return got.select("fingerprint", "id", "outcome", F.when((F.col("outcome") == "reused") & (F.col("id") % 2 == 0), "active").otherwise("inactive").alias("state"))


def _asset_table(s, d):
    """Assets of releases and tracks made of the analyses."""
    k = F.col("analyzed_id")
    kind = F.element_at(F.array(*(F.lit(x) for x in ("artwork", "booklet", "lyrics", "extras"))), (k % 4 + 1).cast("int"))
    return load(s, d, "analyzed").select(k.alias("id"), (k % 200).alias("release_id"), F.when(k % 3 > 0, k % 500).alias("track_id"), kind.alias("kind"), F.when(k % 10 == 6, F.lit("")).otherwise(F.col("source_sha256")).alias("sha256"), (k % 5 > 0).alias("visible"))


def asset_release(s, d):
    """Assets that belong to a release as a whole."""
    return C.release_assets(_asset_table(s, d)).select("release_id", "id", "kind")


def asset_lyrics(s, d):
    """Lyrics of tracks in visible releases with a digest."""
    return C.track_lyrics(_asset_table(s, d).where("visible"), whole_release=True).select("release_id", "track_id", "id")


def asset_served(s, d):
    """Assets that may be served: pictures, booklets and lyrics of visible releases."""
    return C.served_assets(_asset_table(s, d).where("visible")).select("id", "kind")


def representation_list(s, d):
    """A track's rows: the primary audio first, then its variants in order."""
    t = load(s, d, "tracks").select(F.col("id").alias("track_id"), F.coalesce("source_audio_codec", F.lit("")).alias("label"))
    v = load(s, d, "track_artists").groupBy("track_id", "position").agg(F.min("artist_id").alias("id")).select("track_id", "position", F.col("id").cast("string").alias("id"), F.concat(F.lit("v"), "position").alias("label"))
    return representation_rows(t, v, "track_id", "position").select("track_id", "ord", "id", "label")


def text_scalars(s, d):
    """Item ids, page numbers, timelines, heights and checksums of events."""
    e = load(s, d, "events")
    k = F.col("event_id")
    t = X.timeline(F.col("value") * 2, F.col("value"), F.col("value") - 100)
    return e.select(
        "event_id", X.item_id(F.col("user_id"), F.when(k % 3 == 0, k)).alias("item"), X.page_number(F.when(k % 7 > 0, F.concat(k.cast("string"), F.when(k % 5 == 0, F.lit("x")).otherwise(F.lit("")))), 50, 1, 500).alias("page"),
        F.round(t["within"], 4).alias("inside"), F.round(t["fill"], 4).alias("fill"), X.peak_height(F.col("value"), 40).alias("height"), F.crc32(F.encode("event_type", "utf-8")).alias("crc"))


def text_preferences(s, d):
    """Stored preferences of how a track is to be played: the mode of those that are whole."""
    e = load(s, d, "events").where("event_id % 2 = 0")
    raw = F.element_at(F.array(*(F.lit(x) for x in ('{"mode":"default"}', '{"mode":"representation","id":7}', '{"mode":"representation","id":"7"}', '{"mode":"codec","codec":" "}', '{"mode":"codec","codec":"flac"}', '{"mode":"lossless"}', "[]", '{"mode":"other"}', "null"))), (F.col("event_id") % 9 + 1).cast("int"))
    return e.select("event_id", X.preference(raw)["mode"].alias("mode"))


def eval_gates_seven(s, d):
    """Seven gates of each label's vectors, measured against the same vectors in half precision."""
    from carillon.functions import vector as V

    e = load(s, d, "embeddings").select("label", V.norm_deviation(F.col("embedding")).alias("off"), V.small_energy(F.col("embedding")).alias("sub"))
    m = e.groupBy("label").agg(F.count(F.lit(1)).alias("vectors"), F.max("off").alias("off"), F.max("sub").alias("subnormal"))
    k = F.col("label")
    m = m.select("label", (k * 3e-4).alias("cosine_change"), (k * 2e-4).alias("stored_off"), F.when(k == 2, 0).otherwise(F.col("vectors")).alias("seeds"), (k % 3).alias("top_changed"), (k * 5).alias("tracks"), (k % 4).alias("track_lists_changed"), F.when(k != 7, k * 3).alias("albums"), F.lit(0).alias("album_lists_changed"), "vectors", "off", "subnormal", F.when(k == 5, 2).otherwise(0).alias("rejections"))
    return E.gates(m)


def eval_overlap_summary(s, d):
    """Mean overlap of two rankings at each place, and how many queries change."""
    from carillon.plans.similar import _two_rankings

    a, b = _two_rankings(s, d)
    both = E.ranked_lists(a, "id", "nbr", "rank", 10, "la").join(E.ranked_lists(b, "id", "nbr", "rank", 10, "lb"), "id")
    got = E.overlap_summary(both, "la", "lb", (1, 5, 10))
    return got.select("k", F.round("mean_jaccard", 6).alias("mean_jaccard"), "changed")


def verify_ok(s, d):
    """Whether an inventory is without errors, in all and per finding."""
    from carillon.plans.changes import verify_findings

    return verify_findings(s, d).agg(F.count(F.lit(1)).alias("errors"), (F.count(F.lit(1)) == 0).alias("is_ok"))


def member_sizes(s, d):
    """The sizes of a package's members by path, as one map: its entries and their sum."""
    l = load(s, d, "lineitem").groupBy("l_orderkey", F.concat_ws("/", "l_linenumber", "l_partkey").alias("path")).agg(F.sum(F.col("l_quantity").cast("bigint")).alias("size"))
    m = l.groupBy("l_orderkey").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("path", "size")))).alias("sizes"))
    return m.select("l_orderkey", F.cardinality("sizes").alias("members"), F.aggregate(F.map_values("sizes"), F.lit(0).cast("bigint"), lambda a, x: a + x).alias("size"))


def eval_queries_filled(s, d):
    """Three hundred query tracks by hash: one a medium, then the lowest of the rest."""
    return E.queries_by_hash(load(s, d, "tracks"), F.col("uid"), "media_id", "id", 300)


def catalog_release_nested(s, d):
    """Releases with their media, and these with their tracks, each in order."""
    t = load(s, d, "tracks").select("media_id", "track_number", "id")
    media = t.select("media_id", F.floor(F.col("media_id") / 5).alias("release_id")).distinct()
    with_tracks = C.nest(media, t, "media_id", ["track_number", "id"], ["id"], "tracks")
    releases = C.nest(media.select("release_id").distinct(), with_tracks, "release_id", ["media_id"], ["media_id", "tracks"], "media")
    return releases.select("release_id", F.array_join(F.transform("media", lambda m: F.concat(m["media_id"].cast("string"), F.lit(":"), F.array_join(F.transform(m["tracks"], lambda x: x["id"].cast("string")), ","))), ";").alias("media"))


def mix_swaps(s, d):
    """Overlaps and moved playheads of made-up fades."""
    from carillon.functions.audio import swap_facts as facts

    o = load(s, d, "orders").select("o_orderkey", F.floor("o_totalprice").cast("bigint").alias("a"), (F.col("o_custkey") * 100).alias("b"), (F.col("o_orderkey") * 10).alias("c"))
    f = facts(F.col("a"), F.col("b"), F.col("c"))
    return o.select("o_orderkey", f["overlap"].alias("overlap"), f["rebase"].alias("rebase"))


QUERIES = {f.__name__: f for f in (
    scan_actions, scan_actions_verified, scan_counts, merge_owners, merge_artists_full, merge_assets, merge_release_content, package_candidates, package_verified, package_rows, set_operations, asset_release, asset_lyrics, asset_served,
    representation_list, text_scalars, text_preferences, eval_gates_seven, eval_overlap_summary, verify_ok, member_sizes, eval_queries_filled, catalog_release_nested, mix_swaps,
)}
from carillon.plans.changes import SQL as _CHANGES  # noqa: E402
from carillon.plans.similar import _TWO  # noqa: E402

_V = """v AS (SELECT manifest AS path, min(vector_id) k, min(batch_no) b FROM vectors WHERE manifest IS NOT NULL GROUP BY 1),
p AS (SELECT path, ['valid','warning','invalid','unavailable','conflict'][k % 5 + 1] had, 'unverified' had_v, 'm' || k sha, 'f' || k % 400 f FROM v WHERE b < 6),
c AS (SELECT CASE WHEN k % 4 = 1 THEN 'new/' || path ELSE path END AS path, CASE WHEN k % 13 = 0 THEN 'unreadable' WHEN k % 11 = 0 THEN 'invalid' ELSE 'valid' END body, CASE WHEN k % 3 = 0 THEN 'other' ELSE 'm' || k END sha, 'f' || k % 400 f, (k % 6 = 2)::INT missing, (k % 9 = 4)::INT errors, (k % 8 = 5)::INT warnings FROM v WHERE k % 7 <> 3),
g AS (SELECT f, min(path) AS path, arg_min(had, path) had FROM p GROUP BY 1), h AS (SELECT * FROM g WHERE path NOT IN (SELECT path FROM c)),
t AS (SELECT c.f, min(c.path) AS path FROM c LEFT JOIN p ON p.path = c.path WHERE p.path IS NULL AND body = 'valid' GROUP BY 1), m AS (SELECT t.path, h.had FROM t JOIN h ON h.f = t.f),
j AS (SELECT c.*, p.path IS NOT NULL old, p.had, p.had_v, {same} AND coalesce(p.sha = c.sha, false) same, m.path IS NOT NULL takes, m.had moved_had FROM c LEFT JOIN p ON p.path = c.path LEFT JOIN m ON m.path = c.path),
a AS (SELECT *, CASE WHEN body = 'unreadable' THEN 'invalid' WHEN same AND had = 'invalid' THEN 'refresh' WHEN body = 'invalid' THEN 'invalid' WHEN same THEN 'unchanged' WHEN takes THEN 'moved' ELSE 'ingest' END AS action FROM j)"""
_SCAN, _SCAN_V = _V.format(same="true"), _V.format(same="false")
_REST = """SELECT path, action,
CASE WHEN action = 'invalid' THEN 'invalid' WHEN action = 'refresh' THEN had WHEN action = 'unchanged' THEN CASE WHEN missing > 0 THEN 'warning' WHEN had = 'unavailable' THEN 'valid' ELSE had END WHEN action = 'moved' AND moved_had = 'conflict' THEN 'conflict' ELSE {status} END status,
CASE WHEN action = 'invalid' THEN 'unverified' WHEN action = 'refresh' THEN had_v WHEN action = 'unchanged' THEN CASE WHEN missing > 0 THEN 'unverified' ELSE had_v END WHEN action = 'moved' AND moved_had = 'conflict' THEN 'unverified' ELSE {verify} END verify_status,
CASE WHEN action = 'invalid' THEN CASE WHEN body = 'unreadable' THEN 'manifest unreadable' ELSE 'manifest parse/validation failed' END WHEN action = 'refresh' THEN NULL WHEN action = 'unchanged' THEN CASE WHEN missing > 0 THEN 'referenced object(s) missing' END WHEN action = 'moved' AND moved_had = 'conflict' THEN 'identity conflict with active package owning this release' ELSE {error} END last_error FROM a"""
_PK = "k AS (SELECT o_orderkey id, (o_custkey % 4)::BIGINT release_id, CASE WHEN o_orderkey % 6 <> 0 THEN ['valid','warning','conflict','unavailable','invalid'][o_orderkey % 5 + 1] END status, CASE WHEN o_orderkey % 3 > 0 THEN o_orderpriority END verify_status FROM orders)"
_AS = "s AS (SELECT analyzed_id id, analyzed_id % 200 release_id, CASE WHEN analyzed_id % 3 > 0 THEN analyzed_id % 500 END track_id, ['artwork','booklet','lyrics','extras'][analyzed_id % 4 + 1] kind, CASE WHEN analyzed_id % 10 = 6 THEN '' ELSE source_sha256 END sha, analyzed_id % 5 > 0 vis FROM analyzed)"
_LOW = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SQL = {
    "scan_actions": f"WITH {_SCAN} " + _REST.format(status="CASE WHEN missing > 0 THEN 'warning' ELSE 'valid' END", verify="'unverified'", error="CASE WHEN missing > 0 THEN missing || ' referenced object(s) missing' END"),
    "scan_actions_verified": f"WITH {_SCAN_V} " + _REST.format(status="CASE WHEN errors > 0 THEN 'checksum-failed' WHEN warnings > 0 THEN 'warning' ELSE 'valid' END", verify="CASE WHEN errors > 0 THEN 'checksum-failed' WHEN warnings > 0 THEN 'warning' ELSE 'valid' END", error="CASE WHEN errors > 0 THEN 'integrity verification failed (' || errors || ' errors, ' || warnings || ' warnings)' WHEN warnings > 0 THEN warnings || ' warning(s)' END"),
    "scan_counts": f"WITH {_SCAN} SELECT count(*) FILTER (action = 'ingest' AND NOT old) added, count(*) FILTER (action IN ('ingest', 'invalid') AND old) updated, count(*) FILTER (action = 'moved') moved, count(*) FILTER (action IN ('unchanged', 'refresh')) same, count(*) FILTER (action = 'invalid' AND NOT old) invalid FROM a",
    "merge_owners": """WITH v AS (SELECT release_key, manifest AS path, max(coalesce(fingerprint, '')) f, min(batch_no) b FROM vectors WHERE release_key IS NOT NULL AND manifest IS NOT NULL GROUP BY 1, 2), o AS (SELECT release_key, min(path) AS path, arg_min(f, path) f FROM v WHERE b = 0 GROUP BY 1), c AS (SELECT * FROM v WHERE b > 0),
        w AS (SELECT c.release_key, coalesce(any_value(o.path), min(c.path)) AS own, any_value(o.f) bef FROM c LEFT JOIN o ON o.release_key = c.release_key AND length(o.path) % 2 = 0 GROUP BY 1), n AS (SELECT w.*, coalesce(c.f, bef) aft FROM w LEFT JOIN c ON c.release_key = w.release_key AND c.path = own)
        SELECT c.release_key, c.path, CASE WHEN c.path = own THEN 'owner' WHEN (CASE WHEN c.path < own THEN bef ELSE aft END) IS NOT DISTINCT FROM c.f THEN 'mirror' ELSE 'conflict' END outcome FROM c JOIN n USING (release_key)""",
    "merge_artists_full": f"""WITH a AS (SELECT id, name, nullif(trim(sort_name), '') s, musicbrainz_id m FROM artists), k AS (SELECT id, name, CASE WHEN id % 3 > 0 THEN s END s, CASE WHEN id % 5 > 0 THEN m END m FROM a WHERE id % 2 = 1),
        t AS (SELECT l, min(n) n, min(s) s, min(m) m FROM (SELECT {_LOW.format('name')} l, CASE WHEN id % 3 = 0 THEN translate(name, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') ELSE name END n, s, m FROM a) GROUP BY 1),
        x AS (SELECT t.*, (SELECT min(id) FROM k WHERE k.m = t.m) i1, coalesce((SELECT min(id) FROM k WHERE k.name = t.n), (SELECT min(id) FROM k WHERE {_LOW.format('k.name')} = t.l)) i2 FROM t), y AS (SELECT x.*, k.m had FROM x LEFT JOIN k ON k.id = i2),
        f AS (SELECT m, min(n) lead, arg_min(coalesce(i2, -1), n) led FROM y WHERE m IS NOT NULL AND i1 IS NULL AND had IS NULL GROUP BY 1), z AS (SELECT y.*, i1 IS NULL AND lead IS NOT NULL AND n > lead foll, lead, nullif(led, -1) led FROM y LEFT JOIN f USING (m)),
        q AS (SELECT coalesce(i1, CASE WHEN foll THEN led ELSE i2 END) id, CASE WHEN foll AND led IS NULL THEN lead WHEN NOT foll AND i1 IS NULL AND i2 IS NULL THEN n END nw, n, s, CASE WHEN i1 IS NULL THEN m END m FROM z)
        SELECT k.id, k.name, coalesce(k.s, (SELECT arg_min(q.s, q.n) FROM q WHERE q.id = k.id AND q.s IS NOT NULL)) sort_name, coalesce(k.m, (SELECT arg_min(q.m, q.n) FROM q WHERE q.id = k.id AND q.m IS NOT NULL)) anchor FROM k
        UNION ALL SELECT NULL, nw, arg_min(s, n) FILTER (s IS NOT NULL), min(m) FROM q WHERE id IS NULL AND nw IS NOT NULL GROUP BY nw""",
    "merge_assets": """WITH t AS (SELECT DISTINCT track_id, artist_id, role, position FROM track_artists), o AS (SELECT *, row_number() OVER (PARTITION BY track_id, role, artist_id ORDER BY position) n FROM t WHERE (track_id + artist_id) % 5 <> 0),
        w AS (SELECT *, row_number() OVER (PARTITION BY track_id, role, artist_id ORDER BY position) n FROM (SELECT track_id, artist_id, CASE WHEN artist_id % 11 <> 0 THEN role END AS role, position FROM t WHERE (track_id + artist_id) % 7 <> 0)),
        j AS (SELECT coalesce(o.track_id, w.track_id) track_id, CASE WHEN o.n IS NULL THEN 'insert' WHEN w.n IS NULL THEN 'delete' ELSE 'update' END AS action FROM o FULL JOIN w ON o.track_id = w.track_id AND o.role IS NOT DISTINCT FROM w.role AND o.artist_id = w.artist_id AND o.n = w.n) SELECT track_id, action, count(*) n FROM j GROUP BY 1, 2""",
    "package_candidates": f"WITH {_PK} SELECT id FROM k WHERE status NOT IN ('unavailable', 'invalid', 'conflict')",
    "package_verified": f"WITH {_PK}, v AS (SELECT CASE WHEN id % 2 = 0 AND status <> 'conflict' THEN 'checksum-failed' ELSE status END status, CASE WHEN id % 2 = 0 AND status <> 'conflict' THEN 'checksum-failed' ELSE verify_status END verify_status FROM k) SELECT status, verify_status, count(*) n FROM v GROUP BY 1, 2",
    "package_rows": f"WITH {_PK} SELECT id, nullif(release_id, 0) release_id, coalesce(status, '') status, coalesce(verify_status, '') verify_status FROM k",
    "set_operations": "WITH e AS (SELECT DISTINCT label, len(embedding) n FROM embeddings), s AS (SELECT label, n + CASE WHEN label % 4 = 1 THEN 1 ELSE 0 END n FROM e WHERE label % 3 <> 0), j AS (SELECT e.label, s.label sid, CASE WHEN s.label IS NULL THEN 'added' WHEN s.n = e.n THEN 'reused' ELSE 'refused' END outcome FROM e LEFT JOIN s ON s.label = e.label) SELECT label::VARCHAR fingerprint, CASE WHEN outcome <> 'refused' THEN sid::BIGINT END id, outcome, CASE WHEN outcome = 'reused' AND sid % 2 = 0 THEN 'active' ELSE 'inactive' END state FROM j",
    "asset_release": f"WITH {_AS} SELECT release_id, id, kind FROM s WHERE track_id IS NULL",
    "asset_lyrics": f"WITH {_AS} SELECT release_id, track_id, id FROM s WHERE vis AND kind = 'lyrics' AND track_id IS NOT NULL AND sha <> ''",
    "asset_served": f"WITH {_AS} SELECT id, kind FROM s WHERE vis AND kind IN ('artwork', 'booklet', 'lyrics')",
    "representation_list": "WITH t AS (SELECT id AS track_id, -1::BIGINT p, 'primary' id, coalesce(source_audio_codec, '') AS label FROM tracks UNION ALL SELECT track_id, position, min(artist_id)::VARCHAR, 'v' || position FROM track_artists WHERE track_id IN (SELECT id FROM tracks) GROUP BY track_id, position) SELECT track_id, row_number() OVER (PARTITION BY track_id ORDER BY p) AS ord, id, label FROM t",
    "text_scalars": """WITH e AS (SELECT *, CASE WHEN event_id % 7 > 0 THEN event_id || CASE WHEN event_id % 5 = 0 THEN 'x' ELSE '' END END pg FROM events), w AS (SELECT *, greatest(0, least(value, value * 2 - (value - 100))) wi FROM e)
        SELECT event_id, 't' || user_id || CASE WHEN event_id % 3 = 0 THEN 'r' || event_id ELSE '' END item, CASE WHEN pg IS NULL THEN 50 WHEN pg LIKE '%x' THEN NULL ELSE greatest(1, least(500, pg::BIGINT)) END::BIGINT AS page, round(wi, 4) inside, round(CASE WHEN value > 0 THEN greatest(0, least(100, wi / value * 100)) ELSE 0 END, 4) fill, round(least(255, floor(value)) / 255 * 40)::BIGINT height,
        CASE event_type WHEN 'click' THEN {click} WHEN 'error' THEN {error} WHEN 'purchase' THEN {purchase} WHEN 'signup' THEN {signup} ELSE {view} END::BIGINT crc FROM w""".format(**{k: __import__("zlib").crc32(k.encode()) for k in ("click", "error", "purchase", "signup", "view")}),
    "text_preferences": "SELECT event_id, CASE event_id % 9 WHEN 0 THEN 'default' WHEN 1 THEN 'representation' WHEN 4 THEN 'codec' WHEN 5 THEN 'lossless' END AS mode FROM events WHERE event_id % 2 = 0",
    "eval_gates_seven": """WITH m AS (SELECT label k, count(*) n, max(abs(sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))) - 1)) o, max(coalesce(list_sum(list_transform(list_filter(embedding::DOUBLE[], lambda x: abs(x) < pow(2, -14)), lambda x: x * x)), 0) / list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))) s FROM embeddings GROUP BY 1), g AS (SELECT *, unnest(['B-A1','B-A2','B-B1','B-B2','B-C1','B-C2','B-C3']) gate FROM m)
        SELECT k AS label, gate, CASE WHEN k = 5 AND gate[3] IN ('A', 'B') THEN 'not-evaluated' WHEN gate = 'B-B1' AND k = 2 THEN 'not-evaluated' WHEN gate = 'B-B2' AND (k * 5 < 21 OR k = 7 OR k * 3 < 13) THEN 'not-evaluated'
        WHEN CASE gate WHEN 'B-A1' THEN k * 3e-4 <= pow(2, -10) WHEN 'B-A2' THEN k * 2e-4 <= pow(2, -10) WHEN 'B-B1' THEN k % 3 = 0 WHEN 'B-B2' THEN k % 4 = 0 WHEN 'B-C1' THEN o <= pow(2, -10) WHEN 'B-C2' THEN s <= pow(2, -24) ELSE k <> 5 END THEN 'pass' ELSE 'fail' END state FROM g""",
    "eval_overlap_summary": _TWO + ", la AS (SELECT id, list(nbr ORDER BY rank) la FROM a GROUP BY 1), lb AS (SELECT id, list(nbr ORDER BY rank) lb FROM b GROUP BY 1), j AS (SELECT k, len(list_intersect(la[1:k], lb[1:k]))::DOUBLE / len(list_distinct(list_concat(la[1:k], lb[1:k]))) j FROM la JOIN lb USING (id), (VALUES (1), (5), (10)) t(k)) SELECT k, round(avg(j), 6) mean_jaccard, count(*) FILTER (j < 1) changed FROM j GROUP BY 1",
    "eval_queries_filled": "WITH h AS (SELECT id, media_id, sha256(uid) h FROM tracks), g AS (SELECT media_id, arg_min(id, h) id FROM h GROUP BY 1 ORDER BY sha256(media_id::VARCHAR), media_id LIMIT 300), r AS (SELECT id, h, 1 l FROM h WHERE id NOT IN (SELECT id FROM g)), b AS (SELECT id, h, 0 l FROM h WHERE id IN (SELECT id FROM g) UNION ALL SELECT * FROM r), c AS (SELECT * FROM b ORDER BY l, h, id LIMIT 300) SELECT row_number() OVER (ORDER BY h, id) AS place, id FROM c",
    "catalog_release_nested": "WITH m AS (SELECT media_id // 5 release_id, media_id, string_agg(id, ',' ORDER BY track_number NULLS FIRST, id) t FROM tracks GROUP BY 1, 2) SELECT release_id, string_agg(media_id || ':' || t, ';' ORDER BY media_id) media FROM m GROUP BY 1",
    "mix_swaps": "SELECT o_orderkey, greatest(0, floor(o_totalprice)::BIGINT - o_orderkey * 10) AS overlap, greatest(0, o_orderkey * 10 - o_custkey * 100) rebase FROM orders",
    "verify_ok": "WITH f AS (" + _CHANGES["verify_findings"] + ") SELECT count(*) errors, count(*) = 0 is_ok FROM f",
    "member_sizes": "WITH l AS (SELECT l_orderkey, l_linenumber || '/' || l_partkey p, sum(l_quantity::BIGINT)::BIGINT s FROM lineitem GROUP BY 1, 2) SELECT l_orderkey, count(*)::INT AS members, sum(s)::BIGINT AS size FROM l GROUP BY 1",
}
SQL["merge_ownership"] = f"SELECT outcome, count(*) n FROM ({SQL['merge_owners']}) GROUP BY 1"
