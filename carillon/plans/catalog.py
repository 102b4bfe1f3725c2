"""Catalog queries. Groups are customers with their nation as the credited name; children are orders, of which F and O are visible."""

from __future__ import annotations

from pyspark.sql import functions as F

from carillon.functions.text import contains_nocase
from carillon.operators import catalog as C
from carillon.operators.skew import heavy_keys, lookup_join
from carillon.tables import load

GATE = ("F", "O")


def _groups(s, d):
    nation = load(s, d, "nation").select("n_nationkey", "n_name")
    return load(s, d, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left").select("c_custkey", "c_name", "n_name")


def _orders(s, d):
    return load(s, d, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_orderdate", "o_orderstatus", "o_totalprice")


def _albums(s, d, **kw):
    got = C.list_page(_groups(s, d), _orders(s, d), "c_custkey", "c_name", "n_name", "o_orderdate", "o_orderkey", C.visible(F.col("o_orderstatus"), good=GATE), **kw)
    return got.select("c_custkey", "c_name", "n_name", "n_children", "first_child")


def catalog_albums_page(s, d):
    return _albums(s, d, limit=50, offset=20)


def catalog_albums_search(s, d):
    return _albums(s, d, query="N_1", limit=200)


def catalog_recent(s, d):
    return _albums(s, d, recent=True, limit=100)


def _albums_sql(where, order, tail):
    return f"""
WITH per AS (SELECT o_custkey c_custkey, count(*) n_children, max(o_orderdate) latest, min(o_orderdate) first_date FROM orders WHERE o_orderstatus IN ('F','O') GROUP BY 1),
f AS (SELECT o_custkey c_custkey, o_orderkey first_child FROM orders WHERE o_orderstatus IN ('F','O') QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1)
SELECT c.c_custkey, c_name, n_name, n_children, first_child FROM customer c LEFT JOIN nation n ON c_nationkey = n_nationkey JOIN per USING (c_custkey) JOIN f USING (c_custkey)
{where} ORDER BY {order} {tail}"""


def catalog_artists_page(s, d):
    """Artists with the number of distinct media on which they are credited; one artist may hold much of all credits, so names
    meet counts and not credits."""
    links, tracks = load(s, d, "track_artists").select("track_id", "artist_id"), load(s, d, "tracks").select(F.col("id").alias("track_id"), "media_id")
    per = links.join(tracks, "track_id").groupBy("artist_id").agg(F.countDistinct("media_id").alias("n_media"), F.count(F.lit(1)).alias("n_credits"))
    named = per.join(load(s, d, "artists").select(F.col("id").alias("artist_id"), "name"), "artist_id")
    return C.page(named, [F.translate("name", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.col("artist_id")], 200, 0)


def catalog_artists_total(s, d):
    """How many artists a search finds, counted by semi-join and without paging."""
    links = load(s, d, "track_artists").select("artist_id")
    found = load(s, d, "artists").where(contains_nocase(F.col("name"), "the ")).join(links, F.col("id") == F.col("artist_id"), "left_semi")
    return found.agg(F.count(F.lit(1)).alias("total"))


def catalog_artist_detail(s, d):
    """One artist's media, each once though credited on many tracks."""
    mine = load(s, d, "track_artists").where("artist_id = 1").select("track_id").distinct()
    return load(s, d, "tracks").join(mine, F.col("id") == F.col("track_id"), "left_semi").groupBy("media_id").agg(F.min("track_number").alias("first_track"), F.count(F.lit(1)).alias("n_tracks"))


def catalog_release_detail(s, d):
    """Orders of one customer with the number and sum of their lines; orders without lines count 0."""
    lines = load(s, d, "lineitem").select("l_orderkey", "l_quantity").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n_lines"), F.sum("l_quantity").alias("quantity"))
    got = load(s, d, "orders").where(C.visible(F.col("o_orderstatus"), good=GATE)).join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return got.select("o_orderkey", "o_custkey", F.coalesce("n_lines", F.lit(0)).alias("n_lines"), F.round(F.coalesce("quantity", F.lit(0.0)), 2).alias("quantity"))


def catalog_track_detail(s, d):
    """The inner chain line, order, customer, nation, region behind the gate."""
    o = load(s, d, "orders").where(C.visible(F.col("o_orderstatus"), good=GATE)).select("o_orderkey", "o_custkey")
    c = load(s, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    n = load(s, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_regionkey", "n_name")
    r = load(s, d, "region").select(F.col("r_regionkey").alias("n_regionkey"), "r_name")
    lines = load(s, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_extendedprice")
    chain = lines.join(o, "o_orderkey").join(c, "o_custkey").join(n, "c_nationkey").join(r, "n_regionkey")
    return chain.groupBy("r_name", "n_name").agg(F.count(F.lit(1)).alias("n_lines"), F.round(F.sum("l_extendedprice"), 2).alias("price"))


def catalog_left_waveform(s, d):
    """Tracks with their analysis where there is one: the left side stays whole, the struct is null unless all its parts are set."""
    t = load(s, d, "tracks").select("id", "source_audio_md5", F.when(F.col("has_duration") == 1, F.col("duration")).alias("duration"))
    a = load(s, d, "analyzed").select(F.col("analyzed_id").alias("id"), "frame_count", "patch_count")
    return t.join(a, "id", "left").select("id", F.round("duration", 4).alias("duration"), F.when(F.col("frame_count").isNotNull() & F.col("patch_count").isNotNull(), F.col("frame_count")).alias("frames"))


def catalog_track_credits(s, d):
    """Every track's credited names in order; the artist who holds a tenth of the credits is joined apart."""
    links, names = load(s, d, "track_artists"), load(s, d, "artists").select(F.col("id").alias("artist_id"), "name")
    n = links.count()
    joined = lookup_join(links, names, "artist_id", heavy_keys(links, "artist_id", n))
    got = joined.groupBy("track_id").agg(F.transform(F.array_sort(F.collect_set(F.struct("position", "artist_id", "name"))), lambda x: x["name"]).alias("credits"))
    return got.select("track_id", F.array_join("credits", " / ").alias("credits"))


def catalog_media_formats(s, d):
    """Each medium's codecs, in the order of the track on which each first occurs."""
    got = C.distinct_by_first(load(s, d, "tracks"), "media_id", "source_audio_codec", "track_number")
    return got.select("media_id", F.array_join("values", ",").alias("formats"))


def catalog_variants_top16(s, d):
    """The first sixteen credits of each artist by track."""
    return C.first_n(load(s, d, "track_artists").select("artist_id", "track_id", "position").distinct(), "artist_id", [F.col("track_id"), F.col("position")], 16).select("artist_id", "track_id", "position", F.col("rank").cast("bigint").alias("rank"))


def catalog_release_media(s, d):
    """Media with their tracks nested in order."""
    media = load(s, d, "tracks").select("media_id").distinct()
    got = C.nest(media, load(s, d, "tracks").select("media_id", "track_number", "id", "title"), "media_id", ["track_number", "id"], ["id"], "tracks")
    return got.select("media_id", F.array_join(F.transform("tracks", lambda x: x["id"].cast("string")), ",").alias("tracks"))


def catalog_top_credit(s, d):
    """Each track's first credit by position."""
    return C.first_by(load(s, d, "track_artists"), "track_id", [F.col("position"), F.col("artist_id")], {"artist_id": "first_artist"})


def catalog_album_art(s, d):
    """Each customer's earliest visible order with its price: three keys decide."""
    shown = _orders(s, d).where(C.visible(F.col("o_orderstatus"), good=GATE))
    return C.first_by(shown, "c_custkey", [F.col("o_orderdate"), F.col("o_orderkey")], {"o_orderkey": "art_id", "o_totalprice": "price"})


def catalog_multi_album_artists(s, d):
    """Artists with more than one distinct medium."""
    tracks = load(s, d, "tracks").select(F.col("id").alias("track_id"), "media_id")
    return C.having_several(load(s, d, "track_artists").select("track_id", "artist_id").join(tracks, "track_id"), "artist_id", "media_id")


def catalog_sessions(s, d):
    """Which of the events taken as sessions are authorised at one instant: users whose first event is an error are revoked."""
    e = load(s, d, "events")
    tokens = C.first_by(e, "user_id", [F.col("ts"), F.col("event_id")], {"event_type": "kind", "ts": "at"}).select(F.col("user_id").alias("token_hash"), F.when(F.col("kind") == "error", F.col("at")).alias("revoked_at"))
    sess = e.select("event_id", F.col("user_id").alias("token_hash"), (F.col("ts") + F.expr("INTERVAL 30 DAYS")).alias("expires_at"), F.when(F.col("event_type") == "signup", F.col("ts")).alias("revoked_at"))
    return C.authorized(sess, tokens, F.lit("2024-02-10 00:00:00").cast("timestamp_ntz")).select("event_id", F.col("token_hash").alias("user_id"))


def catalog_point_lookup(s, d):
    """Two natural keys looked up at once."""
    return load(s, d, "lineitem").where("l_orderkey = 7 and l_linenumber = 1").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


def catalog_rollup(s, d):
    """Visible orders per nation and customer with their totals."""
    got = _orders(s, d).where(C.visible(F.col("o_orderstatus"), good=GATE)).join(_groups(s, d), "c_custkey")
    return got.rollup("n_name", "c_custkey").agg(F.count(F.lit(1)).alias("n")).select("n_name", "c_custkey", "n")


QUERIES = {f.__name__: f for f in (
    catalog_albums_page, catalog_albums_search, catalog_recent, catalog_artists_page, catalog_artists_total, catalog_artist_detail, catalog_release_detail, catalog_track_detail, catalog_left_waveform,
    catalog_track_credits, catalog_media_formats, catalog_variants_top16, catalog_release_media, catalog_top_credit, catalog_album_art, catalog_multi_album_artists, catalog_sessions, catalog_point_lookup, catalog_rollup,
)}
FOLD = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SQL = {
    "catalog_albums_page": _albums_sql("", f"{FOLD.format('n_name')} NULLS FIRST, {FOLD.format('c_name')}, first_date, c.c_custkey", "LIMIT 50 OFFSET 20"),
    "catalog_albums_search": _albums_sql("WHERE contains(lower(c_name), 'n_1') OR contains(lower(n_name), 'n_1')", f"{FOLD.format('n_name')} NULLS FIRST, {FOLD.format('c_name')}, first_date, c.c_custkey", "LIMIT 200"),
    "catalog_recent": _albums_sql("", "latest DESC, c.c_custkey DESC", "LIMIT 100"),
    "catalog_artists_page": f"SELECT artist_id, count(DISTINCT media_id) n_media, count(*) n_credits, any_value(name) AS name FROM track_artists JOIN tracks ON track_id = tracks.id JOIN artists ON artist_id = artists.id GROUP BY artist_id ORDER BY {FOLD.format('any_value(name)')}, artist_id LIMIT 200",
    "catalog_artists_total": f"SELECT count(*) total FROM artists WHERE contains({FOLD.format('name')}, 'the ') AND id IN (SELECT artist_id FROM track_artists)",
    "catalog_artist_detail": "SELECT media_id, min(track_number) first_track, count(*) n_tracks FROM tracks WHERE id IN (SELECT track_id FROM track_artists WHERE artist_id = 1) GROUP BY 1",
    "catalog_release_detail": "SELECT o_orderkey, o_custkey, count(l_orderkey) n_lines, round(coalesce(sum(l_quantity), 0), 2) quantity FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus IN ('F','O') GROUP BY 1, 2",
    "catalog_track_detail": "SELECT r_name, n_name, count(*) n_lines, round(sum(l_extendedprice), 2) price FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE o_orderstatus IN ('F','O') GROUP BY 1, 2",
    "catalog_left_waveform": "SELECT t.id, round(CASE WHEN has_duration = 1 THEN duration END, 4) duration, CASE WHEN frame_count IS NOT NULL AND patch_count IS NOT NULL THEN frame_count END frames FROM tracks t LEFT JOIN analyzed a ON a.analyzed_id = t.id",
    "catalog_track_credits": "SELECT track_id, string_agg(name, ' / ' ORDER BY position, artist_id) credits FROM (SELECT DISTINCT track_id, position, artist_id, name FROM track_artists JOIN artists ON artist_id = id) GROUP BY 1",
    "catalog_media_formats": "SELECT media_id, string_agg(source_audio_codec, ',' ORDER BY pos, source_audio_codec) formats FROM (SELECT media_id, source_audio_codec, min(track_number) pos FROM tracks WHERE source_audio_codec IS NOT NULL GROUP BY 1, 2) GROUP BY 1",
    "catalog_variants_top16": "SELECT artist_id, track_id, position, row_number() OVER (PARTITION BY artist_id ORDER BY track_id, position) AS rank FROM (SELECT DISTINCT artist_id, track_id, position FROM track_artists) QUALIFY rank <= 16",
    "catalog_release_media": "SELECT media_id, string_agg(id, ',' ORDER BY track_number NULLS FIRST, id) tracks FROM tracks GROUP BY 1",
    "catalog_top_credit": "SELECT track_id, artist_id AS first_artist FROM track_artists QUALIFY row_number() OVER (PARTITION BY track_id ORDER BY position, artist_id) = 1",
    "catalog_album_art": "SELECT o_custkey c_custkey, o_orderkey art_id, o_totalprice price FROM orders WHERE o_orderstatus IN ('F','O') QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1",
    "catalog_multi_album_artists": "SELECT artist_id, count(DISTINCT media_id) n_values FROM track_artists JOIN tracks ON track_id = id GROUP BY 1 HAVING count(DISTINCT media_id) > 1",
    "catalog_sessions": "WITH t AS (SELECT user_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1) SELECT event_id, user_id FROM events WHERE event_type <> 'signup' AND ts + INTERVAL 30 DAYS >= TIMESTAMP '2024-02-10 00:00:00' AND user_id IN (SELECT user_id FROM t WHERE event_type <> 'error')",
    "catalog_point_lookup": "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem WHERE l_orderkey = 7 AND l_linenumber = 1",
    "catalog_rollup": "SELECT n_name, c_custkey, count(*) n FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey WHERE o_orderstatus IN ('F','O') GROUP BY ROLLUP (n_name, c_custkey)",
}
