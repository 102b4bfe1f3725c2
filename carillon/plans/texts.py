"""Queries of text, path, JSON and digest functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from carillon.functions import hashing as H
from carillon.functions import text as X
from carillon.operators import linkage as L
from carillon.tables import load


def text_like_search(s, d):
    """Titles that hold a text, letters in any case, the text's wildcards being plain."""
    return load(s, d, "tracks").where(X.contains_nocase(F.col("title"), "GARDEN")).select("id", "title")


def text_escape(s, d):
    a = load(s, d, "artists").select("id", F.concat("name", F.lit("_100%\\")).alias("t"))
    return a.select("id", X.escape_like(F.col("t"), 36).alias("escaped"))


def text_nocase(s, d):
    """Names in order of their letters in any case of A to Z, as a position."""
    from pyspark.sql import Window

    n = load(s, d, "supplier").withColumn("k", X.ascii_lower(F.col("s_name")))
    return n.select("s_suppkey", F.row_number().over(Window.partitionBy("s_nationkey").orderBy("k", "s_suppkey")).cast("bigint").alias("pos"))


def text_numbers(s, d):
    """Numbers, titles and discs read from file names made of the tracks."""
    t = load(s, d, "tracks").select("id", F.concat(F.coalesce(F.col("track_number").cast("string"), F.lit("")), F.lit(" - "), F.coalesce("title", F.lit(""))).alias("stem"), F.concat(F.when(F.col("id") % 2 == 0, F.lit("CD")).otherwise(F.lit("Disc-")), (F.col("id") % 4).cast("string")).alias("dir"))
    return t.select("id", X.leading_number(F.col("stem")).alias("number"), X.title_from_stem(F.col("stem")).alias("title"), X.disc_from_dirname(F.col("dir")).alias("disc"))


def text_paths(s, d):
    """Faults of paths made of analysed files, some of them spoilt."""
    p, k = F.col("path"), F.col("analyzed_id") % 9
    bad = (
        F.when(k == 0, F.concat(F.lit("/"), p)).when(k == 1, F.concat(F.lit("a//"), p)).when(k == 2, F.concat(F.lit("../"), p)).when(k == 3, F.concat(p, F.lit("/."))).when(k == 4, F.concat(F.lit("c:"), p))
        .when(k == 5, F.concat(F.lit("a\\"), p)).when(k == 6, F.concat(p, F.lit("/"))).when(k == 7, F.lit("")).otherwise(p)
    )
    return load(s, d, "analyzed").where("path is not null").select("analyzed_id", X.path_fault(bad).alias("fault"))


def text_types(s, d):
    p = F.concat(F.lit("audio/x."), F.element_at(F.array(*(F.lit(x) for x in ("mpc", "flac", "FLAC", "jpeg", "lrc", "zip", ""))), (F.col("id") % 7 + 1).cast("int")))
    return load(s, d, "tracks").select("id", X.mime_for_path(p).alias("mime"), X.codec_for_path(p).alias("codec"))


def text_display(s, d):
    """Times, sizes, dates and codecs as they are shown."""
    t = load(s, d, "tracks")
    date = F.date_format(F.date_add(F.lit("1986-01-31").cast("date"), F.col("id").cast("int")), "yyyy-MM-dd")
    part = F.when(F.col("id") % 3 == 0, F.substring(date, 1, 7)).when(F.col("id") % 3 == 1, date)
    return t.select("id", X.fmt_time(F.col("duration") * 10).alias("time"), X.format_bytes(F.col("id") * F.col("id") * 977).alias("bytes"), X.codec_label(F.col("source_audio_codec")).alias("codec"), X.year_of(part).alias("year"), X.format_date(part).alias("date"))


def text_quality(s, d):
    t = load(s, d, "tracks")
    rate = F.when(F.col("id") % 2 == 0, F.lit(44100)).otherwise(F.lit(48000))
    return t.select("id", X.quality_line(F.col("source_audio_codec"), rate, (F.col("id") % 4).cast("int"), F.when(F.col("id") % 5 == 0, F.lit(" Hi-Res "))).alias("line"), X.medium_label(F.when(F.col("id") % 2 == 0, F.lit('12" LP'))).alias("medium"), X.country_name(F.when(F.col("id") % 3 == 0, F.lit("XE")).otherwise(F.lit("ZZ"))).alias("country"))


def text_names(s, d):
    """File-safe names and slugs."""
    return load(s, d, "artists").select("id", X.sanitize_component(F.concat("name", F.lit("/a:b"))).alias("safe"), X.profile_slug(F.col("name")).alias("slug"))


def text_ranges(s, d):
    """Byte ranges against sizes."""
    k = F.col("event_id")
    h = F.when(k % 5 == 0, F.concat(F.lit("bytes="), (k % 700).cast("string"), F.lit("-"), (k % 1300).cast("string"))).when(k % 5 == 1, F.concat(F.lit("bytes=-"), (k % 900).cast("string"))).when(k % 5 == 2, F.concat(F.lit("bytes="), (k % 1100).cast("string"), F.lit("-"))).when(k % 5 == 3, F.lit("bytes=1-2,4-5"))
    r = X.parse_range(h, F.lit(800).cast("bigint"))
    return load(s, d, "events").select("event_id", r["kind"].alias("kind"), r["first"].alias("first"), r["last"].alias("last"))


def text_lrc_stamps(s, d):
    """Timestamps made of durations, good and bad ones, read back."""
    m = F.floor(F.col("value") / 60).cast("string")
    ss = F.lpad(F.floor(F.col("value") % 70).cast("string"), 2, "0")
    st = F.concat(m, F.lit(":"), ss, F.when(F.col("event_id") % 3 == 0, F.lit(".5")).when(F.col("event_id") % 3 == 1, F.lit(".25")).otherwise(F.lit("")))
    return load(s, d, "events").select("event_id", X.parse_timestamp(st).alias("ms"), X.parse_offset(F.concat(F.lit("-"), F.col("event_id").cast("string"))).alias("offset"))


def text_mbid(s, d):
    return load(s, d, "artists").select("id", X.valid_mbid(F.col("musicbrainz_id")).alias("valid"), X.anchor(F.upper("musicbrainz_id")).alias("anchor"))


def hash_group_key(s, d):
    """Identity keys from title, date and credited names in byte order."""
    links = load(s, d, "track_artists").where("artist_id <> 1").join(load(s, d, "artists").select(F.col("id").alias("artist_id"), "name"), "artist_id").groupBy("track_id").agg(F.collect_set(F.struct("name", "role")).alias("artists"))
    t = load(s, d, "tracks").join(links, F.col("id") == F.col("track_id"))
    return t.select("id", H.group_key(F.col("mbid_track"), F.col("title"), F.col("isrc"), F.lit(None).cast("string"), F.col("artists")).alias("key"))


def hash_release_key(s, d):
    t = load(s, d, "tracks")
    return t.select("id", H.release_key(F.col("mbid_recording"), F.col("source_store"), F.lit(""), F.col("source_track_id"), F.col("source_audio_codec"), F.col("source_audio_md5"), F.col("isrc")).alias("key"))


def hash_digests(s, d):
    m = load(s, d, "manifests")
    return m.select("manifest_id", F.sha2(F.col("manifest"), 256).alias("sha256"), F.crc32(F.col("manifest")).alias("crc")).select("manifest_id", "sha256", H.is_digest(F.col("sha256")).alias("ok"))


def json_genres(s, d):
    """Genres of readable manifests, written back as JSON; null for none."""
    g = F.from_json(F.get_json_object("manifest", "$.album.genres"), "array<string>")
    return load(s, d, "manifests").select("manifest_id", F.when(F.size(g) > 0, F.array_join(g, "|")).alias("genres"), F.get_json_object("manifest", "$.album.title").alias("title"))


def json_props(s, d):
    k = F.get_json_object("props", "$.k").cast("bigint")
    return load(s, d, "events").groupBy("event_type").agg(F.sum(k).alias("total"), F.max(k).alias("most"))


def link_confidence(s, d):
    """How surely each track is the next one again."""
    t = load(s, d, "tracks").select("id", "mbid_track", "source_track_id", "isrc", "title", "track_number")
    n = t.select((F.col("id") - 1).alias("id"), *(F.col(c).alias(f"n_{c}") for c in ("mbid_track", "source_track_id", "isrc", "title", "track_number")))
    c = L.confidence(F.col("mbid_track"), F.col("n_mbid_track"), F.col("source_track_id"), F.col("n_source_track_id"), F.array_compact(F.array("isrc")), F.array_compact(F.array("n_isrc")), F.col("track_number"), F.col("n_track_number"), F.col("title"), F.col("n_title"))
    return t.join(n, "id").select("id", c.alias("confidence"))


def link_first_tag(s, d):
    """Each medium's first identifier by priority of its kind, then track."""
    t = load(s, d, "tracks").select("media_id", "id", F.explode(F.create_map(F.lit("mbid"), "mbid_track", F.lit("isrc"), "isrc", F.lit("store"), "source_track_id")).alias("k", "v"))
    return L.first_set(t, "media_id", ["mbid", "store", "isrc"], "k", "v", "id").select("media_id", F.col("v").alias("tag"))


def link_union_tags(s, d):
    t = L.union_first(load(s, d, "tracks").select("media_id", "source_store", "id"), "media_id", "source_store", "id")
    return t.select("media_id", F.array_join("values", "|").alias("stores"))


def link_resolve(s, d):
    """Which representation is played of those a medium's tracks stand for."""
    r = load(s, d, "tracks").groupBy("media_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("id", F.coalesce("source_audio_codec", F.lit("")).alias("codec")))), lambda x: F.struct(x["id"].alias("id"), x["codec"].alias("codec"), (x["id"] % 3 != 0).alias("playable"))).alias("reps"))
    k = F.col("media_id") % 4
    return r.select("media_id", L.resolve(F.col("reps"), k != 3, F.when(k == 0, F.get("reps", F.lit(0))["id"]), F.when(k == 1, F.lit("FLAC")), k == 2).alias("chosen"))


QUERIES = {f.__name__: f for f in (
    text_like_search, text_escape, text_nocase, text_numbers, text_paths, text_types, text_display, text_quality, text_names, text_ranges, text_lrc_stamps, text_mbid, hash_group_key, hash_release_key, hash_digests,
    json_genres, json_props, link_confidence, link_first_tag, link_union_tags, link_resolve,
)}


def _cases(column: str, table: dict[str, str], default: str) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items()) + f" ELSE {default} END"


def _field(tag: int, c: str) -> str:
    return f"CASE WHEN {c} IS NULL THEN ''::BLOB ELSE from_hex('{tag:02x}' || lpad(to_hex(strlen({c})), 8, '0')) || encode({c}) END"


def _fields(*parts: tuple[int, str]) -> str:
    return " || ".join(_field(t, c) for t, c in parts)


_MBID = "regexp_matches({0}, '^[0-9a-fA-F]{{8}}(-[0-9a-fA-F]{{4}}){{3}}-[0-9a-fA-F]{{12}}$')"
_STEM = "coalesce(track_number::VARCHAR, '') || ' - ' || coalesce(title, '')"
_LABEL = f"CASE WHEN coalesce(source_audio_codec, '') = '' THEN '' ELSE {_cases('lower(source_audio_codec)', X.CODEC_LABEL, 'upper(source_audio_codec)')} END"
_EXT = "list_extract(['mpc', 'flac', 'FLAC', 'jpeg', 'lrc', 'zip', ''], (id % 7 + 1)::INT)"
_NUM = "regexp_replace(printf('%.{0}f', floor({1} * {2} + 0.5) / {2}), '\\.?0+$', '')"
SQL = {
    "text_like_search": "SELECT id, title FROM tracks WHERE title ILIKE '%garden%'",
    "text_escape": r"WITH a AS (SELECT id, name || '_100%\' AS t FROM artists) SELECT id, CASE WHEN strlen(regexp_replace(t, '([\\%_])', '\\\1', 'g')) - 2 + 2 < 36 THEN regexp_replace(t, '([\\%_])', '\\\1', 'g') END escaped FROM a",
    "text_nocase": "SELECT s_suppkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY lower(s_name), s_suppkey) pos FROM supplier",
    "text_numbers": f"SELECT id, CASE WHEN regexp_extract({_STEM}, '^([0-9]+)', 1) <> '' AND regexp_extract({_STEM}, '^([0-9]+)', 1)::BIGINT BETWEEN 1 AND 2147483647 THEN regexp_extract({_STEM}, '^([0-9]+)', 1)::INT END AS number, CASE WHEN regexp_replace({_STEM}, '^[0-9]*[ \\-_.]*', '') = '' THEN {_STEM} ELSE regexp_replace({_STEM}, '^[0-9]*[ \\-_.]*', '') END title, nullif(id % 4, 0)::INT disc FROM tracks",
    "text_paths": "SELECT analyzed_id, CASE analyzed_id % 9 WHEN 0 THEN 'absolute' WHEN 1 THEN 'empty segment' WHEN 2 THEN 'parent segment' WHEN 3 THEN 'dot segment' WHEN 4 THEN 'colon' WHEN 5 THEN 'backslash' WHEN 6 THEN 'trailing separator' WHEN 7 THEN 'empty' END fault FROM analyzed WHERE path IS NOT NULL",
    "text_types": f"SELECT id, {_cases(_EXT, X.MIME, chr(39) + 'application/octet-stream' + chr(39))} mime, {_cases(_EXT, X.CODEC, chr(39) + 'unknown' + chr(39))} codec FROM tracks",
    "text_display": f"""WITH t AS (SELECT id, floor(duration * 10)::BIGINT s, duration, (id * id * 977)::DOUBLE b, id * id * 977 n, {_LABEL} codec, strftime(DATE '1986-01-31' + id::INT, '%Y-%m-%d') dt FROM tracks), u AS (SELECT *, CASE id % 3 WHEN 0 THEN substr(dt, 1, 7) WHEN 1 THEN dt END p FROM t)
        SELECT id, CASE WHEN duration IS NULL OR duration < 0 THEN '0:00' WHEN s >= 3600 THEN printf('%d:%02d:%02d', s // 3600, s % 3600 // 60, s % 60) ELSE printf('%d:%02d', s // 60, s % 60) END AS time,
        CASE WHEN n <= 0 THEN '' WHEN n < 1024 THEN n || ' B' WHEN b / 1024 < 1024 THEN floor(b / 1024 + 0.5)::BIGINT || ' kB' WHEN b / 1048576 >= 1024 THEN {_NUM.format(2, 'b / 1073741824', 100)} || ' GB' WHEN b / 1048576 >= 100 THEN floor(b / 1048576 + 0.5)::BIGINT || ' MB' ELSE {_NUM.format(1, 'b / 1048576', 10)} || ' MB' END bytes,
        codec, substr(coalesce(p, ''), 1, 4) AS year, CASE WHEN p IS NULL THEN '' WHEN len(p) > 7 THEN substr(p, 9, 2)::INT || ' ' ELSE '' END || CASE WHEN p IS NULL THEN '' ELSE strftime(strptime(substr(p, 1, 7) || '-01', '%Y-%m-%d'), '%b %Y') END AS date FROM u""",
    "text_quality": f"""WITH t AS (SELECT id, source_audio_codec c, CASE WHEN id % 5 = 0 THEN 'Hi-Res' ELSE {_LABEL} END base, CASE WHEN id % 2 = 0 THEN '44.1 kHz' ELSE '48 kHz' END khz, id % 4 ch FROM tracks)
        SELECT id, CASE WHEN base = '' THEN '' WHEN coalesce(c, '') = '' OR lower(c) IN ('musepack', 'musepack-sv7', 'musepack-sv8') THEN base ELSE concat_ws(' · ', base, khz, CASE WHEN ch = 2 THEN 'stereo' WHEN ch > 2 THEN ch || ' ch' END) END line, CASE WHEN id % 2 = 0 THEN 'Vinyl' ELSE 'Digital' END medium, CASE WHEN id % 3 = 0 THEN 'Europe' ELSE 'ZZ' END country FROM t""",
    "text_names": "SELECT id, regexp_replace(name || '/a:b', '[/\\\\:]', '-', 'g') safe, CASE WHEN name = '' THEN 'profile' ELSE regexp_replace(name, '[^A-Za-z0-9\\-_.]', '_', 'g') END slug FROM artists",
    "text_ranges": """WITH e AS (SELECT event_id k, event_id % 5 m, CASE WHEN event_id % 5 = 0 THEN event_id % 700 WHEN event_id % 5 = 2 THEN event_id % 1100 END x, CASE WHEN event_id % 5 = 0 THEN event_id % 1300 WHEN event_id % 5 = 1 THEN event_id % 900 END y FROM events),
        f AS (SELECT *, CASE WHEN m > 2 OR (x IS NOT NULL AND y < x) THEN 'none' WHEN x IS NULL AND y = 0 THEN 'unsatisfiable' WHEN x >= 800 THEN 'unsatisfiable' ELSE 'range' END kind FROM e)
        SELECT k event_id, kind, CASE WHEN kind = 'range' THEN coalesce(x, greatest(0, 800 - y)) END AS first, CASE WHEN kind = 'range' THEN CASE WHEN x IS NULL OR y IS NULL THEN 799 ELSE least(y, 799) END END AS last FROM f""",
    "text_lrc_stamps": "WITH e AS (SELECT event_id, floor(value / 60)::BIGINT m, floor(value % 70)::BIGINT s, event_id % 3 f FROM events) SELECT event_id, CASE WHEN s <= 59 AND f <> 0 THEN (m * 60 + s) * 1000 + CASE f WHEN 1 THEN 250 ELSE 0 END END ms, CASE WHEN event_id <= 3600000 THEN -event_id END AS offset FROM e",
    "text_mbid": f"SELECT id, coalesce({_MBID.format('musicbrainz_id')}, false) AS valid, CASE WHEN {_MBID.format('musicbrainz_id')} THEN upper(musicbrainz_id) END anchor FROM artists",
    "hash_group_key": f"""WITH c AS (SELECT DISTINCT track_id, name, role FROM track_artists JOIN artists ON artist_id = id WHERE artist_id <> 1), b AS (SELECT track_id, string_agg(to_hex({_field(4, 'name')} || {_field(5, 'role')}), '' ORDER BY name, coalesce(role, ''), role NULLS FIRST) h FROM c GROUP BY 1)
        SELECT id, CASE WHEN {_MBID.format('mbid_track')} THEN 'mb:' || mbid_track ELSE 'h:' || sha256({_fields((1, 'title'), (2, 'isrc'))} || from_hex(h)) END AS key FROM tracks JOIN b ON track_id = id""",
    "hash_release_key": f"SELECT id, CASE WHEN {_MBID.format('mbid_recording')} THEN 'mb:' || mbid_recording ELSE 'h:' || sha256({_fields((6, 'source_store'), (7, chr(39) * 2), (8, 'source_track_id'), (9, 'source_audio_codec'), (10, 'source_audio_md5'), (11, 'isrc'))}) END AS key FROM tracks",
    "hash_digests": "SELECT manifest_id, sha256(manifest) sha256, manifest IS NOT NULL ok FROM manifests",
    "json_props": "SELECT event_type, sum((props::JSON->>'$.k')::BIGINT)::BIGINT total, max((props::JSON->>'$.k')::BIGINT) most FROM events GROUP BY 1",
    "link_confidence": "SELECT a.id, CASE WHEN a.mbid_track = b.mbid_track THEN 'exact' WHEN b.source_track_id <> '' AND a.source_track_id = b.source_track_id THEN 'confirmed' WHEN a.isrc = b.isrc AND a.track_number = b.track_number AND b.track_number > 0 THEN 'confirmed' WHEN a.isrc = b.isrc OR (a.title <> '' AND a.title = b.title) THEN 'probable' ELSE 'none' END confidence FROM tracks a JOIN tracks b ON b.id = a.id + 1",
    "link_first_tag": "SELECT media_id, arg_min(v, (p, id, v)) tag FROM (SELECT media_id, id, mbid_track v, 1 p FROM tracks UNION ALL SELECT media_id, id, source_track_id, 2 FROM tracks UNION ALL SELECT media_id, id, isrc, 3 FROM tracks) WHERE v <> '' GROUP BY 1",
    "link_union_tags": "SELECT media_id, string_agg(source_store, '|' ORDER BY f, source_store) stores FROM (SELECT media_id, source_store, min(id) f FROM tracks WHERE source_store <> '' GROUP BY 1, 2) GROUP BY 1",
    "link_resolve": """WITH r AS (SELECT media_id, media_id % 4 k, min(id) FILTER (id % 3 <> 0) ok, min(id) AS a, min(id) FILTER (id % 3 <> 0 AND lower(source_audio_codec) = 'flac') fl, min(id) FILTER (id % 3 <> 0 AND lower(source_audio_codec) IN ('flac','wav','alac','aiff')) ll FROM tracks GROUP BY 1)
        SELECT media_id, CASE k WHEN 0 THEN CASE WHEN a % 3 <> 0 THEN a END WHEN 1 THEN fl WHEN 2 THEN ll ELSE ok END chosen FROM r""",
}
