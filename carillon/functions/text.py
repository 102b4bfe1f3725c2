"""Text, path, time and lyric scalars as Column functions. None of them runs Python per row."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(c: Column) -> Column:
    """Lower case of the letters A to Z alone, so É and é stay different."""
    return F.translate(c, UPPER, LOWER)


def escape_like(c: Column, cap: int = 512) -> Column:
    """``c`` with backslash, percent and underscore escaped; null where the outcome would reach ``cap`` bytes less two."""
    out = F.regexp_replace(c, r"([\\%_])", r"\\$1")
    # the bytes before the last character must leave room for two more
    last = F.when(F.substring(c, -1, 1).rlike(r"[\\%_]"), F.lit(2)).otherwise(F.octet_length(F.substring(c, -1, 1)))
    return F.when(F.length(c) == 0, F.lit("")).when(F.octet_length(out) - last + 2 < cap, out)


def contains_nocase(c: Column, query: str) -> Column:
    """Whether ``query`` stands in ``c``, letters A to Z in any case; its wildcards are plain characters."""
    return F.contains(ascii_lower(c), F.lit(query.translate(str.maketrans(UPPER, LOWER))))


def leading_number(c: Column) -> Column:
    """The digits a text begins with, as a number from 1; else null. ``3/12`` gives 3."""
    n = F.regexp_extract(c, r"^([0-9]+)", 1)
    v = F.when((n != "") & (F.length(F.regexp_replace(n, "^0+", "")) <= 10), n.try_cast("bigint"))
    return F.when(v.between(1, 2147483647), v.cast("int"))


def title_from_stem(c: Column) -> Column:
    """A file's stem without a leading number and the separators after it, or whole if nothing would be left."""
    cut = F.regexp_replace(c, r"^[0-9]*[ \-_.]*", "")
    return F.when(cut == "", c).otherwise(cut)


def disc_from_dirname(c: Column) -> Column:
    """The number of a folder such as ``CD1`` or ``Disc-2``."""
    return leading_number(F.regexp_extract(ascii_lower(c), r"^(?:cd|disc)[-_ ]*([0-9]+)", 1))


def extension(c: Column) -> Column:
    """What follows the last dot; empty if there is none."""
    return F.regexp_extract(c, r"\.([^.]*)$", 1)


# Media types and codecs by file extension.
MIME = {
    "mpc": "audio/musepack", "flac": "audio/flac", "wav": "audio/wav", "ogg": "audio/ogg",
    "jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png", "gif": "image/gif", "webp": "image/webp", "bmp": "image/bmp", "pdf": "application/pdf",
    "html": "text/html", "htm": "text/html", "js": "text/javascript", "mjs": "text/javascript", "ts": "text/javascript", "css": "text/css", "json": "application/json",
    "map": "application/json", "svg": "image/svg+xml", "woff": "font/woff", "woff2": "font/woff2", "ico": "image/x-icon", "wasm": "application/wasm",
    "lrc": "text/plain", "txt": "text/plain", "md": "text/plain",
}
CODEC = {"mpc": "musepack", "flac": "flac", "wav": "wav", "ogg": "vorbis"}
COUNTRY = {"XE": "Europe", "XW": "Worldwide", "XN": "Northern Europe", "US": "United States", "UK": "United Kingdom", "GB": "United Kingdom", "DE": "Germany", "FR": "France", "JP": "Japan", "NL": "Netherlands"}
CODEC_LABEL = {"musepack-sv8": "MPC", "musepack-sv7": "MPC", "musepack": "MPC", "flac": "FLAC", "wav": "WAV", "aiff": "AIFF", "aif": "AIFF", "mp3": "MP3", "aac": "AAC", "m4a": "AAC", "ogg": "OGG", "vorbis": "OGG", "opus": "Opus"}
MEDIUM = (("Vinyl", ("vinyl", "lp")), ("SACD", ("sacd",)), ("DVD", ("dvd",)), ("Blu-ray", ("blu-ray", "blu ray")), ("CD", ("cd",)), ("Digital", ("digital", "download")))


def lookup(c: Column, table: dict[str, str], default: Column) -> Column:
    """``table[c]``, or ``default``."""
    entries = F.create_map(*(F.lit(x) for kv in table.items() for x in kv))
    return F.coalesce(F.try_element_at(entries, F.coalesce(c, F.lit(""))), default)


def mime_for_path(c: Column, more: dict[str, str] | None = None) -> Column:
    """The media type by extension (its case counts); ``more`` adds a vendor's own types."""
    return lookup(extension(c), MIME | (more or {}), F.lit("application/octet-stream"))


def codec_for_path(c: Column) -> Column:
    return lookup(extension(c), CODEC, F.lit("unknown"))


def valid_mbid(c: Column) -> Column:
    """36 characters, hex digits in either case with dashes after 8, 12, 16 and 20 of them."""
    return F.coalesce(c.rlike(r"\A[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}\z"), F.lit(False))


def anchor(c: Column) -> Column:
    """An identifier that can anchor an identity: set and valid; else null."""
    return F.when(valid_mbid(c), c)


def path_fault(c: Column, most_bytes: int = 4096) -> Column:
    """Why a package-relative path is refused: the fault met first from the left; null for a good path."""
    # each fault with the place at which it shows; a segment's fault shows at the slash that ends it
    def at(pattern: str) -> Column:
        return F.regexp_instr(c, F.lit(pattern))

    def ends(segment: str) -> Column:
        hit = F.regexp_extract(c, f"^(?:.*?/)?{segment}/", 0)
        return F.length(hit)

    n = F.length(c)
    tail = F.regexp_extract(c, r"([^/]*)$", 1)
    found = [
        ("backslash", at(r"\\")), ("colon", at(":")), ("control", at(r"[\x00-\x1f\x7f]")), ("absolute", F.when(c.startswith("/"), F.lit(1)).otherwise(F.lit(0))),
        ("empty segment", F.when(F.instr(c, "//") > 0, F.instr(c, "//") + 1).otherwise(F.lit(0))), ("dot segment", ends(r"\.")), ("parent segment", ends(r"\.\.")),
        ("trailing separator", F.when(tail == "", n + 1).otherwise(F.lit(0))), ("dot segment", F.when(tail == ".", n + 1).otherwise(F.lit(0))), ("parent segment", F.when(tail == "..", n + 1).otherwise(F.lit(0))),
    ]
    first = F.array_min(F.array_compact(F.array(*(F.when(p > 0, F.struct(p.cast("int").alias("at"), F.lit(k).alias("k"), F.lit(name).alias("name"))) for k, (name, p) in enumerate(found)))))
    return F.when(c.isNull(), None).when(n == 0, F.lit("empty")).when(F.octet_length(c) > most_bytes, F.lit("too long")).otherwise(first["name"])


def profile_slug(c: Column) -> Column:
    """Letters, digits and ``-_.`` stay, all else becomes ``_``; an empty text becomes ``profile``."""
    return F.when(c == "", F.lit("profile")).otherwise(F.regexp_replace(c, r"[^A-Za-z0-9\-_.]", "_"))


def sanitize_component(c: Column) -> Column:
    return F.regexp_replace(c, r"[/\\:]", "-")


def fmt_time(seconds: Column) -> Column:
    """``m:ss``, from an hour on ``h:mm:ss``; ``0:00`` for what is no time."""
    s = F.floor(seconds)
    h, m, r = F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60
    good = seconds.isNotNull() & ~F.isnan(seconds) & (seconds >= 0) & (seconds < float("inf"))
    return F.when(~F.coalesce(good, F.lit(False)), F.lit("0:00")).when(h > 0, F.format_string("%d:%02d:%02d", h, m, r)).otherwise(F.format_string("%d:%02d", m, r))


def year_of(date: Column) -> Column:
    return F.substring(F.coalesce(date, F.lit("")), 1, 4)


def format_date(date: Column) -> Column:
    """``1986-06-16`` as ``16 Jun 1986``, ``1986-06`` and ``1986`` (as January) as month and year; empty for null."""
    parts = F.split(date, "-")
    y, m, d = F.get(parts, F.lit(0)), F.get(parts, F.lit(1)).try_cast("int"), F.get(parts, F.lit(2))
    names = F.array(*(F.lit(x) for x in "Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split()))
    month = F.coalesce(F.try_element_at(names, F.when(m.between(1, 12), m).otherwise(F.lit(1))), F.lit("Jan"))
    day = F.when(F.coalesce(d, F.lit("")) != "", F.concat(F.coalesce(d.try_cast("int").cast("string"), F.lit("NaN")), F.lit(" "))).otherwise(F.lit(""))
    return F.when(F.coalesce(date, F.lit("")) == "", F.lit("")).when(y == "", date).otherwise(F.concat(day, month, F.lit(" "), y))


def country_name(code: Column) -> Column:
    return F.when(F.coalesce(code, F.lit("")) == "", F.lit("")).otherwise(lookup(code, COUNTRY, code))


def medium_label(fmt: Column) -> Column:
    low = F.lower(fmt)
    out = F.when(F.coalesce(fmt, F.lit("")) == "", F.lit("Digital"))
    for label, words in MEDIUM:
        out = out.when(reduce(lambda a, b: a | b, (F.contains(low, F.lit(w)) for w in words)), F.lit(label))
    return out.otherwise(fmt)


def codec_label(codec: Column) -> Column:
    return F.when(F.coalesce(codec, F.lit("")) == "", F.lit("")).otherwise(lookup(F.lower(codec), CODEC_LABEL, F.upper(codec)))


def is_musepack(codec: Column) -> Column:
    return F.lower(codec).isin("musepack", "musepack-sv7", "musepack-sv8")


def codec_name(codec: Column) -> Column:
    return F.when(is_musepack(codec), F.lit("Musepack")).otherwise(codec_label(codec))


def collector_line(year: Column, media: Column, releases: Column) -> Column:
    """Year, media labels and number of versions, joined; what is missing is left out."""
    labels = F.array_join(F.transform(media, medium_label), "/")
    return F.concat_ws(" · ", F.when(year != "", year), F.when(F.size(media) > 0, labels), F.when(releases > 1, F.concat(releases.cast("string"), F.lit(" versions"))))


def _short(x: Column, digits: int) -> Column:
    """A number rounded half up, without trailing zeros."""
    return F.regexp_replace(F.format_string(f"%.{digits}f", F.floor(x * 10**digits + 0.5) / 10**digits), r"\.?0+$", "") if digits else F.floor(x + 0.5).cast("string")


def format_bytes(n: Column) -> Column:
    """``412 kB``, ``38.4 MB``, ``1.2 GB``; empty for null and sizes below 1."""
    kb, mb, gb = n / 1024.0, n / 1048576.0, n / 1073741824.0
    return (
        F.when(n.isNull() | (n <= 0), F.lit("")).when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(kb < 1024, F.concat(_short(kb, 0), F.lit(" kB")))
        .when(mb >= 1024, F.concat(_short(gb, 2), F.lit(" GB"))).when(mb >= 100, F.concat(_short(mb, 0), F.lit(" MB"))).otherwise(F.concat(_short(mb, 1), F.lit(" MB")))
    )


def quality_line(codec: Column, sample_rate: Column, channels: Column, label: Column) -> Column:
    """Label or codec, then rate and channels where the codec has them."""
    base = F.when(F.coalesce(F.trim(label), F.lit("")) != "", F.trim(label)).otherwise(codec_label(codec))
    rated = F.coalesce((sample_rate > 0) & (codec != "") & ~is_musepack(codec), F.lit(False))
    khz = F.concat(_short(sample_rate / 1000.0, 4), F.lit(" kHz"))
    many = F.when(channels == 2, F.lit("stereo")).when(channels > 2, F.concat(channels.cast("string"), F.lit(" ch")))
    return F.when(base == "", F.lit("")).otherwise(F.concat_ws(" · ", base, F.when(rated, khz), F.when(rated, many)))


def relation(artist_a: Column, album_a: Column, artist_b: Column, album_b: Column) -> Column:
    """How two tracks are related by their artist and album."""
    return F.when((artist_a == artist_b) & (album_a == album_b), F.lit("same_album")).when(artist_a == artist_b, F.lit("same_artist")).otherwise(F.lit("different_artist"))


def track_spec(path: Column) -> Column:
    """``artist, album, title`` from the last three parts of a path."""
    parts = F.split(path, "/")
    back = lambda k: F.try_element_at(parts, F.lit(-k))
    return F.struct(F.coalesce(back(3), F.lit("")).alias("artist"), F.coalesce(back(2), F.lit("")).alias("album"), F.regexp_replace(back(1), r"(?<=.)\.[^.]*$", "").alias("title"))


# ---- byte ranges ----


def parse_range(header: Column, size: Column) -> Column:
    """``kind, first, last`` of a single byte range against a known size: ``none`` (no usable header: the whole), ``range`` (clamped
    to the size) or ``unsatisfiable``."""
    body = F.regexp_extract(header, r"^bytes=([0-9]*-[0-9]*)$", 1)
    a, b = F.regexp_extract(body, r"^([0-9]*)-", 1), F.regexp_extract(body, r"-([0-9]*)$", 1)
    big = (F.length(a) > 18) | (F.length(b) > 18)
    x, y = F.when(a != "", a).try_cast("bigint"), F.when(b != "", b).try_cast("bigint")
    none = header.isNull() | (body == "") | (body == "-") | big | (y < x)
    kind = F.when(F.coalesce(none, F.lit(False)), F.lit("none")).when(x.isNull() & ((y == 0) | (size == 0)), F.lit("unsatisfiable")).when(x >= size, F.lit("unsatisfiable")).otherwise(F.lit("range"))
    first = F.when(x.isNull(), F.greatest(F.lit(0), size - y)).otherwise(x)
    last = F.when(x.isNull() | y.isNull(), size - 1).otherwise(F.least(y, size - 1))
    return F.struct(kind.alias("kind"), F.when(kind == "range", first).alias("first"), F.when(kind == "range", last).alias("last"))


# ---- lyrics ----


def timestamp_shaped(c: Column) -> Column:
    return c.rlike(r"^[0-9+\-]") & F.contains(c, F.lit(":"))


def parse_timestamp(c: Column) -> Column:
    """``mm:ss``, ``mm:ss.xx`` or ``mm:ss.xxx`` in milliseconds; null for anything else."""
    p = r"\A([0-9]+):([0-5][0-9])(?:\.([0-9]{2,3}))?\z"
    mm, ss, ff = (F.regexp_extract(c, p, k) for k in (1, 2, 3))
    minutes = F.when(F.length(F.regexp_replace(mm, "^0+", "")) <= 13, mm.try_cast("bigint"))
    frac = F.when(F.length(ff) == 2, ff.try_cast("bigint") * 10).when(F.length(ff) == 3, ff.try_cast("bigint")).otherwise(F.lit(0))
    return F.when(c.rlike(p), (minutes * 60 + ss.try_cast("bigint")) * 1000 + frac)


def parse_offset(c: Column, most: int = 3_600_000) -> Column:
    """A signed number of milliseconds up to an hour; null for anything else."""
    v = F.when(c.rlike(r"\A[+-]?[0-9]{1,18}\z"), F.regexp_replace(c, r"^\+", "").try_cast("bigint"))
    return F.when(F.abs(v) <= most, v)


def strip_word_tags(c: Column) -> Column:
    """A line without its ``<mm:ss>`` tags; other angle brackets stay."""
    return F.regexp_replace(c, r"<[0-9+\-][^>:]*:[^>]*>", "")


def leading_tokens(c: Column) -> Column:
    """The bracketed tokens a line begins with."""
    head = F.regexp_extract(F.regexp_replace(c, r"^[ \t\r\n\f]+", ""), r"^((?:\[[^\]]*\])*)", 1)
    return F.regexp_extract_all(head, F.lit(r"\[([^\]]*)\]"), F.lit(1))


def within_track_ms(album_seconds: Column, start: Column, end: Column) -> Column:
    """A place in an album in milliseconds of the track that lasts from ``start`` to ``end``, held inside it."""
    return F.floor(F.greatest(F.lit(0.0), F.least(album_seconds, end) - start) * 1000).cast("bigint")


def item_id(track: Column, representation: Column) -> Column:
    """``t1`` for a track, ``t1r2`` for one of its representations."""
    return F.concat(F.lit("t"), track.cast("string"), F.when(representation.isNotNull(), F.concat(F.lit("r"), representation.cast("string"))).otherwise(F.lit("")))


def page_number(text: Column, default: int, least: int, most: int) -> Column:
    """A number asked for in a request, brought between bounds: the default where none is given, null for anything but 1 to 18
    digits. Numbers beyond 32 bits are bounded like all others."""
    n = F.when(text.rlike(r"^[0-9]{1,18}$"), text.cast("bigint"))
    return F.when(text.isNull(), F.lit(default).cast("bigint")).otherwise(F.when(n.isNotNull(), F.greatest(F.lit(least).cast("bigint"), F.least(F.lit(most).cast("bigint"), n))))


def timeline(position: Column, duration: Column, start: Column) -> Column:
    """``within, fill``: the place inside a track of a position in the whole, and its share of the length in percent."""
    within = F.greatest(F.lit(0.0), F.least(duration, position - start))
    fill = F.when(duration > 0, F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.try_divide(within, duration) * 100))).otherwise(F.lit(0.0))
    return F.struct(within.alias("within"), fill.alias("fill"))


def peak_height(value: Column, height: int) -> Column:
    """A peak from 0 to 255, its fraction cut off, as a height in whole units; 0 where there is no height."""
    v = F.greatest(F.lit(0), F.least(F.lit(255), F.when(value < 0, F.ceil(value)).otherwise(F.floor(value))))
    return F.floor(v / 255.0 * max(height, 0) + 0.5).cast("bigint")


def preference(raw: Column) -> Column:
    """``mode, id, codec`` of a stored preference; null for one that isn't whole: an object with the mode default or lossless,
    representation with a number, or codec with a text that isn't blank."""
    s = F.from_json(raw, "mode string, id string, codec string")
    number = raw.rlike(r'"id"\s*:\s*-?[0-9]')
    good = s["mode"].isin("default", "lossless") | (s["mode"] == "representation") & number | (s["mode"] == "codec") & raw.rlike(r'"codec"\s*:\s*"') & (F.trim(s["codec"]) != "")
    return F.when(raw.startswith("{") & good, F.struct(s["mode"].alias("mode"), F.when(s["mode"] == "representation", s["id"].cast("double")).alias("id"), F.when(s["mode"] == "codec", s["codec"]).alias("codec")))
