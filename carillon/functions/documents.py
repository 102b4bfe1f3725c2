"""JSON documents: strict reading, canonical writing, numbers as text."""

from __future__ import annotations

import json
import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def json_number(v: float) -> str:
    """Whole numbers within 9.2e18 without a point, others with eight significant digits."""
    if math.isfinite(v) and v == math.floor(v) and abs(v) <= 9.2e18:
        return str(int(v))
    return "%.8g" % v


class Duplicate(ValueError):
    """A key stands twice in one object."""


def _once(pairs: list[tuple]) -> dict:
    out = dict(pairs)
    if len(out) < len(pairs):
        raise Duplicate
    return out


def read_strict(text: str | None, depth: int = 1000):
    """``value, fault``: a whole document without a key twice in one object; faults: null, duplicate_key, too_deep, invalid."""
    if text is None:
        return None, "null"

    def deep(v, left: int) -> bool:
        return left > 0 and all(deep(x, left - 1) for x in (v.values() if isinstance(v, dict) else v if isinstance(v, list) else ()))

    try:
        v = json.loads(text.removeprefix("﻿").strip(" \t\r\n"), object_pairs_hook=_once)
        return (v, None) if deep(v, depth) else (None, "too_deep")
    except Duplicate:
        return None, "duplicate_key"
    except RecursionError:
        return None, "too_deep"
    except ValueError:
        return None, "invalid"


# The members of a canonical document in their order, by the path of their object, lists left out.
ORDER = {
    "": "format version album release identifiers identity source media artwork booklet lyrics extras analysis loudness provenance".split(),
    "album": "title artists releaseType originalReleaseDate genres".split(),
    "album.artists": "musicbrainzId name role sortName".split(),
    "release": "releaseDate edition country label catalogueNumber notes".split(),
    "identifiers": "musicbrainzReleaseGroupId musicbrainzReleaseId barcode".split(),
    "identity": "source confidence".split(),
    "source": "type store sourceId".split(),
    "media": "disc format title tracks".split(),
    "media.tracks": "track title artists identifiers source sourceAudio duration loudness audio waveform lyrics representations".split(),
    "media.tracks.artists": "musicbrainzId name role sortName".split(),
    "media.tracks.identifiers": "isrc musicbrainzTrackId musicbrainzRecordingId".split(),
    "media.tracks.source": "store trackId".split(),
    "media.tracks.sourceAudio": "codec md5".split(),
    "media.tracks.loudness": "trackLUFS truePeakDbTP".split(),
    "media.tracks.audio": "path sha256 codec".split(),
    "media.tracks.waveform": "version path sha256 intervalMs encoding floorDb points".split(),
    "media.tracks.lyrics": "path sha256 lang".split(),
    "media.tracks.representations": "path sha256 label codec".split(),
    "artwork": "role path sha256".split(),
    "booklet": "path sha256".split(),
    "lyrics": "path sha256".split(),
    "extras": "path sha256".split(),
    "analysis": "type profile path sha256".split(),
    "loudness": "algorithm albumLUFS albumTruePeakDbTP".split(),
    "provenance": "tool toolVersion".split(),
}
#: Lists that are left out where they are empty.
UNLESS_EMPTY = {"album.genres", "media.tracks.artists", "media.tracks.lyrics", "media.tracks.representations", "artwork", "booklet", "lyrics", "extras", "analysis"}


def ordered(value, path: str = ""):
    """The document with its members in their order: null ones and empty optional lists left out; unknown ones are kept, last and
    as they are, in the document itself and dropped in the objects that the format describes."""
    if isinstance(value, list):
        return [ordered(v, path) for v in value]
    if not isinstance(value, dict) or path not in ORDER:
        return value
    out = {}
    for k in ORDER[path]:
        v, at = value.get(k), f"{path}.{k}".lstrip(".")
        if v is not None and not (v == [] and at in UNLESS_EMPTY):
            out[k] = ordered(v, at)
    return out if path else out | {k: v for k, v in value.items() if k not in ORDER[""]}


def _text(v: str) -> str:
    return '"' + "".join("\\" + c if c in '"\\' else f"\\u{ord(c):04x}" if c < " " else c for c in v) + '"'


def written(value, depth: int = 0) -> str:
    """JSON with two blanks a level, empty containers in one line."""
    pad, end = "  " * (depth + 1), "  " * depth
    if isinstance(value, dict):
        inner = ",\n".join(f"{pad}{_text(k)}: {written(v, depth + 1)}" for k, v in value.items())
        return f"{{\n{inner}\n{end}}}" if value else "{}"
    if isinstance(value, list):
        inner = ",\n".join(pad + written(v, depth + 1) for v in value)
        return f"[\n{inner}\n{end}]" if value else "[]"
    if isinstance(value, str):
        return _text(value)
    if value is None or isinstance(value, bool):
        return json.dumps(value)
    return json_number(float(value))


def canonical(value) -> str:
    """One text for a document, whatever its layout and the order of its members."""
    return written(ordered(value)) + "\n"


CANONICAL_TYPE = T.StructType([T.StructField("text", T.StringType()), T.StructField("fault", T.StringType())])


def canonical_json(c: Column) -> Column:
    """``text, fault``: the canonical text of a document, or why it has none."""

    @F.pandas_udf(CANONICAL_TYPE)
    def run(s: pd.Series) -> pd.DataFrame:
        got = [read_strict(x) for x in s]
        return pd.DataFrame({"text": [None if f else canonical(v) for v, f in got], "fault": [f for _, f in got]})

    return run(c)


def package_fingerprint(c: Column) -> Column:
    """The digest of a manifest's canonical text; null if it has none."""
    return F.sha2(canonical_json(c)["text"], 256)


def number_text(c: Column) -> Column:
    """A number as canonical documents write it."""

    @F.pandas_udf(T.StringType())
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda v: None if v is None or v != v and pd.isna(v) else json_number(float(v)))

    return run(c.cast("double"))


def snapshot(c: Column, version: int = 1) -> Column:
    """A stored session snapshot as a struct; null for one that can't be read or has another version."""
    s = F.from_json(c, "version int, items array<string>, `index` int, position double, repeat string")
    good = (s["version"] == version) & s["items"].isNotNull()
    fit = F.greatest(F.lit(-1), F.least(F.coalesce(s["index"], F.lit(-1)), F.size(s["items"]) - 1))
    return F.when(good, F.struct(s["items"].alias("items"), fit.alias("index"), F.greatest(F.lit(0.0), F.coalesce(s["position"], F.lit(0.0))).alias("position"), F.when(s["repeat"].isin("off", "one", "all"), s["repeat"]).otherwise(F.lit("off")).alias("repeat")))
