import hashlib
import math

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from carillon.functions import audio as A
from carillon.functions import hashing as H
from carillon.functions import text as X
from carillon.functions import vector as V


def one(spark, values, f, kind="string"):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], T.StructType([T.StructField("k", T.IntegerType()), T.StructField("v", T._parse_datatype_string(kind) if isinstance(kind, str) else kind)]))
    return [r[0] for r in df.select(f(F.col("v")).alias("x"), "k").orderBy("k").select("x").collect()]


def test_escape_like(spark):
    assert one(spark, ["a%b_c\\d", "", None], lambda c: X.escape_like(c)) == ["a\\%b\\_c\\\\d", "", None]
    assert one(spark, ["abc", "abcd"], lambda c: X.escape_like(c, 5)) == ["abc", None]


def test_numbers_and_titles(spark):
    assert one(spark, ["3/12", "0", "x1", "007", "99999999999", "", None], X.leading_number) == [3, None, None, 7, None, None, None]
    assert one(spark, ["01 - Title", "1984", "12", "Title", "3._-x"], X.title_from_stem) == ["Title", "1984", "12", "Title", "x"]
    assert one(spark, ["CD1", "Disc-2", "disc 03", "cdx", "side"], X.disc_from_dirname) == [1, 2, 3, None, None]


def test_paths(spark):
    bad = {
        "": "empty", "/a": "absolute", "a\\b": "backslash", "a:b": "colon", "a\x01b": "control", "a//b": "empty segment", "a/./b": "dot segment", "../a": "parent segment", "a/": "trailing separator",
        "a/..": "parent segment", "a/.": "dot segment", ".": "dot segment", "x" * 4097: "too long", "a/../b:c": "parent segment", "a:/../b": "colon",
    }
    assert one(spark, [*bad, "a/b.c", "a/..b", "é/ü", None], X.path_fault) == [*bad.values(), None, None, None, None]


def test_display(spark):
    assert one(spark, [0.0, 59.9, 61.0, 3661.0, -1.0, float("nan"), float("inf"), None], X.fmt_time, "double") == ["0:00", "0:59", "1:01", "1:01:01", "0:00", "0:00", "0:00", "0:00"]
    assert one(spark, [None, 0, 512, 2048, 40_265_318, 209_715_200, 1_288_490_189], X.format_bytes, "bigint") == ["", "", "512 B", "2 kB", "38.4 MB", "200 MB", "1.2 GB"]
    assert one(spark, ["1986-06-16", "1986-06", "1986", "", None], X.format_date) == ["16 Jun 1986", "Jun 1986", "Jan 1986", "", ""]
    assert one(spark, ["musepack-sv8", "flac", "xyz", "", None], X.codec_label) == ["MPC", "FLAC", "XYZ", "", ""]
    assert one(spark, ['12" Vinyl', "SACD", "Blu-ray", "CD", "Tape", "", None], X.medium_label) == ["Vinyl", "SACD", "Blu-ray", "CD", "Tape", "Digital", "Digital"]
    assert one(spark, ["a b/c", "", "x-_."], X.profile_slug) == ["a_b_c", "profile", "x-_."]


def test_media_types(spark):
    assert one(spark, ["a/b.mpc", "x.JPG", "x.jpeg", "none", "w.wfm"], X.mime_for_path) == ["audio/musepack", "application/octet-stream", "image/jpeg", "application/octet-stream", "application/octet-stream"]
    assert one(spark, ["w.wfm"], lambda c: X.mime_for_path(c, {"wfm": "application/x-waveform"})) == ["application/x-waveform"]
    assert one(spark, ["a.flac", "a.ogg", "a.FLAC", None], X.codec_for_path) == ["flac", "vorbis", "unknown", "unknown"]


def test_collector_line(spark):
    df = spark.createDataFrame([("1986", ["CD", "LP"], 2), ("", [], 1), (None, None, None)], "y string, m array<string>, n int")
    assert [r[0] for r in df.select(X.collector_line(F.col("y"), F.col("m"), F.col("n"))).collect()] == ["1986 · CD/Vinyl · 2 versions", "", ""]


def test_ranges(spark):
    def f(c):
        r = X.parse_range(c, F.lit(100).cast("bigint"))
        return F.concat_ws(",", r["kind"], r["first"].cast("string"), r["last"].cast("string"))

    assert one(spark, ["bytes=0-9", "bytes=90-", "bytes=-10", "bytes=50-500", "bytes=100-", "bytes=-0", "bytes=9-1", "bytes=-", "x", None, "bytes=1-2,3-4"], f) == [
        "range,0,9", "range,90,99", "range,90,99", "range,50,99", "unsatisfiable", "unsatisfiable", "none", "none", "none", "none", "none"]


def test_lyric_scalars(spark):
    assert one(spark, ["1:02", "01:02.5", "01:02.25", "01:02.125", "1:60", "x", "100:00", ""], X.parse_timestamp) == [62_000, None, 62_250, 62_125, None, None, 6_000_000, None]
    assert one(spark, ["+10", "-10", "3600000", "3600001", "1.5", ""], X.parse_offset) == [10, -10, 3_600_000, None, None, None]
    assert one(spark, ["[00:01][Chorus]text [x]", "  [a:b]c", "none"], X.leading_tokens) == [["00:01", "Chorus"], ["a:b"], []]
    assert one(spark, ["a <00:01.2>b", "i <3 you"], X.strip_word_tags) == ["a b", "i <3 you"]


def test_mbid(spark):
    good = "cb9398e4-2b1e-c7d5-3de9-bcdb7b830826"
    assert one(spark, [good, good.upper(), good.replace("-", "_"), good + "0", good[:-1] + "g", None], X.valid_mbid) == [True, True, False, False, False, False]


def test_quantize(spark):
    got = one(spark, [0.0, 1.0, 1e-3, 10 ** (-6 / 20), 10 ** (-30 / 20), 2.0, float("nan"), -0.5, 1e-6], A.quantize_amplitude, "double")
    assert got == [0, 255, 1, 230, 128, 255, 0, 0, 1]


def test_gains(spark):
    df = spark.createDataFrame([(-10.0, -20.0), (-20.0, -0.5), (None, 0.0), (-20.0, None)], "l double, p double")
    assert [r[0] for r in df.select(A.normalization_gain(F.col("l"), F.col("p"))).collect()] == [-6.0, -0.5, 0.0, 4.0]
    assert one(spark, [float("nan"), float("inf"), float("-inf"), 0.5], A.sanitize_sample, "double") == [0.0, 1.0, -1.0, 0.5]
    assert one(spark, [-70.0, 6.0, 6.1, float("nan"), None], A.valid_loudness, "double") == [True, True, False, False, False]


def test_cosine(spark):
    rows = [([1.0, 0.0], [1.0, 1.0]), ([10.0, 0.0], [0.1, 0.1]), ([], []), ([1.0], [1.0, 2.0]), ([0.0, 0.0], [1.0, 1.0]), ([float("nan"), 1.0], [1.0, 1.0]), ([float("inf"), 1.0], [1.0, 1.0]), (None, [1.0])]
    got = [r[0] for r in spark.createDataFrame(rows, "a array<float>, b array<float>").select(V.cosine(F.col("a"), F.col("b"))).collect()]
    assert got[0] == pytest.approx(1 / math.sqrt(2)) and got[1] == pytest.approx(1 / math.sqrt(2)) and got[2:] == [None] * 6


def test_unit(spark):
    assert one(spark, [[3.0, 4.0], [0.0, 0.0]], V.unit, "array<float>") == [[0.6, 0.8], None]
    assert one(spark, [[0.0, 0.0]], V.unit_or_same, "array<float>") == [[0.0, 0.0]]


def test_keys(spark):
    def tlv(tag, s):
        return bytes([tag]) + len(s.encode()).to_bytes(4, "big") + s.encode()

    df = spark.createDataFrame([("Títle", "1986", None, [("b", "main"), ("a", None), ("a", "main")])], "t string, d string, k string, a array<struct<name:string,role:string>>")
    got = df.select(H.group_key(F.lit(None).cast("string"), F.col("t"), F.col("d"), F.col("k"), F.col("a"))).first()[0]
    want = tlv(1, "Títle") + tlv(2, "1986") + tlv(4, "a") + tlv(4, "a") + tlv(5, "main") + tlv(4, "b") + tlv(5, "main")
    assert got == "h:" + hashlib.sha256(want).hexdigest()
    none = F.lit(None).cast("string")
    assert df.select(H.release_key(none, none, none, none, none, none, none)).first()[0] == "h:" + hashlib.sha256(b"").hexdigest()
    assert df.select(H.release_key(none, F.lit(""), none, none, none, none, none)).first()[0] == "h:" + hashlib.sha256(tlv(6, "")).hexdigest()


def test_splits(spark):
    assert one(spark, ["a", "b"], lambda c: H.assign_split(c, 100, 0)) == ["train", "train"]
    assert one(spark, ["a", "b"], lambda c: H.assign_split(c, 0, 0)) == ["test", "test"]
    with pytest.raises(ValueError):
        H.assign_split(F.lit("a"), 70, 31)
    bits = one(spark, ["x"], lambda c: H.target_bits(c, 52))[0]
    assert bits == [int(b) for b in bin(int(hashlib.sha256(b"x").hexdigest(), 16))[2:].zfill(256)[:52]]
    u = one(spark, ["s"], lambda c: H.uniform(c, F.lit(3)))[0]
    assert u == int(hashlib.sha256(b"s:3").hexdigest()[:13], 16) / 2**52


def test_canonical_document_to_the_letter():
    from carillon.functions.documents import canonical, read_strict

    text = '{"x-more":[1,{"b":null}],"media":[{"title":null,"disc":1.0,"tracks":[{"artists":[],"title":"A \\"q\\" \\u0001\\\\","track":2,"duration":12.3456789012,"audio":{"sha256":"s","path":"p","other":1},"lyrics":[]}]}],"version":1,"album":{"genres":[],"artists":[{"sortName":"S","name":"N","musicbrainzId":"m"}],"title":"T"},"format":"f","identity":{"confidence":"c","source":"s"},"artwork":[]}'
    value, fault = read_strict(text)
    want = """{
  "format": "f",
  "version": 1,
  "album": {
    "title": "T",
    "artists": [
      {
        "musicbrainzId": "m",
        "name": "N",
        "sortName": "S"
      }
    ]
  },
  "identity": {
    "source": "s",
    "confidence": "c"
  },
  "media": [
    {
      "disc": 1,
      "tracks": [
        {
          "track": 2,
          "title": "A \\"q\\" \\u0001\\\\",
          "duration": 12.345679,
          "audio": {
            "path": "p",
            "sha256": "s"
          }
        }
      ]
    }
  ],
  "x-more": [
    1,
    {
      "b": null
    }
  ]
}
"""
    assert fault is None and canonical(value) == want
    assert canonical({"a": {}, "b": [], "c": -12.0, "d": 1e-5}) == '{\n  "a": {},\n  "b": [],\n  "c": -12,\n  "d": 1e-05\n}\n'
    again, _ = read_strict(want)
    assert canonical(again) == want
