import numpy as np
import pytest
from pyspark.sql import functions as F

from carillon.functions import documents as D
from carillon.operators import assets as A
from carillon.operators import kernels as K


def _sine(hz, seconds, rate, level=1.0):
    return (level * np.sin(2 * np.pi * hz * np.arange(int(seconds * rate)) / rate))[:, None]


def test_loudness_of_a_standard_tone():
    lufs, peak = K.loudness_of(_sine(997, 3, 48_000), 48_000)
    assert lufs == pytest.approx(-3.01, abs=0.05) and peak == pytest.approx(0, abs=0.1)
    both = np.repeat(_sine(997, 3, 48_000, 10 ** (-20 / 20)), 2, axis=1)
    assert K.loudness_of(both, 48_000)[0] == pytest.approx(-20.0, abs=0.05)


def test_silence_and_short():
    assert K.loudness_of(np.zeros((88_200, 2)), 44_100) == (-70.0, -70.0)
    assert K.loudness_of(np.zeros((10, 1)), 44_100) == (-70.0, -70.0)
    assert K.loudness_of(np.zeros((0, 1)), 44_100) == (-70.0, -70.0)


def test_album_is_not_the_mean_of_its_tracks():
    a, b = _sine(997, 3, 8000, 0.5), _sine(997, 3, 8000, 0.05)
    la, lb, both = (K.loudness_of(x, 8000)[0] for x in (a, b, np.concatenate([a, b])))
    assert abs(both - (la + lb) / 2) > 3


def test_block_filter_equals_the_recursion():
    rng = np.random.default_rng(0)
    x = rng.standard_normal(5000)
    y = x
    for b, a in K.k_weighting(8000):
        out = np.zeros(len(y))
        for n in range(len(y)):
            out[n] = sum(b[k] * (y[n - k] if n >= k else 0) for k in range(3)) - sum(a[k] * (out[n - k] if n >= k else 0) for k in (1, 2))
        y = out
    assert np.allclose(K.filtered(x[:, None], 8000)[:, 0], y, atol=1e-9)


def test_true_peak_between_samples():
    x = np.sin(2 * np.pi * 0.25 * np.arange(4000) + np.pi / 4)[:, None]
    assert np.abs(x).max() < 0.71 and K.true_peak(x, 44_100) == pytest.approx(1.0, abs=0.02)
    assert K.true_peak(x, 192_000) == np.abs(x).max()


def test_mel():
    f = K.mel_filters(96, 257, 8000.0)
    assert f.shape == (96, 257) and (f >= 0).all() and f[50].max() > 0
    m = K.mel_frames(_sine(1000, 1, 16_000)[:, 0], 16_000)
    assert m.shape == (61, 96) and abs(int(m[30].argmax()) - int(f[:, 32].argmax())) <= 1
    assert K.mel_frames(np.zeros(100), 16_000).shape == (0, 96)


def test_kernels_in_spark(spark):
    df = spark.range(16_000).select(F.lit("t").alias("track"), F.floor(F.col("id") / 2).alias("frame"), (F.col("id") % 2).alias("channel"), F.sin(F.floor(F.col("id") / 2) * 0.5).alias("sample"))
    a, b = (K.loudness(df.repartition(n), "track", 8000).first() for n in (1, 5))
    assert a == b and a.peak_db == pytest.approx(0, abs=0.1)
    p = K.mel_patches(df, "track", 8000, frames=10, stride=5, bands=16).collect()
    assert [r.patch for r in p] == list(range(len(p))) and all(len(r["values"]) == 160 for r in p) and len(p) == 1 + ((8000 - 512) // 256 + 1 - 10) // 5


def test_streams_and_shuffles():
    import hashlib

    s = K.ByteStream("x")
    assert s.take(40) == hashlib.sha256(b"x" + bytes(8)).digest() + hashlib.sha256(b"x" + bytes(7) + b"\1").digest()[:8]
    assert 0 <= K.ByteStream("y").unit() < 1
    assert sorted(K.shuffled(20, "a")) == list(range(20)) and K.shuffled(20, "a") == K.shuffled(20, "a") != K.shuffled(20, "b")


def test_json_numbers_and_documents(spark):
    assert [D.json_number(x) for x in (1.0, -0.0, 1.5, 0.1234567891, 1e20, 9.2e18)] == ["1", "0", "1.5", "0.12345679", "1e+20", "9200000000000000000"]
    for text, fault in ((None, "null"), ('{"a":1,"a":2}', "duplicate_key"), ('{"a":{"b":1,"b":1}}', "duplicate_key"), ("{", "invalid"), ("", "invalid"), ("[" * 3000 + "]" * 3000, "too_deep"), ("{} x", "invalid")):
        assert D.read_strict(text) == (None, fault)
    a = '{"album": {"genres": null, "artists": [{"role": "r", "name": "n"}], "title": "t"}, "x": 1.0, "version": 1, "format": "f"}'
    b = '﻿{"format":"f","version":1,"album":{"title":"t","artists":[{"name":"n","role":"r"}]},"x":1}'
    df = spark.createDataFrame([(1, a), (2, b), (3, None), (4, "{")], "k int, m string")
    got = [tuple(r) for r in df.select("k", D.canonical_json(F.col("m"))["text"], D.canonical_json(F.col("m"))["fault"]).orderBy("k").collect()]
    assert got[0][1] == got[1][1] == '{\n  "format": "f",\n  "version": 1,\n  "album": {\n    "title": "t",\n    "artists": [\n      {\n        "name": "n",\n        "role": "r"\n      }\n    ]\n  },\n  "x": 1\n}\n'
    assert got[2][1:] == (None, "null") and got[3][1:] == (None, "invalid")
    assert df.select(D.package_fingerprint(F.col("m")).alias("f")).distinct().count() == 2


def test_snapshots(spark):
    df = spark.createDataFrame([(1, '{"version":1,"items":["a","b"],"index":9,"position":-3,"repeat":"x"}'), (2, '{"version":2,"items":[]}'), (3, "junk"), (4, None), (5, '{"version":1,"items":[],"index":3}')], "k int, s string")
    got = [r.x and tuple(r.x) for r in df.select("k", D.snapshot(F.col("s")).alias("x")).orderBy("k").collect()]
    assert got == [(["a", "b"], 1, 0.0, "off"), None, None, None, ([], -1, 0.0, "off")]


def test_assets(spark):
    body = '{"media":[{"tracks":[{"audio":{"path":"a1"},"representations":[{"path":"r1"},{"path":""}],"waveform":{"path":"w1"}},{"audio":{"path":"a2"},"lyrics":[{"path":"l2"}]}]}],"artwork":[{"path":"c"}],"booklet":{"path":"b"}}'
    df = spark.createDataFrame([(1, body), (2, "{")], "manifest_id bigint, manifest string")
    assert [(r.ord, r.kind, r.path) for r in A.asset_rows(df).orderBy("ord").collect()] == [
        (0, "audio", "a1"), (1, "audio", "a2"), (2, "representation", "r1"), (3, "waveform", "w1"), (4, "track_lyrics", "l2"), (5, "artwork", "c"), (6, "booklet", "b")]


def test_neighbour_keys(spark):
    near = spark.createDataFrame([(0, "p"), (9, "p"), (9, "q"), (None, "p")], "index bigint, path string")
    got = A.neighbour_keys(near, spark.createDataFrame([(0, "K0")], "index bigint, key string"), spark.createDataFrame([("p", "KP")], "path string, key string"))
    assert sorted(r.key for r in got.collect()) == ["K0", "KP", "KP", "q"]
