import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from carillon.sources import container as K
from carillon.sources import lyrics as L
from carillon.sources import packages as P
from carillon.sources import reports as R
from carillon.sources import vectors as V
from carillon.sources import waves as W

FINGER = bytes(range(1, 33))


def _doc():
    return V.build(FINGER, 4, [(1, 1, "ok", [1, 0, 0, 0])])


def test_smallest_document():
    data = _doc()
    error, finger, members = V.parse(data)
    assert len(data) == 92 and error is None and finger == FINGER.hex()
    assert [(d, t, s, list(v)) for d, t, s, v in members] == [(1, 1, "ok", [1.0, 0.0, 0.0, 0.0])]


@pytest.mark.parametrize("at, new, code", [
    (slice(0, 4), b"MSIX", "magic_invalid"), (slice(5, 6), b"\x02", "unsupported_version"), (slice(7, 8), b"\x01", "unsupported_version"), (slice(43, 44), b"\x01", "reserved_nonzero"), (slice(50, 51), b"\x01", "reserved_nonzero"),
    (slice(8, 40), bytes(32), "zero_fingerprint"), (slice(40, 42), b"\0\0", "dimensions_zero"), (slice(40, 42), b"\x10\x01", "dimensions_too_large"), (slice(42, 43), b"\x09", "unsupported_encoding"),
    (slice(44, 48), bytes(4), "track_count_zero"), (slice(44, 48), b"\0\0\x40\x01", "track_count_too_large"), (slice(44, 48), b"\0\0\0\x09", "truncated_table"), (slice(73, 74), b"\x01", "reserved_nonzero"),
    (slice(64, 68), bytes(4), "invalid_member"), (slice(72, 73), b"\x04", "unknown_status"), (slice(76, 80), struct.pack("<f", float("nan")), "non_finite_vector"), (slice(92, 92), b"x", "trailing_bytes"), (slice(91, 92), b"", "truncated"), (slice(40, 92), b"", "truncated_header"),
])
def test_document_faults(at, new, code):
    data = bytearray(_doc())
    data[at] = new
    assert V.parse(bytes(data))[0] == code


def test_member_order_faults():
    two = bytearray(V.build(FINGER, 1, [(1, 1, "failed", None), (1, 2, "failed", None)]))
    two[64:76], two[76:88] = two[76:88], two[64:76]
    assert V.parse(bytes(two))[0] == "unsorted_table"
    two[64:76] = two[76:88]
    assert V.parse(bytes(two))[0] == "duplicate_member"


def test_documents_in_spark(spark):
    files = spark.createDataFrame([("a", _doc()), ("b", b"junk"), ("c", None)], "path string, content binary")
    got = {(r.path, r.error, r.disc, r.status) for r in V.read_documents(files).collect()}
    assert got == {("a", None, 1, "ok"), ("b", "truncated_header", None, None), ("c", "truncated_header", None, None)}


def _container():
    data = lambda path, body: K.block(b"DATA", struct.pack(">H", len(path)) + path + body)
    return b"MPAK\x01\0\0\0" + bytes(8) + data(b"a/1", b"xyz") + b"noise" + data(b"a/1", b"two") + data(b"../x", b"") + K.block(b"MANF", b"{}") + data(b"b", b"")


def test_container(spark):
    body = _container()
    error, rows = K.scan(body)
    assert error is None and [r[0] for r in rows] == ["member", "resync", "duplicate", "skipped", "manifest", "member"]
    kind, path, at, n = rows[0]
    assert body[at : at + n] == b"xyz"
    assert K.scan(b"nothing")[0] == "bad_magic" and K.scan(b"MPAK\x02" + bytes(20))[0] == "unsupported_version" and K.scan(None)[0] == "bad_magic"
    assert K.crc16(b"123456789") == 0xAEE7
    files = spark.createDataFrame([("p", body), ("q", b"")], "path string, content binary")
    assert {(r.path, r.kind, r.member) for r in K.read_containers(files).collect()} >= {("p", "member", "a/1"), ("q", None, None)}


def test_index():
    entry = lambda p: struct.pack(">H", len(p)) + p + struct.pack(">QQ", 1, 2) + bytes(32)
    good = struct.pack(">I", 2) + entry(b"a") + entry(b"b")
    assert [e[:3] for e in K.index_entries(good)] == [("a", 1, 2), ("b", 1, 2)]
    assert K.index_entries(struct.pack(">I", 2) + entry(b"b") + entry(b"a")) is None
    assert K.index_entries(struct.pack(">I", 2) + entry(b"a") + entry(b"a")) is None
    assert K.index_entries(good + b"x") is None and K.index_entries(good[:-1]) is None and K.index_entries(b"") is None


def _wav(bits, tag, body, channels=1, rate=8000):
    fmt = struct.pack("<HHIIHH", tag, channels, rate, rate * channels * bits // 8, channels * bits // 8, bits)
    return b"RIFF" + struct.pack("<I", 0) + b"WAVE" + b"fmt " + struct.pack("<I", 16) + fmt + b"LIST" + struct.pack("<I", 3) + b"abc\0" + b"data" + struct.pack("<I", len(body)) + body


def test_wav(spark):
    assert W.decode_wav(_wav(16, 1, struct.pack("<hhh", 0, 16384, -32768)))[2].ravel().tolist() == [0.0, 0.5, -1.0]
    assert W.decode_wav(_wav(8, 1, bytes([128, 192, 0])))[2].ravel().tolist() == [0.0, 0.5, -1.0]
    assert W.decode_wav(_wav(24, 1, b"\0\0\x40\0\0\x80"))[2].ravel().tolist() == [0.5, -1.0]
    assert W.decode_wav(_wav(32, 3, struct.pack("<ff", 0.25, -2)))[2].ravel().tolist() == [0.25, -2.0]
    assert W.decode_wav(_wav(16, 1, struct.pack("<hhh", 1, 2, 3), channels=2))[2].shape == (1, 2)
    assert W.decode_wav(b"RIFFxxxxWAVE") is None and W.decode_wav(_wav(12, 1, b"")) is None
    files = spark.createDataFrame([("a", _wav(16, 1, struct.pack("<hh", 0, 16384))), ("b", None), ("c", b"x")], "path string, content binary")
    assert [(r.path, r.frame, r.channel, r["sample"]) for r in W.wav_frames(files).orderBy("frame").collect()] == [("a", 0, 0, 0.0), ("a", 1, 0, 0.5)]


def test_half_precision(spark):
    df = spark.createDataFrame([([1.0, 0.1, 65504.0],), ([70000.0],), (None,)], "v array<float>")
    got = [r[0] for r in df.select(W.half_bits(F.col("v"))).collect()]
    assert got == [[0x3C00, int(np.float16(0.1).view("u2")), 0x7BFF], None, None]


def test_wfm(spark):
    df = spark.createDataFrame([("a", 1, 255, 0), ("a", 0, 7, 3)], "k string, bucket bigint, peak int, rms int")
    packed = W.encode_wfm(df, "k")
    assert bytes(packed.first().content) == bytes([7, 3, 255, 0])
    assert sorted((r.bucket, r.peak, r.rms) for r in W.decode_wfm(packed, "k").collect()) == [(0, 7, 3), (1, 255, 0)]
    assert W.decode_wfm(spark.createDataFrame([("a", b"abc"), ("b", b""), ("c", None)], "k string, content binary"), "k").count() == 0


def test_lyrics(spark):
    assert L.parse("a\n\nb") == (False, [(None, "a"), (None, ""), (None, "b")])
    text = "﻿[ti:x]\r\nintro\n [00:02.00][00:01.50]two <00:01>words\n[Chorus]\n[00:02.00]tie\nlast\n[offset:-500]"
    assert L.parse(text) == (True, [(1000, "intro\ntwo words"), (1500, "intro\ntwo words"), (1500, "tie\nlast")])
    for bad, code in (("[1:2]x", "malformed_timestamp"), ("[00:01]x\n[offset:9999999]", "malformed_offset"), ("[00:00]x\n[offset:-1]", "negative_timestamp"), ("x" * 5000, "line_too_long")):
        with pytest.raises(L.Fault, match=code):
            L.parse(bad)
    docs = spark.createDataFrame([(1, "[00:01]a"), (2, "[1:2]"), (3, None), (4, "")], "doc_id bigint, text string")
    assert {(r.doc_id, r.error, r.seq, r.ts_ms, r.text) for r in L.read_lyrics(docs).collect()} == {(1, None, 0, 1000, "a"), (2, "malformed_timestamp", None, None, None)}


def test_packages(spark, tmp_path):
    (tmp_path / "a" / "b.mpack").mkdir(parents=True)
    good = json.dumps({"media": [{"disc": 1, "tracks": []}]})
    (tmp_path / "a" / "b.mpack" / "manifest.json").write_text(good)
    (tmp_path / "a" / "x.manifest.json").write_text("{")
    (tmp_path / "a" / "y.FLAC").write_bytes(b"1")
    files = P.list_files(spark, str(tmp_path))
    assert {r.ext: r.n for r in P.count_by_extension(files).collect()} == {"json": 2, "flac": 1}
    assert P.over_limits(files).count() == 0
    assert sorted((r.path.rsplit("/", 1)[1], r.valid) for r in P.read_manifests(spark, str(tmp_path)).collect()) == [("manifest.json", True), ("x.manifest.json", False)]


def test_reports(spark, tmp_path):
    df = spark.createDataFrame([("a,b", 'q"t', 1), ("plain", None, 2)], "x string, y string, n int")
    assert [r.line for r in R.csv_lines(df).collect()] == ['"a,b","q""t",1', "plain,,2"]
    for kind in ("csv", "json", "parquet"):
        R.write_report(df, str(tmp_path / kind), kind)
    assert spark.read.csv(str(tmp_path / "csv"), header=True, escape='"').count() == 2
    run = {"tracks": [{"path": "p", "vector": [1.0, 2.0]}], "neighbors": [{"query": 0, "items": [{"index": 0, "path": "p", "score": 0.5}]}]}
    (tmp_path / "run.json").write_text(json.dumps(run))
    tracks, near = R.read_run(spark, str(tmp_path / "run.json"))
    assert tracks.first()[:] == (0, "p", [1.0, 2.0]) and near.first()[:] == (0, 1, 0, "p", 0.5)


def test_packed_container_is_read_back():
    members = [("b/2", b"two"), ("a/1", b"one" * 1000), ("c", b"")]
    data = K.pack(members, b'{"media":[]}')
    error, rows = K.scan(data)
    assert error is None and [r[0] for r in rows] == ["manifest", "member", "member", "member", "index", "tail"]
    found = {path: data[at : at + n] for kind, path, at, n in rows if kind == "member"}
    assert found == dict(members)
    at, n = next((r[2], r[3]) for r in rows if r[0] == "index")
    entries = K.index_entries(data[at : at + n])
    assert [e[0] for e in entries] == ["a/1", "b/2", "c"] and all(data[o : o + k] == found[p] for p, o, k, _ in entries)
    at, n = next((r[2], r[3]) for r in rows if r[0] == "tail")
    size, count, _ = struct.unpack_from(">QIQ", data, at)
    assert (size, count, n) == (len(data), 3, K.TAIL)
    for bad in ([("a", b""), ("a", b"")], [("../a", b"")]):
        with pytest.raises(ValueError):
            K.pack(bad)
