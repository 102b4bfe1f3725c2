import json
import random

import pytest
from pyspark.sql import functions as F

from carillon.operators.flatten import MANIFEST_GROUPS, WRAPPERS, Group, Unreadable, events, flatten, flatten_manifests, grouped, manifest_records, repeated, table, triples


def _doc(media, **more):
    return json.dumps({"format": "x", "media": media, **more})


def _records(spark, rows):
    df = spark.createDataFrame(rows, "manifest_id bigint, manifest string")
    return sorted(tuple(r) for r in manifest_records(flatten_manifests(df)).collect())


def test_positions_count_skipped_items(spark):
    body = _doc([None, {"disc": 9, "tracks": [{"title": "a", "artists": [None, {"name": "X"}, {"name": " "}, "Y"], "identifiers": {"isrc": ["", "I2"]}}, None, {"title": "b"}]}])
    assert _records(spark, [(1, body)]) == sorted([
        (1, 2, 0, "medium", 0), (1, 2, 1, "track", 0), (1, 2, 1, "artist", 2), (1, 2, 1, "artist", 4), (1, 2, 1, "isrc", 2), (1, 2, 3, "track", 0),
    ])


def test_other_shapes(spark):
    one = _doc({"disc": 1, "tracks": {"title": "t", "artists": "A", "identifiers": {"isrc": "I"}, "waveform": {"path": "p"}}})
    keyed = _doc([{"tracks": {"1": {"title": "a"}, "2": {"title": "b", "waveform": [{"path": ""}, {"path": "q"}]}}}])
    wrapped = json.dumps({"exported": 1, "manifest": json.loads(_doc([{"tracks": []}]))})
    assert _records(spark, [(1, one), (2, keyed), (3, "﻿" + wrapped)]) == sorted([
        (1, 1, 0, "medium", 0), (1, 1, 1, "track", 0), (1, 1, 1, "artist", 1), (1, 1, 1, "isrc", 1), (1, 1, 1, "waveform", 1),
        (2, 1, 0, "medium", 0), (2, 1, 1, "track", 0), (2, 1, 2, "track", 0), (2, 1, 2, "waveform", 2), (3, 1, 0, "medium", 0),
    ])


def test_unreadable_and_empty(spark):
    rows = [(1, None), (2, ""), (3, "  "), (4, '{"media":[{'), (5, "[1]"), (6, '{"media":[]} x'), (7, "{}"), (8, '{"media":null}')]
    assert _records(spark, rows) == []
    assert _records(spark, []) == []


def test_repeats_long_and_clashing_columns(spark):
    body = _doc([{"tracks": [{"title": "t" * 100_000}] * 300}])
    df = spark.createDataFrame([(1, body, 1, "z"), (1, body, 2, "y")], "manifest_id bigint, manifest string, ordinals int, kind string")
    flat = flatten_manifests(df)
    assert flat.where("kind = 'track'").count() == 600
    t = table(flat, "track", ("media_pos", "track_pos"), {"title": "title"})
    assert t.agg(F.min(F.length("title")), F.max("track_pos")).first()[:] == (100_000, 300)


def test_partitioning_changes_nothing(spark, data):
    df = spark.read.parquet(f"{data}/manifests.parquet")
    a, b = (manifest_records(flatten_manifests(df.repartition(n))) for n in (1, 7))
    assert a.exceptAll(b).count() == b.exceptAll(a).count() == 0


def test_any_number_of_wrappers_and_any_depth(spark):
    body = _doc([{"tracks": [{"title": "a"}]}])
    rows = []
    for k in range(7):
        rows.append((k, body))
        body = json.dumps({"x": k, "payload": json.loads(body) if k % 2 else body})
    deep = '{"extra":' + "[" * 50_000 + "]" * 50_000 + ',"media":[{"tracks":[{"title":"t","other":' + '{"a":' * 30_000 + "1" + "}" * 30_000 + "}]}]}"
    got = _records(spark, [*rows, (100, deep), (101, deep[:-1]), (102, deep.replace("]" * 50_000, "]" * 49_999, 1))])
    assert got == sorted([(k, 1, 0, "medium", 0) for k in (*range(7), 100)] + [(k, 1, 1, "track", 0) for k in (*range(7), 100)])


@pytest.mark.parametrize("text", ['{"media":[],"media":[]}', '{"media":[{"x":{"a":1,"a":2}}]}', '{"media":[{"x":NaN}]}', '{"media":[{"disc":-Infinity}]}', '{"media":[1,]}', '{"media":[01]}', '{"media":[] "x":1}', "{'media':[]}", '{"media":["\n"]}', '{"media":[{}]}}', '{"media":[{"disc":tru}]}'])
def test_strict(text):
    assert triples(text, MANIFEST_GROUPS, "media", WRAPPERS) == []
    with pytest.raises(Unreadable):
        end = 0
        for _, _, end in events(text):
            pass
        if text[end:].strip():
            raise Unreadable


def test_events_tell_every_document_as_a_tree_would():
    rng = random.Random(3)

    def value(depth):
        kind = rng.randrange(9 if depth else 6)
        if kind < 6:
            return rng.choice([None, True, False, 0, -12, 1.5e-7, "", "a\"\\ü\u2028", "x" * 40])
        return [value(depth - 1) for _ in range(rng.randrange(4))] if kind < 8 else {f"k{i}": value(depth - 1) for i in range(rng.randrange(4))}

    for _ in range(300):
        doc = value(4)
        text = json.dumps(doc, ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 1]))
        parts = []
        for kind, v, _ in events(text):
            if parts and parts[-1][-1] not in "{[:" and kind not in "}]":
                parts.append(",")
            parts.append(json.dumps(v) + ":" if kind == "key" else json.dumps(v) if kind == "leaf" else kind)
        assert json.loads("".join(parts)) == doc


def test_groups_are_found_from_repeated_ancestors(spark):
    texts = [{"root": {"list": [{"a": 1, "deep": {"more": [{"b": "x"}, {"b": "y", "c": None}]}}], "one": {"p": 1}}}, {"root": {"list": {"a": 2}}}, {"root": {"list": {"m": {"a": 3}, "n": {"a": 4, "deep": {"more": {"b": "z"}}}}}}]
    df = spark.createDataFrame([(k, json.dumps(t["root"])) for k, t in enumerate(texts)] + [(9, None), (10, "[")], "id bigint, t string")
    assert repeated(df, "t", "one") == {}
    found = repeated(df, "t", "list")
    assert found == {"list": frozenset({"a", "deep"}), "list.deep.more": frozenset({"b", "c"})}
    groups = grouped(found, {"list": ("outer", ("a",), None, None), "list.deep.more": ("inner", ("b",), None, None)})
    assert groups[0].groups == (Group("inner", ("deep", "more"), ("b",), frozenset({"b", "c"})),)
    got = sorted((r.rec_id, r.kind, tuple(r.ordinals), tuple(sorted(r.fields.items()))) for r in flatten(df, "id", "t", groups, "list").collect())
    assert got == sorted([
        (0, "outer", (1,), (("a", "1"),)), (0, "inner", (1, 1), (("b", "x"),)), (0, "inner", (1, 2), (("b", "y"),)),
        (1, "outer", (1,), (("a", "2"),)), (2, "outer", (1,), (("a", "3"),)), (2, "outer", (2,), (("a", "4"),)), (2, "inner", (2, 1), (("b", "z"),)),
    ])
