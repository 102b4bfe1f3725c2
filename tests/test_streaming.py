import os
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from carillon.operators.temporal import sessions
from carillon.streaming import streams as S


def test_queue_actions():
    q = S.Queue(["t1", "t2", "t3", "t4"], 0)
    q.act("next")
    q.act("remove", "1")
    assert q.items == ["t1", "t3", "t4"] and q.index == 1
    q.act("move", "0>2")
    assert q.items == ["t3", "t4", "t1"] and q.index == 0
    q.act("previous")
    assert q.index == 2
    q.act("next")
    assert q.index == 2
    q.act("repeat", "all")
    q.act("next")
    assert q.index == 0
    q.act("play_next", "n")
    assert q.items == ["t3", "n", "t4", "t1"]
    for name, arg in (("remove", "9"), ("move", "x"), ("move_to", "-1"), ("what", None), ("remove", None)):
        before = (list(q.items), q.index)
        q.act(name, arg)
        assert (q.items, q.index) == before
    q.act("clear")
    q.act("next")
    q.act("play_next", "z")
    assert q.items == ["z"] and q.index == 0


def test_shuffled_queue():
    q = S.Queue([f"t{k}" for k in range(8)], 3, seed="s")
    q.act("shuffle", "on")
    assert q.order[0] == 3 and sorted(q.order) == list(range(8)) and q.order != list(range(8))
    order = list(q.order)
    seen = [q.index]
    for _ in range(9):
        q.act("next")
        seen.append(q.index)
    assert seen[:8] == order and seen[8:] == [order[-1]] * 2  # each once, then it stays
    q.act("previous")
    assert q.index == order[6]
    q.act("remove", str(order[6]))
    assert sorted(q.order) == list(range(7)) and q.order[0] == q.index
    again = S.Queue([f"t{k}" for k in range(8)], 3, seed="s")
    again.act("shuffle", "on")
    assert again.order == order
    q.act("shuffle", "off")
    assert q.order is None and len(q.items) == 7
    at = q.index
    q.act("next")
    assert q.index == min(at + 1, 6)
    q.act("clear")
    q.act("shuffle", "on")
    q.act("next")
    assert q.index == -1 and q.order == []


def _write(spark, tmp_path, rows, schema, parts):
    for k, part in enumerate(parts):
        spark.createDataFrame([rows[i] for i in part], schema).coalesce(1).write.parquet(str(tmp_path / f"in/{k:03d}"))
        for f in (tmp_path / f"in/{k:03d}").glob("*.parquet"):
            os.utime(f, (1_700_000_000 + 60 * k,) * 2)  # a stream reads files by their time
    return str(tmp_path / "in")


def test_queue_stream_equals_batch(spark, tmp_path):
    schema = "k bigint, at timestamp, seq bigint, action string, arg string"
    names = ["enqueue", "enqueue", "next", "play_next", "remove", "shuffle", "previous", "move", "repeat", "next", "enqueue"]
    args = {"remove": "1", "move": "0>1", "repeat": "all", "shuffle": "on"}
    rows = [(k % 3, datetime(2024, 1, 1) + timedelta(seconds=k), k, names[k % 11], args.get(names[k % 11], f"t{k}")) for k in range(90)]
    folder = _write(spark, tmp_path, rows, schema, [range(0, 30), range(30, 60), range(60, 90)])
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(folder)
    got = {r.k: (r.items, r.position, r.n_actions) for r in S.drain(S.queue_stream(stream), "q", "update").orderBy("n_actions").collect()}
    want = {r.k: (r.items, r.position, r.n_actions) for r in S.queue_batch(spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(folder)).collect()}
    assert got == want


def test_sessions_at_exactly_the_gap(spark, tmp_path):
    t0 = datetime(2024, 1, 1)
    at = [0, 60, 120, 181, 300, 10_000]
    rows = [(1, t0 + timedelta(seconds=s)) for s in at] + [(2, t0)]
    folder = _write(spark, tmp_path, rows, "u bigint, ts timestamp", [[0, 1, 6], [2, 3], [4, 5]])
    stream = spark.readStream.schema("u bigint, ts timestamp").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(folder)
    got = sorted((r.u, r.first_at, r.last_at, r.n) for r in S.drain(S.sliding_sessions(stream, "u", "ts", timedelta(seconds=60), "0 seconds"), "s").collect())
    s = lambda k: t0 + timedelta(seconds=k)
    assert got == [(1, s(0), s(120), 3), (1, s(181), s(181), 1), (1, s(300), s(300), 1), (2, s(0), s(0), 1)]
    batch = sorted((r.u, r.first_at, r.last_at, r.n) for r in sessions(spark.createDataFrame(rows, "u bigint, ts timestamp"), "u", "ts", 60).select("u", "first_at", "last_at", "n").collect())
    assert batch == sorted([*got, (1, s(10_000), s(10_000), 1)])


def test_late_events_are_dropped(spark, tmp_path):
    t0 = datetime(2024, 1, 1)
    rows = [(1.0, t0), (2.0, t0 + timedelta(hours=5)), (2.0, t0 + timedelta(hours=5, minutes=1)), (4.0, t0 + timedelta(minutes=1)), (8.0, t0 + timedelta(hours=9))]
    folder = _write(spark, tmp_path, rows, "v double, ts timestamp", [[0], [1], [2], [3], [4]])
    stream = spark.readStream.schema("v double, ts timestamp").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(folder)
    got = {r.start: (r.total, r.n) for r in S.drain(S.tumbling(stream, "ts", "1 hour", "1 hour", [], "v"), "t").collect()}
    assert got == {t0: (1.0, 1), t0 + timedelta(hours=5): (4.0, 2)}


def test_player_states(spark):
    events = ["data", "play", "ready", "data", "starved", "data", "pause", "data", "resume", "finished", "stop", "play", "fail", "play"]
    df = spark.createDataFrame([(1, datetime(2024, 1, 1) + timedelta(seconds=k), k, e) for k, e in enumerate(events)], "k bigint, at timestamp, seq bigint, event string")
    got = [r.state for r in S.state_batch(df).orderBy("seq").collect()]
    assert got == ["idle", "loading", "buffering", "playing", "buffering", "playing", "paused", "paused", "playing", "ended", "idle", "loading", "error", "loading"]
