"""Queries that run as streams over the events file, each with its batch form as the SQL or as the test."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Window
from pyspark.sql import functions as F

from carillon.streaming import streams as T
from carillon.tables import load


def _stream(s, d):
    return T.read_files(s, d, "events.parquet", load(s, d, "events").schema)


def stream_buckets(s, d):
    """Daily windows. The last one isn't closed by any later event, so it doesn't come out."""
    got = T.drain(T.tumbling(_stream(s, d), "ts", "1 day", "1 hour", ["event_type"], "value"), "buckets")
    return got.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", F.round("peak", 4).alias("peak"), F.round("total", 4).alias("total"), "n")


def stream_hopping(s, d):
    got = T.drain(T.hopping(_stream(s, d), "ts", "2 days", "1 day", "1 hour", ["event_type"], "value"), "hopping")
    return got.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", F.round("total", 4).alias("total"), "n")


def stream_sessions(s, d):
    """Sessions with a gap of half an hour, as far as they are closed."""
    got = T.drain(T.sliding_sessions(_stream(s, d), "user_id", "ts", timedelta(minutes=30), "0 seconds"), "sessions")
    return got.select("user_id", F.date_format("first_at", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("first_at"), "n")


def _actions(df):
    k = F.col("event_id") % 11
    act = F.when(k < 4, F.lit("enqueue")).when(k < 7, F.lit("next")).when(k == 7, F.lit("previous")).when(k == 8, F.lit("remove")).when(k == 9, F.lit("play_next")).otherwise(F.lit("move"))
    act = F.when(F.col("event_id") % 29 == 0, F.lit("shuffle")).otherwise(act)
    arg = F.when(act == "shuffle", F.when(F.col("event_id") % 3 > 0, F.lit("on")).otherwise(F.lit("off"))).when(act == "remove", F.lit("1")).when(act == "move", F.lit("0>2")).otherwise(F.concat(F.lit("t"), F.col("event_id").cast("string")))
    return df.select(F.col("user_id").alias("k"), F.col("ts").cast("timestamp").alias("at"), F.col("event_id").alias("seq"), act.alias("action"), arg.alias("arg"))


def stream_queue(s, d):
    """Each user's queue after all actions, from the stream."""
    got = T.drain(T.queue_stream(_actions(_stream(s, d))), "queue", "update")
    last = Window.partitionBy("k").orderBy(F.col("n_actions").desc())
    return got.withColumn("r", F.row_number().over(last)).where("r = 1").select("k", "items", F.col("position").alias("pos"), "n_actions")


def queue_replay(s, d):
    """The same from a batch."""
    return T.queue_batch(_actions(load(s, d, "events"))).select("k", "items", F.col("position").alias("pos"), "n_actions")


def _player(df):
    names = F.array(*(F.lit(x) for x in ("play", "ready", "data", "starved", "data", "pause", "resume", "finished", "play", "data", "fail", "stop")))
    return df.select(F.col("user_id").alias("k"), F.col("ts").cast("timestamp").alias("at"), F.col("event_id").alias("seq"), F.element_at(names, (F.col("event_id") % 12 + 1).cast("int")).alias("event"))


def stream_player(s, d):
    """Each user's player state after each event, from the stream."""
    return T.drain(T.state_stream(_player(_stream(s, d))), "player")


def player_replay(s, d):
    """The same from a batch."""
    return T.state_batch(_player(load(s, d, "events")))


QUERIES = {f.__name__: f for f in (stream_buckets, stream_hopping, stream_sessions, stream_queue, queue_replay, stream_player, player_replay)}
SQL = {
    "stream_buckets": "WITH w AS (SELECT date_trunc('day', ts) AS d, event_type, round(max(abs(value)), 4) peak, round(sum(value), 4) total, count(*) n FROM events GROUP BY 1, 2) SELECT strftime(d, '%Y-%m-%d') AS day, event_type, peak, total, n FROM w WHERE d + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)",
    "stream_hopping": "WITH w AS (SELECT date_trunc('day', ts) - INTERVAL (k) DAY AS d, event_type, round(sum(value), 4) total, count(*) n FROM events, (VALUES (0), (1)) t(k) GROUP BY 1, 2) SELECT strftime(d, '%Y-%m-%d') AS day, event_type, total, n FROM w WHERE d + INTERVAL 2 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)",
    "stream_sessions": "WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 1800 SECONDS THEN 0 ELSE 1 END nw FROM events), s AS (SELECT *, sum(nw) OVER (PARTITION BY user_id ORDER BY ts) k FROM g), e AS (SELECT user_id, k, min(ts) a, max(ts) b, count(*) n FROM s GROUP BY 1, 2) SELECT user_id, strftime(a, '%Y-%m-%d %H:%M:%S.%f') first_at, n FROM e WHERE b + INTERVAL 1800 SECONDS < (SELECT max(ts) FROM events)",
}

# a state machine in SQL: one step a row, by a recursion over each user's events
_CASES = " ".join(f"WHEN s.state = '{a}' AND e.event = '{e}' THEN '{b}'" for (a, e), b in T.PLAYER.items())
_MACHINE = f"""WITH RECURSIVE e AS (SELECT user_id AS k, event_id AS seq, list_extract(['play', 'ready', 'data', 'starved', 'data', 'pause', 'resume', 'finished', 'play', 'data', 'fail', 'stop'], (event_id % 12 + 1)::INT) AS event,
 row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events), s AS (SELECT DISTINCT user_id AS k, 0::BIGINT AS n, NULL::BIGINT AS seq, 'idle' AS state FROM events
 UNION ALL SELECT e.k, e.n, e.seq, CASE {_CASES} ELSE s.state END FROM s JOIN e ON e.k = s.k AND e.n = s.n + 1) SELECT k, seq, state FROM s WHERE seq IS NOT NULL"""
SQL |= {"stream_player": _MACHINE, "player_replay": _MACHINE}
