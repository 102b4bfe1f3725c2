"""Structured Streaming forms of the stateful operators. Event times are cast to instants, since watermarks need them."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from carillon.operators.kernels import shuffled
from carillon.session import stage_path


def read_files(spark: SparkSession, folder: str, glob: str, schema, at: str = "ts", files_per_batch: int = 1) -> DataFrame:
    """Parquet files of a folder as a stream, with ``at`` as an instant."""
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).option("pathGlobFilter", glob).parquet(folder)
    return s.withColumn(at, F.col(at).cast("timestamp"))


def tumbling(events: DataFrame, at: str, width: str, late: str, keys: list[str], value: str) -> DataFrame:
    """Peak, sum and number per window of a fixed width; events later than ``late`` are dropped, windows close when it has passed."""
    w = F.window(F.col(at), width)
    return events.withWatermark(at, late).groupBy(w.alias("w"), *keys).agg(F.max(F.abs(value)).alias("peak"), F.sum(value).alias("total"), F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), *keys, "peak", "total", "n")


def hopping(events: DataFrame, at: str, width: str, step: str, late: str, keys: list[str], value: str) -> DataFrame:
    """As ``tumbling``, over windows of ``width`` that begin every ``step``."""
    w = F.window(F.col(at), width, step)
    return events.withWatermark(at, late).groupBy(w.alias("w"), *keys).agg(F.sum(value).alias("total"), F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), *keys, "total", "n")


def sliding_sessions(events: DataFrame, by: str, at: str, gap: timedelta, late: str) -> DataFrame:
    """``by, first_at, last_at, n``: sessions that every event prolongs by ``gap``, an event at exactly the gap included. A session
    comes out when the watermark has passed its end, or at the event that begins the next one."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        first, last, n = state.get if state.exists else (None, None, 0)
        out = []
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame([(key[0], first, last, n)], columns=["k", "first_at", "last_at", "n"])
            return
        times = sorted(t for b in batches for t in b["t"].dropna())
        for t in times:
            t = t.to_pydatetime()
            if first is not None and t - last > gap:
                out.append((key[0], first, last, n))
                first, n = None, 0
            if first is None:
                first, last = t, t
            last, n = max(last, t), n + 1
        if first is not None:
            state.update((first, last, n))
            end = int((last + gap - datetime(1970, 1, 1)).total_seconds() * 1000) + 1
            state.setTimeoutTimestamp(max(end, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["k", "first_at", "last_at", "n"])

    kind = events.schema[by].dataType.simpleString()
    keyed = events.select(F.col(by).alias("k"), F.col(at).alias("t")).withWatermark("t", late)
    got = keyed.groupBy("k").applyInPandasWithState(run, f"k {kind}, first_at timestamp, last_at timestamp, n bigint", "first_at timestamp, last_at timestamp, n bigint", "append", GroupStateTimeout.EventTimeTimeout)
    return got.withColumnRenamed("k", by)


# ---- queues ----

HISTORY = 500


class Queue:
    """Items, a cursor and the places it came from; the outcome depends on the order of the actions alone. With shuffle on, items are
    played in an order drawn anew, the current one first, whenever the items or the setting change; the drawing is seeded, so a
    replay gives the same queue."""

    def __init__(self, items: list | None = None, index: int = -1, history: list | None = None, repeat: str = "off", order: list | None = None, draws: int = 0, seed: str = "queue"):
        self.items, self.index, self.history, self.repeat = list(items or ()), index, list(history or ()), repeat
        #: The order in which shuffled items are played; None while shuffle is off.
        self.order, self.draws, self.seed = order, draws, seed

    def _arrange(self) -> None:
        if self.order is not None:
            rest = [k for k in range(len(self.items)) if k != self.index]
            drawn = [rest[k] for k in shuffled(len(rest), f"{self.seed}-{self.draws}")]
            self.order, self.draws = [self.index] * (self.index >= 0) + drawn, self.draws + 1

    def _shuffle(self, arg):
        if (arg == "on") != (self.order is not None):
            self.order, self.history = [] if arg == "on" else None, []
            self._arrange()

    def act(self, name: str, arg: str | None = None) -> None:
        before = list(self.items)
        getattr(self, f"_{name}", self._none)(arg)
        if self.items != before or name == "play":
            self._arrange()

    def _none(self, arg):
        """An unknown action changes nothing."""

    def _play(self, arg):
        self.items, self.index, self.history = [x for x in (arg or "").split(",") if x], 0, []
        self.index = 0 if self.items else -1

    def _enqueue(self, arg):
        self.items.append(arg)

    def _play_next(self, arg):
        if not self.items:
            self.items, self.index = [arg], 0
        else:
            self.items.insert(min(max(self.index + 1, 0), len(self.items)), arg)

    def _repeat(self, arg):
        self.repeat = arg if arg in ("off", "one", "all") else self.repeat

    def _next(self, arg):
        if not self.items:
            return
        if self.index >= 0:
            self.history = [*self.history, self.index][-HISTORY:]
        if self.order is not None:
            at = self.order.index(self.index) + 1 if self.index in self.order else len(self.order)
            if at < len(self.order):
                self.index = self.order[at]
            elif self.repeat == "all":
                self._arrange()
                self.index = self.order[0]
        elif self.index + 1 < len(self.items):
            self.index += 1
        elif self.repeat == "all":
            self.index = 0

    def _previous(self, arg):
        while self.history:
            k = self.history.pop()
            if 0 <= k < len(self.items) and k != self.index:
                self.index = k
                return
        if self.order is not None:
            at = self.order.index(self.index) if self.index in self.order else 0
            self.index = self.order[at - 1] if at > 0 else self.index
        elif self.index > 0:
            self.index -= 1

    def _move_to(self, arg):
        if arg is not None and arg.lstrip("-").isdigit() and 0 <= int(arg) < len(self.items):
            self.index = int(arg)

    def _remove(self, arg):
        k = int(arg) if arg is not None and arg.isdigit() else -1
        if not 0 <= k < len(self.items):
            return
        del self.items[k]
        self.history = [h - (h > k) for h in self.history if h != k]
        self.index = min(self.index, len(self.items) - 1) if k == self.index else self.index - (k < self.index)

    def _move(self, arg):
        try:
            a, b = (int(x) for x in (arg or "").split(">"))
        except ValueError:
            return
        if not (0 <= a < len(self.items) and 0 <= b < len(self.items)) or a == b:
            return
        order = list(range(len(self.items)))
        order.insert(b, order.pop(a))
        self.items = [self.items[k] for k in order]
        place = {old: new for new, old in enumerate(order)}
        self.history = [place.get(h, h) for h in self.history]
        self.index = place.get(self.index, self.index)

    def _clear(self, arg):
        self.items, self.index, self.history = [], -1, []


QUEUE_SCHEMA = "k bigint, items string, position int, n_actions bigint"


def _replay(key: int, start: Queue, n: int, pdf: pd.DataFrame) -> tuple[Queue, int]:
    for a, x in zip(pdf["action"], pdf["arg"]):
        start.act(a, x if isinstance(x, str) else None)
    return start, n + len(pdf)


def queue_batch(actions: DataFrame) -> DataFrame:
    """``k, items, position, n_actions``: each key's queue after its actions (``k, at, seq, action, arg``), in order of time and number."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        q, n = _replay(0, Queue(seed=f"queue-{pdf['k'].iloc[0]}"), 0, pdf.sort_values(["at", "seq"]))
        return pd.DataFrame([(pdf["k"].iloc[0], ",".join(q.items), q.index, n)], columns=["k", "items", "position", "n_actions"])

    return actions.groupBy("k").applyInPandas(run, QUEUE_SCHEMA)


def queue_stream(actions: DataFrame) -> DataFrame:
    """The same as a stream, one row a key and batch; batches must come in order of time."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        items, index, history, repeat, n, order, draws = state.get if state.exists else ("", -1, "", "off", 0, None, 0)
        numbers = lambda t: [int(x) for x in t.split(",") if x]
        q = Queue([x for x in items.split(",") if x], index, numbers(history), repeat, None if order is None else numbers(order), draws, f"queue-{key[0]}")
        pdf = pd.concat(list(batches)).sort_values(["at", "seq"])
        q, n = _replay(key[0], q, n, pdf)
        state.update((",".join(q.items), q.index, ",".join(map(str, q.history)), q.repeat, n, None if q.order is None else ",".join(map(str, q.order)), q.draws))
        yield pd.DataFrame([(key[0], ",".join(q.items), q.index, n)], columns=["k", "items", "position", "n_actions"])

    return actions.groupBy("k").applyInPandasWithState(run, QUEUE_SCHEMA, "items string, position int, history string, repeat string, n bigint, played string, draws int", "update", GroupStateTimeout.NoTimeout)


# ---- state machines ----

#: A player's states by state and event; an event that a state doesn't know leaves it.
PLAYER = {
    **{(s, "play"): "loading" for s in ("idle", "ended", "error", "playing", "paused", "buffering", "loading")}, ("loading", "ready"): "buffering", ("loading", "data"): "playing", ("buffering", "data"): "playing",
    **{(s, "starved"): "buffering" for s in ("loading", "playing")}, **{(s, "pause"): "paused" for s in ("loading", "buffering", "playing")}, ("paused", "resume"): "playing",
    ("playing", "finished"): "ended", **{(s, "fail"): "error" for s in ("loading", "buffering", "playing", "paused")}, **{(s, "stop"): "idle" for s in ("loading", "buffering", "playing", "paused", "ended", "error")},
}


def state_batch(events: DataFrame, table: dict[tuple[str, str], str] = PLAYER, start: str = "idle") -> DataFrame:
    """``k, seq, state``: each key's state after each event (``k, at, seq, event``). An event acts on any state as one map of states,
    so a key's events are a running composition of maps: folded in order of time and number."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["at", "seq"])
        state, out = start, []
        for e in pdf["event"]:
            state = table.get((state, e), state)
            out.append(state)
        return pd.DataFrame({"k": pdf["k"], "seq": pdf["seq"], "state": out})

    return events.groupBy("k").applyInPandas(run, "k bigint, seq bigint, state string")


def state_stream(events: DataFrame, table: dict[tuple[str, str], str] = PLAYER, start: str = "idle") -> DataFrame:
    """The same as a stream; batches must come in order of time."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.get[0] if state.exists else start
        pdf = pd.concat(list(batches)).sort_values(["at", "seq"])
        out = []
        for e in pdf["event"]:
            now = table.get((now, e), now)
            out.append(now)
        state.update((now,))
        yield pd.DataFrame({"k": pdf["k"], "seq": pdf["seq"], "state": out})

    return events.groupBy("k").applyInPandasWithState(run, "k bigint, seq bigint, state string", "state string", "append", GroupStateTimeout.NoTimeout)


def drain(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a stream over all that is there, and give what it wrote: a table in the shared folder."""
    spark = stream.sparkSession
    out, log = stage_path(spark, name), stage_path(spark, name + "-log")
    schema = stream.schema
    if mode == "update":
        q = stream.writeStream.outputMode("update").option("checkpointLocation", log).foreachBatch(lambda df, k: df.write.mode("overwrite").parquet(f"{out}/batch={k}")).trigger(availableNow=True).start()
    else:
        q = stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", log).option("path", out).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(schema).parquet(out) if mode != "update" else spark.read.parquet(out)
