"""Streaming twins of the sequential operators, and the webhook sink.

State processors need the RocksDB state store; ``use_rocksdb`` sets it for a session.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def window_positions(times: np.ndarray, after: int | None, window_ms: int) -> list[int]:
    """Where windows begin in sorted times, the first one at or after ``after``; one binary search for each."""
    at = 0 if after is None else int(np.searchsorted(times, after))
    starts = []
    while at < len(times):
        starts.append(at)
        at = int(np.searchsorted(times, times[at] + window_ms))
    return starts


class SeenCache(StatefulProcessor):
    """Keeps a row if its key's last kept row is at least ``window_ms`` older; dropped rows don't move that anchor.

    With ``ttl_ms`` a key that had no kept row for that long (by the clock) is forgotten; no less than the window may be given.
    """

    def __init__(self, window_ms: int, ttl_ms: int | None = None) -> None:
        if ttl_ms is not None and ttl_ms < window_ms:
            raise ValueError("a key must be known for a window at least")
        self.window_ms, self.ttl_ms = window_ms, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.anchor = handle.getValueState("anchor", "t long", ttlDurationMs=self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        times = np.sort(np.concatenate([part["t"].to_numpy() for part in rows]))
        starts = window_positions(times, self.anchor.get()[0] + self.window_ms if self.anchor.exists() else None, self.window_ms)
        if starts:
            self.anchor.update((int(times[starts[-1]]),))
            yield pd.DataFrame({"key": [key[0]] * len(starts), "t": times[starts]})

    def close(self) -> None:
        pass


class RateLimit(StatefulProcessor):
    """Fixed windows that begin with their first event and take ``limit`` of them."""

    def __init__(self, limit: int, window_ms: int) -> None:
        self.limit, self.window_ms = limit, window_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.window = handle.getValueState("window", "reset long, n int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        times = np.sort(np.concatenate([part["t"].to_numpy() for part in rows]))
        reset, n = self.window.get() if self.window.exists() else (None, 0)
        starts = window_positions(times, reset, self.window_ms)
        place = np.arange(len(times)) + n  # among the rows of the window that was open
        for a, b in zip(starts, [*starts[1:], len(times)], strict=True):
            place[a:b] = np.arange(b - a)
        allowed = place < self.limit
        last = int(place[-1]) + 1
        self.window.update((int(times[starts[-1]]) + self.window_ms if starts else reset, min(last, self.limit)))
        yield pd.DataFrame({"key": [key[0]] * len(times), "t": times, "allowed": allowed})

    def close(self) -> None:
        pass


class RunWatermark(StatefulProcessor):
    """Passes the rows of runs after a target's last one; the watermark moves to the newest run when a micro-batch ends.

    With ``open_runs`` it stays before the newest run, which is done with only when a newer one has begun, so that shots of a run
    may come in over several micro-batches.  Saved watermarks (target, last_run) are the state to begin with.
    """

    def __init__(self, open_runs: bool = False) -> None:
        self.open_runs = open_runs

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "run_id long")

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        self.last.update((int(initialState["last_run"].max()),))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last = self.last.get()[0] if self.last.exists() else None
        newest = last
        for part in rows:
            new = part if last is None else part[part["run_id"] > last]
            if len(new):
                newest = int(new["run_id"].max()) if newest is None else max(newest, int(new["run_id"].max()))
                yield new[["target", "run_id", "name"]]
        if newest is not None and newest != last:
            self.last.update((newest - self.open_runs,))

    def close(self) -> None:
        pass


def times_by_key(parts: Iterator[pd.DataFrame], most: int = 100_000) -> Iterator[dict[str, tuple[int, int]]]:
    """For each key of rows (key, t) the time that came first and the greatest one; whenever ``most`` keys are together, they are given and forgotten."""
    met: dict[str, tuple[int, int]] = {}
    for part in parts:
        firsts = part.drop_duplicates("key").set_index("key")["t"]
        greatest = part.groupby("key", sort=False, dropna=False)["t"].max()  # in the order of the firsts
        for name, first, last in zip(firsts.index, firsts.tolist(), greatest.tolist(), strict=True):
            before = met.get(name)
            met[name] = (first, last) if before is None else (before[0], max(before[1], last))
        if len(met) >= most:
            yield met
            met = {}
    if met:
        yield met


class BoundedCache(StatefulProcessor):
    """The last time of each key of a lane; when a lane has more than ``most`` entries, those older than ``age_ms`` before the newest row go.

    Gives (key, t, size): the rows whose key wasn't there, and how many entries the lane had after them.  The state is asked once for each
    key of a micro-batch (of 100,000 keys at a time), not for each row.
    """

    def __init__(self, most: int, age_ms: int) -> None:
        self.most, self.age_ms = most, age_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.entries = handle.getMapState("entries", "key string", "t long")
        self.size = handle.getValueState("size", "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        size = self.size.get()[0] if self.size.exists() else 0
        newest, fresh = None, []
        for met in times_by_key(rows):
            for name, (first, last) in met.items():
                known = self.entries.getValue((name,))
                if known is None:
                    size += 1
                    fresh.append((name, first))
                if known is None or last > known[0]:
                    self.entries.updateValue((name,), (last,))
                newest = last if newest is None else max(newest, last)
        if size > self.most and newest is not None:
            old = [name for name, value in self.entries.iterator() if value[0] < newest - self.age_ms]
            for name in old:
                self.entries.removeKey(name)
            size -= len(old)
        self.size.update((size,))
        if fresh:
            yield pd.DataFrame(fresh, columns=["key", "t"]).assign(size=size)

    def close(self) -> None:
        pass


def bounded_cache_stream(rows: DataFrame, most: int = 1000, age_ms: int = 60000, lanes: int = 64) -> DataFrame:
    """key, t, size: the rows (key: string, t: ms) that a cache hadn't met, from ``lanes`` caches that share ``most`` entries.

    Old entries go when a micro-batch ends, from a lane that has more than its part; young ones stay whatever their number, as in the rule for batches.
    """
    lane = F.pmod(F.xxhash64("key"), F.lit(lanes)).alias("lane")
    return rows.select(lane, "key", "t").groupBy("lane").transformWithStateInPandas(BoundedCache(most // lanes, age_ms), "key string, t long, size long", "Append", "None")


def seen_cache_stream(rows: DataFrame, window_ms: int, ttl_ms: int | None = None) -> DataFrame:
    """``rows``: key, t (ms), in time order over micro-batches.

    A stream whose keys are forgotten by the clock also has micro-batches without data; where it is to end with what is
    there now, switch these off (spark.sql.streaming.noDataMicroBatches.enabled).
    """
    return rows.groupBy("key").transformWithStateInPandas(SeenCache(window_ms, ttl_ms), "key string, t long", "Append", "None" if ttl_ms is None else "ProcessingTime")


def new_runs_stream(rows: DataFrame, watermarks: DataFrame | None = None, open_runs: bool = False) -> DataFrame:
    """``rows``: target, run_id, name.  Rows of runs that are newer than their target's watermark before the micro-batch.

    ``watermarks`` (target, last_run) are what was saved before the stream's first run; ``open_runs``: see :class:`RunWatermark`.
    """
    begin = None if watermarks is None else watermarks.select("target", F.col("last_run").cast("long").alias("last_run")).groupBy("target")
    out = "target string, run_id long, name string"
    return rows.groupBy("target").transformWithStateInPandas(RunWatermark(open_runs), out, "Append", "None", initialState=begin)


def rate_limit_stream(rows: DataFrame, limit: int, window_ms: int) -> DataFrame:
    return rows.groupBy("key").transformWithStateInPandas(RateLimit(limit, window_ms), "key string, t long, allowed boolean", "Append", "None")


def activity_stream(rows: DataFrame, late: str = "10 minutes", every: str = "1 hour") -> DataFrame:
    """room_name, start_ms, n: messages per room and window, once the watermark has passed its end.  ``rows``: ts (timestamp), room_name."""
    counts = rows.withWatermark("ts", late).groupBy(F.window("ts", every), "room_name").agg(F.count(F.lit(1)).alias("n"))
    return counts.select("room_name", F.unix_millis(F.col("window.start")).alias("start_ms"), "n")


def followed_stream(causes: DataFrame, effects: DataFrame, within: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Pairs (key, cause, effect) of the same key of which the effect comes no later than ``within`` after the cause.

    Both streams (key, id, ts) have a watermark, so a cause is forgotten ``within`` after its time, an effect at once.
    """
    a = causes.select(F.col("key"), F.col("id").alias("cause"), F.col("ts").alias("cause_ts")).withWatermark("cause_ts", late)
    b = effects.select(F.col("key").alias("effect_key"), F.col("id").alias("effect"), F.col("ts").alias("effect_ts")).withWatermark("effect_ts", late)
    near = (F.col("key") == F.col("effect_key")) & F.col("effect_ts").between(F.col("cause_ts"), F.col("cause_ts") + F.expr(f"INTERVAL {within}"))
    return a.join(b, near).select("key", "cause", "effect")


def late_rows(run: StreamingQuery) -> int:
    """How many rows came after the watermark and were left out, in the micro-batches that the query remembers."""
    return sum(o["numRowsDroppedByWatermark"] for p in run.recentProgress for o in p["stateOperators"])


def webhook_sink(batch_size: int, post: Callable[[int, list[str]], None]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that posts the payloads of rows (id, payload) in batches from the tasks, in order of id within a task."""

    def sink(batch: DataFrame, epoch: int) -> None:
        def send(rows: Iterator) -> None:
            held: list[str] = []
            for row in rows:
                held.append(row["payload"])
                if len(held) == batch_size:
                    post(epoch, held)
                    held = []
            if held:
                post(epoch, held)

        batch.select("id", "payload").sortWithinPartitions("id").foreachPartition(send)

    return sink


def webhook_query(rows: DataFrame, batch_size: int, interval: str | None, post: Callable[[int, list[str]], None], checkpoint: str) -> StreamingQuery:
    """Start a webhook sink: what came in the ``interval`` is sent in batches of ``batch_size``, the last one as it is.

    So a batch goes when it is full or when its time is over; without an interval, what is there now is sent.
    A micro-batch that is tried again is posted again, under the same epoch.
    """
    trigger = {"availableNow": True} if interval is None else {"processingTime": interval}
    return rows.writeStream.foreachBatch(webhook_sink(batch_size, post)).option("checkpointLocation", checkpoint).trigger(**trigger).start()
