"""Delivery of messages to an endpoint: one queue that goes by size or by time, and attempts with growing waits.

Both are keyed state with processing-time timers, so what waits survives a restart from the checkpoint; Spark looks at timers again from
the first micro-batch with rows on.  A micro-batch that is
tried again posts again: a receiver tells repeats apart by a message's identifier and the number of the attempt.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from datetime import datetime

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

RETRIES = 3
BASE_MS = 1000
DELIVERED, FAILED = "delivered", "failed"
PACK = 10_000
"""Rows that go to the state or come out of a queue together, at most."""

Post = Callable[[str, str, int], None]
"""Takes a message's identifier, its payload and the number of the attempt; raises if the message didn't arrive."""


class Delivery(StatefulProcessor):
    """Posts every row; a failed one is tried again after ``base_ms``, twice and four times that, and failed for good then.

    The rows of a lane (the key) are posted one after the other; those that wait are in its list, as packs of rows that have had as many attempts and are
    due together, with a timer for each time at which some are due.
    """

    def __init__(self, post: Post, retries: int = RETRIES, base_ms: int = BASE_MS) -> None:
        self.post, self.retries, self.base_ms = post, retries, base_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "ids array<string>, payloads array<string>, attempts int, due long")

    def _attempted(self, ids: list[str], payloads: list[str], attempts: int, now: int) -> tuple[pd.DataFrame | None, list[tuple]]:
        """(id, outcome, attempts) of the rows that are done with after one more attempt, and the packs of those that wait."""
        attempts += 1
        done, outcomes, waiting = [], [], []
        for name, payload in zip(ids, payloads, strict=True):
            try:
                self.post(name, payload, attempts)
                outcome = DELIVERED
            except Exception:  # whatever an endpoint raises is a failed attempt
                if attempts <= self.retries:
                    waiting.append((name, payload))
                    continue
                outcome = FAILED
            done.append(name)
            outcomes.append(outcome)
        due = now + self.base_ms * 2 ** (attempts - 1)
        parts = [waiting[at : at + PACK] for at in range(0, len(waiting), PACK)]
        packs = [([i for i, _ in part], [p for _, p in part], attempts, due) for part in parts]
        return pd.DataFrame({"id": done, "outcome": outcomes, "attempts": attempts}) if done else None, packs

    def _schedule(self, packs: list[tuple]) -> None:
        for due in {p[3] for p in packs}:
            self.handle.registerTimer(due)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs()
        scheduled = False
        for part in rows:
            done, packs = self._attempted(part["id"].tolist(), part["payload"].tolist(), 0, now)
            if packs:
                self.waiting.appendList(packs)
                if not scheduled:  # all are due at the same time
                    self._schedule(packs)
                    scheduled = True
            if done is not None:
                yield done

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs()
        packs = [tuple(p) for p in self.waiting.get()] if self.waiting.exists() else []
        left = [p for p in packs if p[3] > now]
        if len(left) == len(packs):
            return
        again = []
        for ids, payloads, attempts, due in packs:
            if due <= now:
                done, more = self._attempted(ids, payloads, attempts, now)
                again += more
                if done is not None:
                    yield done
        self._schedule(again)
        if left or again:
            self.waiting.put(left + again)
        else:
            self.waiting.clear()

    def close(self) -> None:
        pass


QUEUED = pa.schema([("id", pa.int64()), ("payload", pa.large_string())])


class SizeOrTimeQueue(StatefulProcessor):
    """A first-in first-out queue for each key: ``batch_size`` rows go together, fewer when the first of them has waited for ``interval_ms``.

    Rows of one micro-batch queue in order of ``id``; they are held as Arrow columns and come out many batches at a time.  Less than a batch waits in the state.
    """

    def __init__(self, batch_size: int, interval_ms: int) -> None:
        self.batch_size, self.interval_ms = batch_size, interval_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "id long, payload string")
        self.mark = handle.getValueState("mark", "batch_no long, due long")

    def _out(self, key, rows: pa.Table, batch_no: int, by: str) -> pd.DataFrame:
        """The rows as batches from ``batch_no`` on."""
        return rows.to_pandas().assign(queue=key[0], batch_no=batch_no + np.arange(rows.num_rows) // self.batch_size, by=by)[["queue", "id", "payload", "batch_no", "by"]]

    def _held(self) -> pa.Table:
        rows = [tuple(r) for r in self.waiting.get()] if self.waiting.exists() else []
        return pa.table([[r[0] for r in rows], [r[1] for r in rows]], schema=QUEUED)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch_no, due = self.mark.get() if self.mark.exists() else (0, 0)
        new = pa.concat_tables(pa.Table.from_pandas(part[QUEUED.names], QUEUED, preserve_index=False) for part in rows).combine_chunks()
        order = pc.sort_indices(new, [("id", "ascending")])
        held = self._held()
        queued = held.num_rows + new.num_rows
        whole = queued // self.batch_size * self.batch_size
        step = max(PACK // self.batch_size, 1) * self.batch_size  # whole batches
        at = 0  # of the new rows
        for end in [*range(step, whole, step), *([whole] if whole else [])]:
            upto = end - (queued - new.num_rows)
            part = pa.concat_tables([held, new.take(order[at:upto])])
            yield self._out(key, part, batch_no, "size")
            batch_no += part.num_rows // self.batch_size
            held, at = held.slice(held.num_rows), upto
        rest = pa.concat_tables([held, new.take(order[at:])])
        if due and whole:  # those whose time ran are gone
            self.handle.deleteTimer(due)
            due = 0
        if rest.num_rows:
            self.waiting.put(list(zip(*(c.to_pylist() for c in rest.columns), strict=True)))
            if not due:
                due = timerValues.getCurrentProcessingTimeInMs() + self.interval_ms
                self.handle.registerTimer(due)
        else:
            self.waiting.clear()
        self.mark.update((batch_no, due))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        batch_no, _ = self.mark.get()
        held = self._held()
        self.waiting.clear()
        self.mark.update((batch_no + bool(held.num_rows), 0))
        if held.num_rows:
            yield self._out(key, held, batch_no, "time")

    def close(self) -> None:
        pass


def deliveries(rows: DataFrame, post: Post, lanes: int = 64, retries: int = RETRIES, base_ms: int = BASE_MS) -> DataFrame:
    """id, outcome (delivered or failed), attempts: every row of a stream (id, payload: strings) once it is done with.

    Rows are dealt to ``lanes`` by a hash of their identifier, which bounds how many posts run at a time.
    """
    lane = F.pmod(F.xxhash64("id"), F.lit(lanes)).alias("lane")
    keyed = rows.select(lane, F.col("id").cast("string").alias("id"), F.col("payload").cast("string").alias("payload"))
    return keyed.groupBy("lane").transformWithStateInPandas(Delivery(post, retries, base_ms), "id string, outcome string, attempts int", "Append", "ProcessingTime")


def queued(rows: DataFrame, batch_size: int, interval_ms: int) -> DataFrame:
    """queue, id, payload, batch_no, by (size or time): a stream (queue, id, payload) in the batches in which its queues send it."""
    rows = rows.select(F.col("queue").cast("string").alias("queue"), F.col("id").cast("long").alias("id"), F.col("payload").cast("string").alias("payload"))
    out = "queue string, id long, payload string, batch_no long, by string"
    return rows.groupBy("queue").transformWithStateInPandas(SizeOrTimeQueue(batch_size, interval_ms), out, "Append", "ProcessingTime")


def settled(query: StreamingQuery, longest_wait_ms: int, timeout_s: float = 600) -> None:
    """Wait until a stream with timers has worked off what is there, and stop it.

    That is when a micro-batch that began ``longest_wait_ms`` after the last active one ended found nothing to do.  The time runs out
    ``timeout_s`` after the last micro-batch that did something was reported, so a long stream may take longer as a whole.
    """
    ends = time.monotonic() + timeout_s
    idle_after = None
    seen = -1
    while time.monotonic() < ends:
        if query.exception() is not None:
            raise query.exception()
        for progress in query.recentProgress:
            if progress["batchId"] <= seen and progress["numInputRows"] == 0:
                continue
            batch_new = progress["batchId"] > seen
            seen = max(seen, progress["batchId"])
            began = datetime.fromisoformat(progress["timestamp"].replace("Z", "+00:00")).timestamp() * 1000
            state = progress["stateOperators"][0] if progress["stateOperators"] else {"numRowsUpdated": 0, "numRowsRemoved": 0}
            if progress["numInputRows"] or state["numRowsUpdated"] or state["numRowsRemoved"]:
                if batch_new:
                    ends = time.monotonic() + timeout_s
                idle_after = began + progress["durationMs"].get("triggerExecution", 0) + longest_wait_ms
            elif idle_after is not None and began >= idle_after:
                query.stop()
                return
        time.sleep(0.1)
    query.stop()
    raise TimeoutError("the stream had work left")


def _waited(attempts: Column, base_ms: int) -> Column:
    """The waits before the last of some attempts, each twice the one before."""
    return (F.lit(base_ms) * (F.pow(F.lit(2.0), attempts - 1) - 1)).cast("long")


def delivery_outcomes(rows: DataFrame, failing: Column, retries: int = RETRIES, base_ms: int = BASE_MS) -> DataFrame:
    """``rows`` with the outcome, attempts and total wait of a delivery whose first ``failing`` attempts fail; no shuffle."""
    attempts = F.least(failing.cast("int") + 1, F.lit(retries + 1))
    waited = _waited(attempts, base_ms)
    outcome = F.when(failing <= retries, DELIVERED).otherwise(FAILED)
    return rows.withColumns({"outcome": outcome, "attempts": attempts, "waited_ms": waited})


def delivery_attempts(rows: DataFrame, failing: Column, retries: int = RETRIES, base_ms: int = BASE_MS) -> DataFrame:
    """A row for each attempt: the columns of ``rows``, attempt (from 1), at_ms since the first one, arrived."""
    out = delivery_outcomes(rows.withColumn("_failing", failing.cast("int")), F.col("_failing"), retries, base_ms)
    out = out.withColumn("attempt", F.explode(F.sequence(F.lit(1), "attempts")))
    at = _waited(F.col("attempt"), base_ms)
    return out.withColumns({"at_ms": at, "arrived": F.col("attempt") > F.col("_failing")}).drop("_failing", "outcome", "attempts", "waited_ms")
