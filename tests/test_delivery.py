"""Delivery, queues, streamed ingestion, run watermarks of files and the bounded cache, each against a plain version."""

from __future__ import annotations

import json
import os
import random
import uuid

import pytest
from pyspark.sql import functions as F

from chatloom.operators import dedup as D
from chatloom.session import ship
from chatloom.sources import files
from chatloom.streaming import delivery as L
from chatloom.streaming import ingest as I
from chatloom.streaming import stateful as S


@pytest.fixture
def stateful(spark):
    S.use_rocksdb(spark)
    return ship(spark)


def flaky(folder):
    """An endpoint that notes each call in a file of its own and fails as often as the payload says."""

    def post(name: str, payload: str, attempt: int) -> None:
        with open(f"{folder}/{uuid.uuid4().hex}", "w") as f:
            json.dump([name, attempt], f)
        if attempt <= int(payload):
            raise TimeoutError

    return post


def calls(folder):
    return sorted(tuple(json.load(open(f"{folder}/{n}"))) for n in os.listdir(folder))


def test_every_row_ends_delivered_or_failed(stateful, tmp_path):
    (tmp_path / "calls").mkdir()
    rows = [(str(i), str(i % 7)) for i in range(60)]
    stateful.createDataFrame(rows, "id string, payload string").repartition(3).write.parquet(str(tmp_path / "in"))
    stream = stateful.readStream.schema("id string, payload string").parquet(str(tmp_path / "in"))
    out = L.deliveries(stream, flaky(str(tmp_path / "calls")), lanes=4, base_ms=40)
    run = out.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "check")).trigger(processingTime="50 milliseconds").start(str(tmp_path / "out"))
    L.settled(run, 160, 120)
    got = {r.id: (r.outcome, r.attempts) for r in stateful.read.parquet(str(tmp_path / "out")).collect()}
    batch = L.delivery_outcomes(stateful.createDataFrame(rows, "id string, payload string"), F.col("payload").cast("int")).collect()
    assert got == {r.id: (r.outcome, r.attempts) for r in batch}
    assert {r.outcome: 0 for r in batch} == {"delivered": 0, "failed": 0}
    assert calls(tmp_path / "calls") == sorted((i, n + 1) for i, (_, attempts) in got.items() for n in range(attempts))


def test_what_waits_survives_a_restart(stateful, tmp_path):
    (tmp_path / "calls").mkdir()
    stateful.createDataFrame([("x", "2"), ("y", "9"), ("z", "0")], "id string, payload string").coalesce(1).write.parquet(str(tmp_path / "in"))

    def start():
        stream = stateful.readStream.schema("id string, payload string").parquet(str(tmp_path / "in"))
        out = L.deliveries(stream, flaky(str(tmp_path / "calls")), lanes=2, base_ms=400)
        return out.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "check")).trigger(processingTime="50 milliseconds").start(str(tmp_path / "out"))

    run = start()
    while not any(p["numInputRows"] for p in run.recentProgress):
        assert run.exception() is None
    run.stop()
    stateful.createDataFrame([("w", "0")], "id string, payload string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    run = start()
    L.settled(run, 1600, 120)
    got = {r.id: (r.outcome, r.attempts) for r in stateful.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {"x": ("delivered", 3), "y": ("failed", 4), "z": ("delivered", 1), "w": ("delivered", 1)}


def test_attempts_follow_the_schedule(spark):
    rows = spark.createDataFrame([(1, 0), (2, 2), (3, 9)], "id int, fails int")
    got = sorted(map(tuple, L.delivery_attempts(rows, F.col("fails")).collect()))
    assert got == [(1, 0, 1, 0, True), (2, 2, 1, 0, False), (2, 2, 2, 1000, False), (2, 2, 3, 3000, True)] + [(3, 9, n, at, False) for n, at in ((1, 0), (2, 1000), (3, 3000), (4, 7000))]
    assert [r.waited_ms for r in L.delivery_outcomes(rows, F.col("fails")).orderBy("id").collect()] == [0, 3000, 7000]


def test_a_queue_goes_by_size_then_by_time(stateful, tmp_path):
    """Three micro-batches through one queue: numbering goes on, the rest goes when its time is over."""
    schema = "queue string, id long, payload string"
    for low, high in ((0, 7), (7, 8), (8, 24)):
        rows = [("q", i, f"p{i}") for i in range(low, high)] + ([("other", 100, None)] if low == 0 else [])
        stateful.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = stateful.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run = L.queued(stream, 5, 3_000).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "check")).trigger(processingTime="50 milliseconds").start(str(tmp_path / "out"))
    L.settled(run, 3_000, 120)
    got = stateful.read.parquet(str(tmp_path / "out")).collect()
    mine = {r.id: r for r in got if r.queue == "q"}
    assert {i: r.payload for i, r in mine.items()} == {i: f"p{i}" for i in range(24)}
    assert [(r.id, r.batch_no, r.by, r.payload) for r in got if r.queue == "other"] == [(100, 0, "time", None)]
    by_batch: dict = {}
    for i, r in mine.items():
        by_batch.setdefault((r.batch_no, r.by), []).append(i)
    assert sorted(by_batch) == [(n, b) for n, b in sorted(by_batch)] and {n for n, _ in by_batch} == set(range(len(by_batch)))
    assert sorted(i for ids in by_batch.values() for i in ids) == list(range(24))
    assert all(len(ids) == 5 for (_, by), ids in by_batch.items() if by == "size")
    ordered = [sorted(by_batch[k]) for k in sorted(by_batch)]
    assert [i for ids in ordered for i in ids] == list(range(24))


SCHEMA = "idx long, room_name string, sender string, content string, timestamp long"


def _notes(n):
    rnd = random.Random(n)
    long = "the same beginning of more than fifty characters, whatever comes "
    rows = []
    for i in range(n):
        text = rnd.choice([f"note {rnd.randrange(12)}", f"NOTE  {rnd.randrange(12)}", long + rnd.choice("abc"), "", None, " "])
        rows.append((i, rnd.choice(["team i", "team", "din"]), rnd.choice(["u", "v", "w", None]), text, rnd.randrange(1000, 2000)))
    return rows


def test_streamed_epochs_equal_the_batch_and_are_stored_once(stateful, tmp_path):
    rows, known = _notes(160), _notes(30)
    batch, existing = stateful.createDataFrame(rows, SCHEMA), stateful.createDataFrame(known, SCHEMA)
    want = sorted(map(tuple, D.ingest(batch, existing, 2000, ["i"], 400).collect()))
    store = I.open_store(stateful, str(tmp_path / "store"))
    cuts = [0, 35, 36, 90, 160]
    for epoch, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
        part = batch.filter(F.col("idx").between(a, b - 1))
        assert I.ingest_epoch(part, epoch, store, existing, 2000, ["i"], 400)
        before = sorted(map(tuple, I.stored(stateful, store).collect()))
        assert not I.ingest_epoch(part, epoch, store, existing, 2000, ["i"], 400)
        assert sorted(map(tuple, I.stored(stateful, store).collect())) == before
    assert sorted(tuple(r)[:-1] for r in I.stored(stateful, store).collect()) == want and len(want) > 10


def test_a_half_written_epoch_counts_for_nothing(stateful, tmp_path):
    rows = _notes(80)
    batch, none = stateful.createDataFrame(rows, SCHEMA), stateful.createDataFrame([], SCHEMA)
    store = I.open_store(stateful, str(tmp_path / "store"))
    I.ingest_epoch(batch.filter("idx < 40"), 0, store, none, 2000, [], 400)
    stateful.createDataFrame([(999, "team", "u", "half", 1)], SCHEMA).write.parquet(f"{store}/messages/epoch=1")  # what a lost driver left
    assert I.stored(stateful, store).filter("idx = 999").count() == 0
    I.ingest_epoch(batch.filter("idx >= 40"), 1, store, none, 2000, [], 400)
    got = sorted(tuple(r)[:-1] for r in I.stored(stateful, store).collect())
    assert got == sorted(map(tuple, D.ingest(batch, none, 2000, [], 400).collect()))


def test_each_rule_of_the_registered_ingest_drops_hundreds(spark):
    from chatloom.plans.dedup import NOTES_NOW_MS, NOTES_WITHIN_MS, notes

    n = notes(spark, "/root/testdata/sf0.01")
    batch, existing = n.filter("idx % 2 = 1 AND room_name LIKE '%i%'"), n.filter("idx % 2 = 0")
    first = D.first_of_cache_keys(batch, [])
    alone = D.unknown_in_room(first, NOTES_NOW_MS, NOTES_WITHIN_MS)
    left = D.known_in_room(alone, existing, NOTES_NOW_MS, NOTES_WITHIN_MS)
    sizes = [d.count() for d in (batch, first, alone, left)]
    assert all(a - b > 150 for a, b in zip(sizes[:-1], sizes[1:])) and sizes[-1] > 500


def test_screenshots_of_old_runs_are_dropped_as_they_come(stateful, tmp_path):
    folder = tmp_path / "shots"
    folder.mkdir()
    marks = stateful.createDataFrame([("room", 100), ("gone", 5)], "target string, last_run long")

    def run(names):
        for name in names:
            (folder / name).write_bytes(b"png")
        rows = files.screenshots_stream(stateful, str(folder)).select("target", "run_id", "name")
        out = S.new_runs_stream(rows, marks, open_runs=True)
        out.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()
        return sorted(r.name for r in stateful.read.parquet(str(tmp_path / "out")).collect())

    first = run(["patrol_room_000100_1.png", "patrol_room_000101_1.png", "patrol_a_b_000007_2.png", "patrol_room_000101_x.png", "other.png"])
    assert first == ["patrol_a_b_000007_2.png", "patrol_room_000101_1.png"]
    second = run(["patrol_room_000101_2.png", "patrol_room_000102_1.png", "patrol_room_000099_1.png", "patrol_gone_000005_1.png", "patrol_gone_000006_1.png"])
    assert sorted(set(second) - set(first)) == ["patrol_gone_000006_1.png", "patrol_room_000101_2.png", "patrol_room_000102_1.png"]
    third = run(["patrol_room_000101_3.png", "patrol_room_000102_2.png"])
    assert sorted(set(third) - set(second)) == ["patrol_room_000102_2.png"]


def test_a_bounded_cache_forgets_old_entries_when_it_is_full(stateful, tmp_path):
    """One lane over several micro-batches against the rule for batches, in plain Python."""
    most, age = 10, 50
    rnd = random.Random(2)
    parts, now = [], 0
    for _ in range(5):
        parts.append([(f"k{rnd.randrange(25)}", now + rnd.randrange(30)) for _ in range(12)])
        now += 40
    cache, want = {}, []
    for i, part in enumerate(parts):
        stateful.createDataFrame(part, "key string, t long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = stateful.readStream.schema("key string, t long").parquet(str(tmp_path / "in"))
        out = S.bounded_cache_stream(stream, most, age, lanes=1)
        out.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()
        fresh = []
        for key, t in part:
            if key not in cache:
                fresh.append((key, t))
            cache[key] = max(t, cache.get(key, t))
        newest = max(t for _, t in part)
        if len(cache) > most:
            cache = {k: t for k, t in cache.items() if t >= newest - age}
        want += [(*f, len(cache)) for f in fresh]
        young = sum(t >= newest - age for t in cache.values())
        assert len(cache) <= max(most, young)
    got = sorted(map(tuple, stateful.read.parquet(str(tmp_path / "out")).collect()))
    assert got == sorted(want) and i == 4


def test_late_rows_are_left_out_and_counted(spark, tmp_path):
    def add(rows):
        spark.createDataFrame(rows, "ms long, room_name string").select(F.timestamp_millis("ms").alias("ts"), "room_name").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("ts timestamp, room_name string").parquet(str(tmp_path / "in"))
        out = S.activity_stream(stream, "10 minutes", "1 hour")
        run = out.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start(str(tmp_path / "out"))
        run.awaitTermination()
        return S.late_rows(run)

    hour = 3600000
    assert add([(10, "a"), (20, "a"), (hour + 5, "b"), (3 * hour, "a")]) == 0
    assert add([(30, "a"), (40, "b"), (3 * hour + 1, "a")]) == 2  # one for each window that is closed
    assert add([(9 * hour, "a")]) == 0
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect()))
    assert got == [("a", 0, 2), ("a", 3 * hour, 2), ("b", hour, 1)]


def test_category_decisions(spark):
    from chatloom.operators.categories import category_positions

    pages = {
        "selected": [(10, "群聊"), (60, "one team"), (110, "other team")],
        "suggested": [(10, "搜索网络结果"), (60, "some words"), (110, "more words"), (160, "群获"), (210, "team")],
        "top": [(8, "some words"), (40, "群 聊"), (90, "team")],
        "item": [(10, "sidebar"), (50, "sidebar two"), (90, "群聊"), (131, "搜一搜 it"), (170, "team"), (210, "联系人"), (250, "person")],
        "none before the next": [(10, "sidebar"), (90, "群聊"), (130, "联系人"), (170, "person")],
        "noise": [(2, "群聊"), (70, "群聊"), (75, "x"), (120, "team")],
        "absent": [(10, "联系人"), (60, "person")],
    }
    rows = [(p, i, y, t) for p, lines in pages.items() for i, (y, t) in enumerate(lines)]
    got = {r.page: (r.category_y, r.down_count) for r in category_positions(spark.createDataFrame(rows, "page string, line int, y int, text string"), "群聊").collect()}
    assert got == {"selected": (10, 0), "suggested": (160, 3), "top": (40, 1), "item": (90, 3), "none before the next": (90, 1), "noise": (2, 0)}


class Kept:
    """A state variable in memory that counts what it is asked."""

    def __init__(self):
        self.value, self.asked = None, 0

    def exists(self):
        return self.value is not None

    def get(self):
        self.asked += 1
        return iter(self.value) if isinstance(self.value, list) else self.value

    def update(self, value):
        self.value = value

    def put(self, values):
        self.asked += len(values)
        self.value = list(values)

    def appendList(self, values):
        self.asked += len(values)
        self.value = [*(self.value or []), *values]

    def clear(self):
        self.value = None


class KeptMap(Kept):
    def __init__(self):
        super().__init__()
        self.value = {}

    def containsKey(self, key):
        self.asked += 1
        return key in self.value

    def getValue(self, key):
        self.asked += 1
        return self.value.get(key)

    def updateValue(self, key, value):
        self.asked += 1
        self.value[key] = value

    def removeKey(self, key):
        del self.value[key]

    def iterator(self):
        return iter(list(self.value.items()))


class Handle:
    """Gives states in memory; also the clock."""

    def __init__(self):
        self.states, self.timers, self.now = {}, set(), 1000

    def _state(self, name, kind=Kept):
        return self.states.setdefault(name, kind())

    def getValueState(self, name, schema, **_):
        return self._state(name)

    def getListState(self, name, schema, **_):
        return self._state(name)

    def getMapState(self, name, key, value, **_):
        return self._state(name, KeptMap)

    def registerTimer(self, due):
        self.timers.add(due)

    def deleteTimer(self, due):
        self.timers.discard(due)

    def getCurrentProcessingTimeInMs(self):
        return self.now


def test_a_bounded_cache_asks_its_state_once_for_a_key():
    import pandas as pd

    handle, cache = Handle(), S.BoundedCache(5, 50)
    cache.init(handle)
    rows = [(f"k{i % 7}", 1000 + (i * 37) % 40) for i in range(900)]
    parts = [pd.DataFrame(rows[a : a + 300], columns=["key", "t"]) for a in range(0, 900, 300)]
    (out,) = cache.handleInputRows((0,), iter(parts), handle)
    assert out.values.tolist() == [[f"k{i}", rows[i][1], 7] for i in range(7)]
    assert handle.states["entries"].value == {(f"k{i}",): (max(t for k, t in rows if k == f"k{i}"),) for i in range(7)}
    assert handle.states["entries"].asked == 14
    (out,) = cache.handleInputRows((0,), iter([pd.DataFrame([("k1", 5000), ("new", 4999), ("k1", 4000)], columns=["key", "t"])]), handle)
    assert out.values.tolist() == [["new", 4999, 2]] and handle.states["entries"].value == {("k1",): (5000,), ("new",): (4999,)}
    small = list(S.times_by_key(iter(parts), most=3))
    assert len(small) == 3 and all(len(m) == 7 for m in small)


def test_a_queue_gives_many_batches_at_a_time():
    import pandas as pd

    handle, queue = Handle(), L.SizeOrTimeQueue(10, 200)
    queue.init(handle)
    order = random.Random(5).sample(range(25_004), 25_004)
    rows = pd.DataFrame({"id": order, "payload": [None if i % 9 == 0 else f"p{i}" for i in order]})
    out = list(queue.handleInputRows(("q",), iter([rows[:9_000], rows[9_000:]]), handle))
    assert len(out) == 3 and handle.timers == {1200}
    handle.now = 1100
    out += queue.handleInputRows(("q",), iter([pd.DataFrame({"id": range(25_004, 25_013), "payload": "x"})]), handle)
    assert len(out) == 4 and handle.timers == {1300} and [r[0] for r in handle.states["waiting"].value] == [25_010, 25_011, 25_012]
    out += queue.handleExpiredTimer(("q",), handle, None)
    got = pd.concat(out)
    assert got["id"].tolist() == list(range(25_013)) and got["batch_no"].tolist() == [i // 10 for i in range(25_013)]
    assert got["by"].tolist() == ["size"] * 25_010 + ["time"] * 3 and set(got["queue"]) == {"q"}
    assert [p for i, p in zip(got["id"], got["payload"]) if i < 25_004 and i % 9 == 0 and p is not None] == []
    assert got["payload"].tolist()[25_003:25_006] == ["p25003", "x", "x"] and not handle.states["waiting"].exists()


def test_rows_that_wait_go_to_the_state_in_packs():
    import pandas as pd

    def post(name, payload, attempt):
        if attempt <= int(payload):
            raise ConnectionError

    handle, lane = Handle(), L.Delivery(post, base_ms=100)
    lane.init(handle)
    rows = pd.DataFrame({"id": [str(i) for i in range(6_000)], "payload": [str(i % 6) for i in range(6_000)]})
    out = list(lane.handleInputRows((0,), iter([rows[:3_000], rows[3_000:]]), handle))
    handle.now += 50
    out += lane.handleInputRows((0,), iter([pd.DataFrame({"id": ["late"], "payload": ["1"]})]), handle)
    while handle.timers:
        handle.now = min(handle.timers)
        handle.timers.discard(handle.now)
        out += lane.handleExpiredTimer((0,), handle, None)
    got = pd.concat(out)
    want = {str(i): (L.DELIVERED if i % 6 <= 3 else L.FAILED, min(i % 6 + 1, 4)) for i in range(6_000)} | {"late": (L.DELIVERED, 2)}
    assert len(got) == 6_001 and {i: (o, n) for i, o, n in got[["id", "outcome", "attempts"]].values.tolist()} == want
    assert not handle.states["waiting"].exists() and handle.states["waiting"].asked < 30
