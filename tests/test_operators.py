"""Operators against naive Python on small and random inputs."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from chatloom.operators import batching as B
from chatloom.operators import dedup as D
from chatloom.operators import messages as M
from chatloom.operators import states as S
from chatloom.operators import vlm_json as V
from chatloom.operators import watermark as K
from chatloom.sources import api, files


def test_limits():
    assert [M.as_limit(v, 7) for v in (None, "", "0", "x", "12abc", 5, "-1")] == [7, 7, 7, 7, 12, 5, None]


def test_api_refuses_what_is_no_number(spark):
    m = spark.createDataFrame([], "id long, room_name string, timestamp long, msg_index int")
    with pytest.raises(ValueError):
        api.get_messages(m, since="soon")
    with pytest.raises(ValueError):
        api.patrol_settings(interval=10)


def naive_batches(n):
    """Batch ranges of five with one overlapping, each after the first one longer."""
    out, k = [], 0
    while True:
        if k == 0:
            out.append((0, min(5, n)))
        elif (k == 1 and n > 5) or (k >= 2 and n > 4 * k + 2):
            out.append((4 * k, min(4 * k + 6, n)))
        else:
            return out
        k += 1


def test_overlapping_batches(spark):
    sizes = [1, 4, 5, 6, 7, 9, 10, 11, 12, 15, 23]
    rows = [(n, i) for n in sizes for i in range(n)]
    got = B.overlapping_batches(spark.createDataFrame(rows, "g int, x int"), "g", "x").collect()
    for n in sizes:
        mine = {}
        for r in got:
            if r.g == n:
                mine.setdefault(r.batch_no, []).append(r.i)
        assert {k: (min(v), max(v) + 1) for k, v in mine.items()} == dict(enumerate(naive_batches(n))), n


def test_seen_cache(spark):
    rnd = random.Random(1)
    rows = [("a", t) for t in (0, 3000, 5000, 9999, 10001)] + [("b", rnd.randrange(60000)) for _ in range(300)]
    got = D.seen_cache(spark.createDataFrame(rows, "k string, t long"), ["k"], "t", 5000).collect()
    want = []
    for k in ("a", "b"):
        anchor = None
        for t in sorted(t for key, t in rows if key == k):
            if anchor is None or t - anchor >= 5000:
                anchor = t
                want.append((k, t))
    assert sorted((r.k, r.t) for r in got) == sorted(want)
    assert [t for k, t in sorted(want) if k == "a"] == [0, 5000, 10001]


def test_rate_limit(spark):
    rows = [("a", t * 1000) for t in (10, 20, 30, 69, 70)]
    got = S.rate_limit(spark.createDataFrame(rows, "k string, t long"), "k", "t", 2, 60000).collect()
    assert [r.allowed for r in sorted(got, key=lambda r: r.t)] == [True, True, False, False, True]


def test_backoff(spark):
    got = S.backoff(spark.createDataFrame([("a", i, True) for i in range(5)], "k string, i int, idle boolean"), "k", "i", "idle").collect()
    got = sorted(got, key=lambda r: r.i)
    assert [r.level for r in got] == [1, 2, 3, 0, 1] and [r.multiplier for r in got] == [2, 3, 4, 1, 2]


def test_stuck(spark):
    rows = [("t", i, h) for i, h in enumerate("abbbbc")]
    got = K.before_stuck(spark.createDataFrame(rows, "g string, i int, h string"), "g", "i", "h").collect()
    assert sorted(r.i for r in got) == [0, 1, 2, 3, 4]


def test_dedup_batch(spark):
    rows = [(0, 0, None, "Hello World", None), (0, 1, "A", "helloworld", "14:27"), (0, 2, "B", "  ", "15:00"), (0, 3, "", "x", ""), (0, 4, "C", None, "1:00")]
    got = sorted(D.dedup_batch(spark.createDataFrame(rows, "batch int, idx int, sender string, content string, time string")).collect(), key=lambda r: r.idx)
    assert [(r.idx, r.sender, r.content, r.time) for r in got] == [(0, "A", "Hello World", "14:27"), (3, None, "x", "14:27")]


def test_fill_and_tokens(spark):
    rows = [(0, 0, None), (0, 1, ""), (0, 2, "14:27"), (1, 0, "14:27"), (1, 1, "2月17日 14:27"), (1, 2, "15:00"), (2, 0, None), (3, 0, "现在")]
    df = spark.createDataFrame(rows, "batch int, idx int, time string")
    got = {(r.batch, r.idx): r.time for r in D.normalize_tokens(D.fill_times(df)).collect()}
    assert got == {(0, 0): "14:27", (0, 1): "14:27", (0, 2): "14:27", (1, 0): "2月17日 14:27", (1, 1): "2月17日 14:27", (1, 2): "15:00", (2, 0): None, (3, 0): "现在"}


def test_ingest_equals_a_loop(spark):
    rnd = random.Random(3)
    as_of = 1_000_000
    existing = [(f"r{rnd.randrange(2)}", f"c{rnd.randrange(4)}", as_of - rnd.randrange(120000)) for _ in range(6)]
    batch = [(i, f"r{rnd.randrange(3)}", f"s{rnd.randrange(2)}", f"C {rnd.randrange(6)}", as_of - rnd.randrange(120000)) for i in range(40)]
    seen, stored, want = set(), list(existing), []
    for i, room, sender, content, t in batch:
        if "r" not in room or (key := (room, sender, content[:50])) in seen:
            continue
        seen.add(key)
        norm = content.replace(" ", "").lower()
        if any(r == room and c.replace(" ", "").lower() == norm and ts > as_of - 60000 for r, c, ts in stored):
            continue
        stored.append((room, content, t))
        want.append(i)
    got = D.ingest(spark.createDataFrame(batch, "idx int, room_name string, sender string, content string, timestamp long"), spark.createDataFrame(existing, "room_name string, content string, timestamp long"), as_of, ["r"])
    # a row that the cache or the table drops can't stand for a later one
    assert sorted(r.idx for r in got.collect()) == want


def test_ingest_compares_the_parts_of_a_key(spark):
    """Names with a separator and missing senders are senders of their own."""
    rows = [(0, "a:b", "c", "one"), (1, "a", "b:c", "one"), (2, "r", None, "x:y two"), (3, "r", "x", "y two"), (4, "r", None, "x:y two"), (5, "r", None, "z")]
    batch = spark.createDataFrame([(*r, 5) for r in rows], "idx int, room_name string, sender string, content string, timestamp long")
    none = spark.createDataFrame([], "room_name string, content string, timestamp long")
    assert sorted(r.idx for r in D.ingest(batch, none, 10, []).collect()) == [0, 1, 2, 3, 5]


def test_one_queue_is_numbered_over_its_ranges(spark):
    rows = spark.range(0, 1000, 3).repartition(7)
    got = {r.id: r.batch_no for r in B.sink_batches(rows, "id", 10).collect()}
    assert got == {i: n // 10 for n, i in enumerate(range(0, 1000, 3))}
    assert B.sink_batches(rows.limit(0), "id", 10).count() == 0


def test_ema_falls_back_where_nothing_was_found(spark):
    rows = [("a", 1, None, 1.0), ("a", 2, 200.0, 1.0), ("a", 3, None, 0.0), ("a", 4, 100.0, 0.1), ("b", 1, 10.0, 1.0), ("b", 2, None, 1.0)]
    df = spark.createDataFrame(rows, "k string, i int, v double, c double")
    got = {r.k: r.smoothed for r in S.ema(df, "k", "i", "v", "c", fallback=320.0).collect()}
    assert got == {"a": 282.0, "b": 41.0}  # 320, round(320 * 0.65 + 200 * 0.35) = 278, round(278 * 0.9 + 32), skipped


def test_webhook_sends_full_batches_and_the_rest(spark, tmp_path):
    from chatloom.streaming.stateful import webhook_query

    (tmp_path / "posts").mkdir()
    m = spark.range(25).select("id", *(F.lit(c).alias(c) for _, c in M.PAYLOAD))
    m.select("id", M.webhook_payload().alias("payload")).coalesce(1).write.parquet(str(tmp_path / "in"))
    folder = str(tmp_path / "posts")

    def post(epoch: int, payloads: list[str]) -> None:
        import json
        import uuid

        with open(f"{folder}/{epoch}-{uuid.uuid4().hex}", "w") as f:
            json.dump(payloads, f)

    stream = spark.readStream.schema("id long, payload string").parquet(str(tmp_path / "in"))
    webhook_query(stream, 10, None, post, str(tmp_path / "check")).awaitTermination()
    import json

    posts = [json.loads(p.read_text()) for p in (tmp_path / "posts").iterdir()]
    assert sorted(map(len, posts)) == [5, 10, 10] and set(json.loads(posts[0][0])) == {name for name, _ in M.PAYLOAD}


def test_run_watermarks_advance_over_micro_batches(spark, tmp_path):
    from chatloom.streaming import stateful

    stateful.use_rocksdb(spark)
    batches = [[("a", 1), ("a", 3), ("b", 7)], [("a", 2), ("a", 3), ("a", 4), ("c", 1)], [("a", 4), ("b", 8), ("b", 6)]]
    got = []
    for i, rows in enumerate(batches):  # one run of the stream for each, so that the state comes from its checkpoint
        spark.createDataFrame([(t, r, f"{i}-{t}-{r}") for t, r in rows], "target string, run_id long, name string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("target string, run_id long, name string").parquet(str(tmp_path / "in"))
        out = stateful.new_runs_stream(stream).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start(str(tmp_path / "out"))
        out.awaitTermination()
        got.append(sorted(r.name for r in spark.read.parquet(str(tmp_path / "out")).collect()))
    first, second, third = ["0-a-1", "0-a-3", "0-b-7"], ["1-a-4", "1-c-1"], ["2-b-8"]
    assert got == [first, sorted(first + second), sorted(first + second + third)]


def test_forgotten_keys_of_the_seen_cache(spark, tmp_path):
    from chatloom.streaming import stateful

    stateful.use_rocksdb(spark)
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    with pytest.raises(ValueError):
        stateful.SeenCache(5000, 100)
    found = []
    for ttl, name in ((1, "short"), (3_600_000, "long")):
        for i, t in enumerate((1000, 1001)):
            spark.createDataFrame([("k", t)], "key string, t long").coalesce(1).write.mode("append").parquet(str(tmp_path / f"in-{name}"))
            stream = spark.readStream.schema("key string, t long").parquet(str(tmp_path / f"in-{name}"))
            kept = stateful.seen_cache_stream(stream, 1 if ttl == 1 else 5000, ttl)
            kept.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / f"check-{name}")).trigger(availableNow=True).start(str(tmp_path / f"out-{name}")).awaitTermination(60)
        found.append(spark.read.parquet(str(tmp_path / f"out-{name}")).count())
    spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")
    assert found == [2, 1]


def test_saved_checkpoints_and_status(spark, tmp_path):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "target string, epochMs long")
    new = spark.createDataFrame([("b", 3), ("c", 4)], "target string, epochMs long")
    files.saved_checkpoints(old, new, str(tmp_path / "c"))
    assert sorted((r.target, r.epochMs) for r in files.checkpoints(spark, str(tmp_path / "c")).collect()) == [("a", 1), ("b", 3), ("c", 4)]
    row = api.patrol_status(spark.createDataFrame([(3, 1)], "collected long, targets long"), True, {"interval": 5000, "targets": ["x"]}).first()
    assert (row.running, row.interval, row.targets, row.counters.collected) == (True, 5000, ["x"], 3)


def test_the_message_view(spark):
    from chatloom.sources import messages as source

    for rows in (source.messages_from_events, source.messages_from_conversations, source.messages_from_documents):
        source.message_view(rows(spark, "/root/testdata/sf0.001"), "m")
        assert spark.table("m").schema.names == source.MESSAGE.names and spark.sql("SELECT created_at, raw_data FROM m WHERE timestamp > 0").count() > 0


def test_reads(spark):
    m = spark.createDataFrame([(1, "r", "u", "x", 5, 0), (2, "r", "u", "x", 6, 0), (3, "s", "u", "x", 7, 0)], "id long, room_name string, talker_name string, content string, timestamp long, msg_index int")
    assert api.get_count(m).first()["count"] == 3 and len(api.get_status(m, "2").collect()) == 2
    assert sorted(r.room_name for r in api.get_rooms(m).collect()) == ["r", "s"]


def test_recover():
    body = '{"roomName":"R","messages":[{"index":0}]}'
    cases = [(body, 1), (f"x\n```json\n{body}\n```", 2), (f"see {body} there", 3), ('{"messages":[{"index":0}], "x', 4), ('{"messages":[{"index":0', 5), ("", 5), (None, 5), ('{"a":1} trailing', 3)]
    assert [V.recover(text)[0] for text, _ in cases] == [step for _, step in cases]
    assert V.recover('{"a":1} trailing')[1] == '{"a":1}'


def test_screenshot_names(spark):
    names = ["patrol_n8n测试群_123456_1.png", "patrol_a_b_123456_12.png", "patrol_x_12345_1.png"]
    got = B.parse_shots(spark.createDataFrame([(n,) for n in names], "name string")).collect()
    assert [(r.run_id, r.shot) for r in got] == [(123456, 1), (123456, 12)]


def test_files(spark, tmp_path):
    (tmp_path / "app.log").write_text("2024-01-15 21:30:45 [INFO]: one\n\njunk\n2024-01-15 21:30:46 [ERROR]: two\n")
    got = files.log_records(spark, str(tmp_path / "app.log"), last=2).collect()
    assert [(r.level, r.message) for r in got] == [("error", "two")]
    (tmp_path / ".settings").write_text("# c\nA=1\nB=x=y\nA=2\n")
    (tmp_path / "env.txt").write_text("# c\nA=1\nB=x=y\nA=2\n")
    assert sorted(map(tuple, files.settings(spark, str(tmp_path / "env.txt")).collect())) == [("A", "2"), ("B", "x=y")]


def test_y_groups(spark):
    rows = [("p", 10, 0, "2"), ("p", 12, 10, "11"), ("p", 16, 20, "20:54"), ("p", 40, 0, "x")]
    got = S.y_groups(spark.createDataFrame(rows, "page string, y int, x int, text string")).orderBy("line").collect()
    assert [r.text for r in got] == ["21120:54", "x"]


def test_empty_tables(spark):
    none = spark.createDataFrame([], "batch int, idx int, sender string, content string, time string")
    assert D.dedup_batch(none).count() == 0
    assert S.rate_limit(spark.createDataFrame([], "k string, t long"), "k", "t", 2, 1000).count() == 0
    assert M.query_messages(spark.createDataFrame([], "id long, room_name string, timestamp long, msg_index int")).filter(F.lit(True)).count() == 0


def test_token_recovery(spark):
    from chatloom.operators.ocr import line_times
    from chatloom.sources.messages import AS_OF_MS

    lines = [(0, ["2", "11", "20:54"]), (1, ["2", "月", "11", "号", "20:54"]), (2, ["21120:54"]), (3, ["x"]), (4, [])]
    got = line_times(spark.createDataFrame(lines, "i int, tokens array<string>"), AS_OF_MS).orderBy("i").collect()
    assert [r.time_text for r in got] == ["2月11日20:54", "2月11号20:54", None, None, None]


def test_folds_carry_their_state_over_small_batches_and_collect_no_key(spark):
    """Dense keys over many Arrow batches, with ties, nulls and a null key, against loops."""
    rnd = random.Random(8)
    rows = [(rnd.choice(("a", "b", None)), rnd.randrange(40000), float(rnd.randrange(90)), rnd.random()) for _ in range(3000)]
    rows += [("a", None, 1.0, 0.9), ("none", 5, None, 0.1), ("null", 5, None, 0.9)]
    df = spark.createDataFrame(rows, "k string, t long, v double, c double").repartition(5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        limited, seen, smooth, upper = S.rate_limit(df, "k", "t", 3, 500), D.seen_cache(df, ["k"], "t", 500), S.ema(df, "k", "t", "v", "c"), S.upper_quartile(df, ["k"], "v", 40.0)
        got = [sorted(map(tuple, x.collect()), key=repr) for x in (limited, seen, smooth, upper)]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = [[], [], [], []]
    for k in {r[0] for r in rows}:
        mine = sorted((r[1:] for r in rows if r[0] == k), key=lambda r: [(x is not None, x or 0) for x in r])
        reset, count, anchor, s = None, 0, None, None
        for t, v, c in mine:
            if c >= 0.5:
                s = v if s is None else float((s * 0.65 + v * (1 - 0.65) + 0.5) // 1)
            if t is None:
                continue
            if reset is None or t >= reset:
                reset, count = t + 500, 0
            want[0].append((k, t, count < 3))
            count += count < 3
            if anchor is None or t - anchor >= 500:
                anchor = t
                want[1].append((k, t))
        want[2].append((k, s))
        values = sorted(v for _, v, _ in mine if v is not None)
        want[3].append((k, (values[len(values) * 3 // 4] if values else 0) or 40.0))
    assert got == [sorted(w, key=repr) for w in want]
    for x in (limited, seen, smooth, upper):
        assert "collect_list" not in x._jdf.queryExecution().toString()


def test_known_contents_are_normalised_once_before_the_join(spark):
    from chatloom.operators.dedup import known_in_room

    rows = [(1, "r", "A b", 95), (2, "r", None, 95), (3, None, "ab", 95), (4, "r", "c", 95), (5, "s", "ab", 95)]
    known = [(6, "r", "a　B", 95), (7, "r", "", 95), (8, None, "ab", 95), (9, "r", "c", 40), (10, "s", "b", 95)]
    batch, existing = (spark.createDataFrame(x, "id int, room_name string, content string, timestamp long") for x in (rows, known))
    for how, want in (("left_semi", [1, 2]), ("left_anti", [3, 4, 5])):
        out = known_in_room(batch, existing, 100, 50, how)
        assert out.columns == batch.columns and sorted(r.id for r in out.collect()) == want
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").selectExpr("doc_id AS id", "source AS room_name", "text AS content", "doc_id AS timestamp")
    out = known_in_room(table.hint("merge"), table, 100).select("id")
    plan = out._jdf.queryExecution().sparkPlan().toString().splitlines()
    assert any("Join" in line for line in plan)
    assert not any("regexp_replace" in line for line in plan if "Project" not in line)
