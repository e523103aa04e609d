"""Streaming queries run to completion over the event table; their rows equal those of the batch operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatloom.operators.batching import parse_shots
from chatloom.plans.batches import GOOD_SHOTS_SQL, shots, shots_of
from chatloom.plans.dedup import INGEST_SQL, NOTES_NOW_MS, NOTES_WITHIN_MS, notes
from chatloom.plans.registry import query
from chatloom.session import shared_path
from chatloom.sources.messages import event_millis
from chatloom.streaming import delivery as L
from chatloom.streaming import ingest as I
from chatloom.streaming import stateful as S


def _events_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)


def drained(stream: DataFrame, name: str) -> DataFrame:
    """Run a stream over what is there now and read what it wrote."""
    spark = stream.sparkSession
    out = shared_path(spark, name)
    done = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", shared_path(spark, f"{name}-checkpoint")).trigger(availableNow=True).start(out)
    done.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


@query("""WITH RECURSIVE r AS (SELECT event_type AS key, epoch_us(ts) // 1000 AS t, row_number() OVER (PARTITION BY event_type ORDER BY ts) AS n FROM events),
f AS (SELECT key, t, n, t AS anchor, true AS kept FROM r WHERE n = 1
  UNION ALL SELECT r.key, r.t, r.n, CASE WHEN r.t - f.anchor >= 600000 THEN r.t ELSE f.anchor END, r.t - f.anchor >= 600000 FROM f JOIN r ON r.key = f.key AND r.n = f.n + 1)
SELECT key, t FROM f WHERE kept""")
def q_seen_cache_stream(spark, sf_dir):
    S.use_rocksdb(spark)
    rows = _events_stream(spark, sf_dir).select(F.col("event_type").alias("key"), event_millis().alias("t"))
    return drained(S.seen_cache_stream(rows, 600000), "seen-cache")


@query("""WITH RECURSIVE r AS (SELECT event_type AS key, epoch_us(ts) // 1000 AS t, row_number() OVER (PARTITION BY event_type ORDER BY ts) AS n FROM events),
f AS (SELECT key, t, n, t + 1800000 AS reset, 1 AS c, true AS allowed FROM r WHERE n = 1
  UNION ALL SELECT r.key, r.t, r.n, CASE WHEN r.t >= f.reset THEN r.t + 1800000 ELSE f.reset END, CASE WHEN r.t >= f.reset THEN 1 WHEN f.c < 2 THEN f.c + 1 ELSE f.c END, r.t >= f.reset OR f.c < 2
  FROM f JOIN r ON r.key = f.key AND r.n = f.n + 1)
SELECT key, t, allowed FROM f""")
def q_rate_limit_stream(spark, sf_dir):
    S.use_rocksdb(spark)
    rows = _events_stream(spark, sf_dir).select(F.col("event_type").alias("key"), event_millis().alias("t"))
    return drained(S.rate_limit_stream(rows, 2, 1800000), "rate-limit")


@query(f"""WITH w AS (SELECT target, CAST(quantile_disc(run_id, 0.5) AS BIGINT) AS last_run FROM {GOOD_SHOTS_SQL} WHERE target <> 'view' GROUP BY target)
SELECT g.target, run_id, name FROM {GOOD_SHOTS_SQL} g LEFT JOIN w USING (target) WHERE last_run IS NULL OR run_id > last_run""")
def q_new_runs_stream(spark, sf_dir):
    S.use_rocksdb(spark)
    known = parse_shots(shots(spark, sf_dir)).filter("target <> 'view'")
    marks = known.groupBy("target").agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY run_id)").cast("long").alias("last_run"))
    rows = parse_shots(shots_of(_events_stream(spark, sf_dir))).select("target", "run_id", "name")
    return drained(S.new_runs_stream(rows, marks), "new-runs")


@query(INGEST_SQL)
def q_ingest_stream(spark, sf_dir):
    """Four slices come in one after the other, each an epoch or more of the stream."""
    n = notes(spark, sf_dir)
    batch, existing = n.filter("idx % 2 = 1"), n.filter("idx % 2 = 0")
    store, slices, checkpoint = I.open_store(spark, shared_path(spark, "ingest-store")), shared_path(spark, "ingest-slices"), shared_path(spark, "ingest-checkpoint")
    low, high = batch.agg(F.min("idx"), F.max("idx")).first()
    for i in range(4 if low is not None else 0):
        part = batch.filter(F.floor((F.col("idx") - low) * 4 / (high - low + 1)) == i)
        part.write.mode("append").parquet(slices)
        stream = spark.readStream.schema(batch.schema).parquet(slices)
        sink = I.ingest_sink(store, existing, NOTES_NOW_MS, ["i"], NOTES_WITHIN_MS)
        stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return I.stored(spark, store).drop("epoch")


_OUTCOME_SQL = "CASE WHEN event_id % 6 <= 3 THEN 'delivered' ELSE 'failed' END AS outcome, CAST(least(event_id % 6 + 1, 4) AS INT) AS attempts"


@query(f"SELECT event_id, {_OUTCOME_SQL}, CAST(1000 * (CAST(pow(2, least(event_id % 6, 3)) AS BIGINT) - 1) AS BIGINT) AS waited_ms FROM events")
def q_delivery(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id")
    return L.delivery_outcomes(e, F.col("event_id") % 6)


@query("""SELECT event_id, CAST(attempt AS INT) AS attempt, CAST(1000 * (CAST(pow(2, attempt - 1) AS BIGINT) - 1) AS BIGINT) AS at_ms, attempt > event_id % 6 AS arrived
FROM (SELECT event_id, unnest(range(1, least(event_id % 6 + 1, 4) + 1)) AS attempt FROM events)""")
def q_delivery_attempts(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id")
    return L.delivery_attempts(e, F.col("event_id") % 6)


def _flaky(name: str, payload: str, attempt: int) -> None:
    """An endpoint whose first attempts fail, as many as the payload says."""
    if attempt <= int(payload):
        raise ConnectionError(name)


def _timed(stream: DataFrame, name: str, longest_wait_ms: int) -> DataFrame:
    """Run a stream with timers until it has nothing left to wait for, and read what it wrote."""
    spark = stream.sparkSession
    out = shared_path(spark, name)
    started = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", shared_path(spark, f"{name}-checkpoint")).trigger(processingTime="100 milliseconds").start(out)
    L.settled(started, longest_wait_ms)
    return spark.read.schema(stream.schema).parquet(out)


@query(f"SELECT CAST(event_id AS VARCHAR) AS id, {_OUTCOME_SQL} FROM events")
def q_delivery_stream(spark, sf_dir):
    S.use_rocksdb(spark)
    rows = _events_stream(spark, sf_dir).select(F.col("event_id").cast("string").alias("id"), (F.col("event_id") % 6).cast("string").alias("payload"))
    return _timed(L.deliveries(rows, _flaky, base_ms=50), "delivery", 200)


@query("""SELECT event_type AS queue, event_id AS id, (nth - 1) // 10 AS batch_no, CASE WHEN (nth - 1) // 10 = n // 10 THEN 'time' ELSE 'size' END AS by
FROM (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS nth, count(*) OVER (PARTITION BY event_type) AS n FROM events)""")
def q_webhook_queue_stream(spark, sf_dir):
    S.use_rocksdb(spark)
    rows = _events_stream(spark, sf_dir).select(F.col("event_type").alias("queue"), F.col("event_id").alias("id"), F.col("props").alias("payload"))
    return _timed(L.queued(rows, 10, 200), "queue", 200).drop("payload")


@query("SELECT DISTINCT 'user_' || user_id AS key FROM events")
def q_bounded_cache_stream(spark, sf_dir):
    S.use_rocksdb(spark)
    rows = _events_stream(spark, sf_dir).select(F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("key"), event_millis().alias("t"))
    return drained(S.bounded_cache_stream(rows), "bounded-cache").select("key")


def _timed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events_stream(spark, sf_dir).withColumn("ts", F.timestamp_millis(event_millis()))


@query("""WITH w AS (SELECT event_type AS room_name, epoch_us(ts) // 1000 // 3600000 * 3600000 AS start_ms, count(*) AS n FROM events GROUP BY 1, 2)
SELECT room_name, start_ms, n FROM w WHERE start_ms + 3600000 <= (SELECT max(epoch_us(ts) // 1000) FROM events) - 600000""")
def q_activity_stream(spark, sf_dir):
    rows = _timed_events(spark, sf_dir).select("ts", F.col("event_type").alias("room_name"))
    return drained(S.activity_stream(rows), "activity")


@query("""SELECT a.user_id AS key, a.event_id AS cause, b.event_id AS effect FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'view' AND b.event_type = 'purchase'
AND epoch_us(b.ts) // 1000 BETWEEN epoch_us(a.ts) // 1000 AND epoch_us(a.ts) // 1000 + 21600000""")
def q_followed_stream(spark, sf_dir):
    rows = _timed_events(spark, sf_dir).select(F.col("user_id").alias("key"), F.col("event_id").alias("id"), "ts", "event_type")
    return drained(S.followed_stream(rows.filter("event_type = 'view'"), rows.filter("event_type = 'purchase'"), "6 hours"), "followed")
