"""Queries over runs, batches and watermarks."""

from __future__ import annotations

from pyspark.sql import functions as F

from chatloom.operators import batching as B
from chatloom.operators import watermark as M
from chatloom.plans.registry import query
from chatloom.sources.messages import event_millis

SHOTS_SQL = """(SELECT 'patrol_' || event_type || '_' || lpad(CAST(user_id AS VARCHAR), CASE WHEN event_id % 10 = 0 THEN 5 ELSE 6 END, '0') || '_' || event_id % 40 || CASE WHEN event_id % 17 = 0 THEN '.jpg' ELSE '.png' END AS name,
  event_type AS target, epoch_us(ts) // 1000 AS mtime FROM events)"""
GOOD_SHOTS_SQL = f"(SELECT *, CAST(regexp_extract(name, 'patrol_.+_([0-9]{{6}})_([0-9]+)\\.png$', 1) AS BIGINT) AS run_id, CAST(regexp_extract(name, 'patrol_.+_([0-9]{{6}})_([0-9]+)\\.png$', 2) AS BIGINT) AS shot FROM {SHOTS_SQL} WHERE regexp_matches(name, '^patrol_.+_([0-9]{{6}})_([0-9]+)\\.png$'))"


def shots(spark, sf_dir):
    return shots_of(spark.read.parquet(f"{sf_dir}/events.parquet"))


def shots_of(e):
    name = F.concat(F.lit("patrol_"), "event_type", F.lit("_"), F.lpad(F.col("user_id").cast("string"), 6, "0"), F.lit("_"), (F.col("event_id") % 40).cast("string"), F.when(F.col("event_id") % 17 == 0, ".jpg").otherwise(".png"))
    short = F.concat(F.lit("patrol_"), "event_type", F.lit("_"), F.lpad(F.col("user_id").cast("string"), 5, "0"), F.lit("_"), (F.col("event_id") % 40).cast("string"), F.when(F.col("event_id") % 17 == 0, ".jpg").otherwise(".png"))
    return e.select(F.when(F.col("event_id") % 10 == 0, short).otherwise(name).alias("name"), F.col("event_type").alias("target"), event_millis().alias("mtime"))


@query(f"SELECT name, run_id, shot FROM {GOOD_SHOTS_SQL}")
def q_filename_parse(spark, sf_dir):
    return B.parse_shots(shots(spark, sf_dir)).select("name", "run_id", "shot")


@query(f"""WITH w AS (SELECT target, CAST(quantile_disc(run_id, 0.5) AS BIGINT) AS last_run FROM {GOOD_SHOTS_SQL} WHERE target <> 'view' GROUP BY target)
SELECT name, g.target, run_id, shot FROM {GOOD_SHOTS_SQL} g LEFT JOIN w USING (target) WHERE last_run IS NULL OR run_id > last_run""")
def q_watermark_runs(spark, sf_dir):
    good = B.parse_shots(shots(spark, sf_dir))
    marks = good.filter("target <> 'view'").groupBy("target").agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY run_id)").cast("long").alias("last_run"))
    return B.new_runs(good, marks).select("name", "target", "run_id", "shot")


@query(f"SELECT target, run_id, array_to_string(list(name ORDER BY shot DESC, mtime, name), ',') AS names, count(*) AS n FROM {GOOD_SHOTS_SQL} GROUP BY target, run_id")
def q_run_lists(spark, sf_dir):
    return B.runs_old_to_new(B.parse_shots(shots(spark, sf_dir))).select("target", "run_id", F.array_join("names", ",").alias("names"), "n")


@query("""WITH r AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events),
k AS (SELECT *, unnest(range(0, n // 4 + 2)) AS batch_no FROM r)
SELECT event_id, user_id, i, batch_no FROM k WHERE (batch_no = 0 AND i < 5) OR (batch_no >= 1 AND i >= 4 * batch_no AND i < 4 * batch_no + 6 AND ((batch_no = 1 AND n > 5) OR (batch_no >= 2 AND n > 4 * batch_no + 2)))""")
def q_overlap_batches(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id")
    return B.overlapping_batches(e, "user_id", "event_id").select("event_id", "user_id", "i", "batch_no")


@query("SELECT event_id, event_type, (row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1) // 10 AS batch_no FROM events")
def q_webhook_batches(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "event_type")
    return B.sink_batches(e, "event_id", 10, within="event_type")


@query("SELECT event_id, (row_number() OVER (ORDER BY event_id) - 1) // 10 AS batch_no FROM events")
def q_webhook_queue(spark, sf_dir):
    return B.sink_batches(spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id"), "event_id", 10)


@query("SELECT r_regionkey, unnest([1000, 2000, 4000])::BIGINT AS delay_ms, unnest([0, 1, 2]) AS attempt FROM region")
def q_retry_schedule(spark, sf_dir):
    r = spark.read.parquet(f"{sf_dir}/region.parquet")
    return r.select("r_regionkey", F.posexplode(B.retry_delays()).alias("attempt", "delay_ms"))


_STAMPS_SQL = "(SELECT event_type AS target, (30 - event_id * 30 // (SELECT count(*) FROM events)) AS shot, event_id AS pos, (epoch_us(ts) // 60000000) * 60000 AS epoch_ms FROM events)"


def stamps(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    n = e.agg(F.count(F.lit(1)).alias("n"))  # one row
    ms = F.floor(event_millis() / 60000) * 60000
    return e.join(F.broadcast(n)).select(F.col("event_type").alias("target"), (30 - F.expr("event_id * 30 div n")).alias("shot"), F.col("event_id").alias("pos"), ms.alias("epoch_ms"))


_RANGES = f"(SELECT target, shot, min(epoch_ms) AS min_epoch, max(epoch_ms) AS max_epoch FROM {_STAMPS_SQL} GROUP BY target, shot)"


@query(f"SELECT * FROM {_RANGES}")
def q_shot_minmax(spark, sf_dir):
    return M.shot_range(stamps(spark, sf_dir))


@query(f"""WITH m AS (SELECT target, 1705276800000 + hash_no * 86400000 AS watermark FROM (SELECT DISTINCT target, length(target) AS hash_no FROM {_STAMPS_SQL} WHERE target <> 'view')),
j AS (SELECT r.*, watermark, coalesce(min_epoch <= watermark, false) AS reached, coalesce(max_epoch > watermark, true) AS has_new FROM {_RANGES} r LEFT JOIN m USING (target)),
w AS (SELECT *, coalesce(max(reached::INT) OVER (PARTITION BY target ORDER BY shot ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, row_number() OVER (PARTITION BY target ORDER BY shot) AS nth FROM j)
SELECT target, shot, min_epoch, max_epoch, watermark, reached, has_new FROM w WHERE before = 0 AND nth <= CASE WHEN watermark IS NULL THEN 10 ELSE 50 END""")
def q_patrol_stop(spark, sf_dir):
    s = stamps(spark, sf_dir)
    marks = s.filter("target <> 'view'").select("target").distinct().select("target", (F.lit(1705276800000) + F.length("target") * 86400000).alias("watermark"))
    return M.patrol_stop(M.shot_range(s), marks)


@query(f"SELECT target, shot, pos, epoch_ms FROM {_STAMPS_SQL} QUALIFY row_number() OVER (PARTITION BY target ORDER BY epoch_ms DESC, pos) = 1")
def q_newest_ts(spark, sf_dir):
    return M.newest_stamp(stamps(spark, sf_dir))


@query(f"""SELECT coalesce(n.target, m.target) AS target, coalesce(n.e, m.watermark, 1706788800000) AS watermark
FROM (SELECT target, max(epoch_ms) AS e FROM {_STAMPS_SQL} WHERE target <> 'click' GROUP BY target) n FULL JOIN (SELECT DISTINCT target, CASE WHEN target = 'click' THEN 5 END AS watermark FROM {_STAMPS_SQL}) m ON n.target = m.target""")
def q_watermark_advance(spark, sf_dir):
    s = stamps(spark, sf_dir)
    marks = s.select("target").distinct().withColumn("watermark", F.when(F.col("target") == "click", F.lit(5).cast("long")))
    return M.advanced(marks, M.newest_stamp(s.filter("target <> 'click'")), 1706788800000)


@query("""WITH i AS (SELECT user_id, event_id, md5(CAST((event_id // 300) % 7 + (user_id + event_id) % 2 * (event_id % 3) AS VARCHAR)) AS h FROM events),
s AS (SELECT *, coalesce(h = lag(h) OVER (PARTITION BY user_id ORDER BY event_id), false) AS same FROM i),
g AS (SELECT *, sum(CASE WHEN same THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY event_id) AS island FROM s),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id, island ORDER BY event_id) - 1 AS run_length FROM g),
t AS (SELECT *, coalesce(max((run_length >= 3)::INT) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS stopped FROM r)
SELECT user_id, event_id, h, run_length FROM t WHERE stopped = 0""")
def q_stuck_cut(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    h = F.md5(F.expr("CAST((event_id div 300) % 7 + (user_id + event_id) % 2 * (event_id % 3) AS STRING)").cast("binary"))
    return M.before_stuck(e.select("user_id", "event_id", h.alias("h")), "user_id", "event_id", "h")
