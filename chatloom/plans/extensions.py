"""Extensions: reports that the original leaves to others, here as plain aggregates."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chatloom.plans.registry import query
from chatloom.sources.messages import EVENTS_SQL, messages_from_events

_DAY_SQL = "timestamp // 86400000"


@query(f"SELECT {_DAY_SQL} AS day, talker_name, count(*) AS n FROM {EVENTS_SQL} GROUP BY 1, 2")
def q_talker_activity(spark, sf_dir):
    m = messages_from_events(spark, sf_dir)
    return m.groupBy(F.expr("timestamp div 86400000").alias("day"), "talker_name").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT room_name, talker_name, n, rank() OVER (PARTITION BY room_name ORDER BY n DESC) AS place FROM (SELECT room_name, talker_name, count(*) AS n FROM {EVENTS_SQL} GROUP BY 1, 2)")
def q_participant_rank(spark, sf_dir):
    n = messages_from_events(spark, sf_dir).groupBy("room_name", "talker_name").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("place", F.rank().over(W.partitionBy("room_name").orderBy(F.desc("n"))))


@query(f"""WITH g AS (SELECT talker_name, timestamp, CASE WHEN timestamp - lag(timestamp) OVER (PARTITION BY talker_name ORDER BY timestamp) <= 1800000 THEN 0 ELSE 1 END AS fresh FROM {EVENTS_SQL}),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY talker_name ORDER BY timestamp ROWS UNBOUNDED PRECEDING) AS session FROM g)
SELECT talker_name, min(timestamp) AS start_ms, max(timestamp) AS last_ms, count(*) AS n FROM s GROUP BY talker_name, session""")
def q_sessions(spark, sf_dir):
    m = messages_from_events(spark, sf_dir).select("talker_name", "timestamp")
    s = m.groupBy("talker_name", F.session_window(F.timestamp_millis("timestamp"), "30 minutes")).agg(F.min("timestamp").alias("start_ms"), F.max("timestamp").alias("last_ms"), F.count(F.lit(1)).alias("n"))
    return s.drop("session_window")


@query(f"SELECT room_name, {_DAY_SQL} AS day, count(*) AS n, grouping(room_name) AS all_rooms FROM {EVENTS_SQL} GROUP BY CUBE (room_name, {_DAY_SQL})")
def q_room_day_cube(spark, sf_dir):
    m = messages_from_events(spark, sf_dir).withColumn("day", F.expr("timestamp div 86400000"))
    return m.cube("room_name", "day").agg(F.count(F.lit(1)).alias("n"), F.grouping("room_name").cast("long").alias("all_rooms"))
