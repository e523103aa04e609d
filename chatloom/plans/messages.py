"""Queries over the message table."""

from __future__ import annotations

from pyspark.sql import functions as F

from chatloom.operators import messages as M
from chatloom.plans.registry import query
from chatloom.sources.messages import EVENTS_SQL, messages_from_events

T0, T1 = 1704672000000, 1705276800000
ORDER = "timestamp DESC NULLS LAST, msg_index ASC NULLS FIRST, id"


@query(f"""SELECT room_name AS "roomName", talker_name AS "talkerName", content, timestamp
FROM (SELECT * FROM {EVENTS_SQL} ORDER BY {ORDER} LIMIT 200)""")
def q_status_feed(spark, sf_dir):
    return M.status_feed(messages_from_events(spark, sf_dir))


@query(f"SELECT * FROM {EVENTS_SQL} WHERE timestamp >= {T0} AND timestamp <= {T1} AND room_name = 'click' ORDER BY {ORDER} LIMIT 100")
def q_messages_filtered(spark, sf_dir):
    return M.query_messages(messages_from_events(spark, sf_dir), since=T0, until=T1, room="click", limit="100")


@query(f"SELECT * FROM {EVENTS_SQL} WHERE timestamp BETWEEN {T0} AND {T1} ORDER BY {ORDER} LIMIT 1000")
def q_time_range(spark, sf_dir):
    return M.in_time_range(messages_from_events(spark, sf_dir), T0, T1)


@query(f"SELECT * FROM {EVENTS_SQL} WHERE room_id = 'view' ORDER BY {ORDER} LIMIT 100 OFFSET 50")
def q_room_page(spark, sf_dir):
    return M.room_page(messages_from_events(spark, sf_dir), "view", 100, 50)


@query(f"SELECT * FROM {EVENTS_SQL} WHERE contains(room_name, 'ic') OR contains(room_name, 'ur')")
def q_room_allowlist(spark, sf_dir):
    return M.allowed_rooms(messages_from_events(spark, sf_dir), ["ic", "ur"])


@query(f"SELECT * FROM {EVENTS_SQL} WHERE timestamp >= {T1} OR timestamp IS NULL")
def q_retention(spark, sf_dir):
    return M.retained(messages_from_events(spark, sf_dir), T1)


@query(f"SELECT count(*) AS removed FROM {EVENTS_SQL} WHERE timestamp < {T1}")
def q_retention_removed(spark, sf_dir):
    return messages_from_events(spark, sf_dir).filter(F.col("timestamp") < T1).agg(F.count(F.lit(1)).alias("removed"))


@query(f"SELECT count(*) AS n FROM {EVENTS_SQL}")
def q_count_all(spark, sf_dir):
    return messages_from_events(spark, sf_dir).agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT count(*) AS n FROM {EVENTS_SQL} WHERE room_id = 'view'")
def q_count_room(spark, sf_dir):
    return messages_from_events(spark, sf_dir).filter("room_id = 'view'").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT DISTINCT room_name FROM {EVENTS_SQL}")
def q_rooms(spark, sf_dir):
    return M.rooms(messages_from_events(spark, sf_dir))


@query(f"SELECT max(timestamp) AS last_ts FROM {EVENTS_SQL}")
def q_max_ts(spark, sf_dir):
    return messages_from_events(spark, sf_dir).agg(F.max("timestamp").alias("last_ts"))


@query(f"SELECT room_name, count(*) AS n FROM {EVENTS_SQL} GROUP BY room_name")
def q_room_counts(spark, sf_dir):
    return M.room_counts(messages_from_events(spark, sf_dir))


@query(f"""WITH b AS (SELECT * REPLACE ('evt_' || (id % 700) AS message_id) FROM {EVENTS_SQL}),
e AS (SELECT message_id FROM {EVENTS_SQL} WHERE id % 3 = 0)
SELECT * FROM b WHERE message_id NOT IN (SELECT message_id FROM e) QUALIFY row_number() OVER (PARTITION BY message_id ORDER BY id) = 1""")
def q_insert_ignore(spark, sf_dir):
    m = messages_from_events(spark, sf_dir)
    batch = m.withColumn("message_id", F.concat(F.lit("evt_"), (F.col("id") % 700).cast("string")))
    return M.insert_ignore(m.filter("id % 3 = 0"), batch)


@query(f"SELECT * FROM {EVENTS_SQL} WHERE timestamp >= (SELECT max(timestamp) - 3600000 FROM {EVENTS_SQL})")
def q_incremental_poll(spark, sf_dir):
    m = messages_from_events(spark, sf_dir)
    last = m.agg((F.max("timestamp") - 3600000).alias("since"))  # one row
    return m.join(F.broadcast(last), F.col("timestamp") >= F.col("since")).drop("since")


@query(f"""SELECT id, to_json({{'messageId': message_id, 'roomId': room_id, 'roomName': room_name, 'talkerId': talker_id, 'talkerName': talker_name, 'content': content, 'messageType': message_type, 'timestamp': timestamp}}) AS payload FROM {EVENTS_SQL}""")
def q_webhook_payload(spark, sf_dir):
    m = messages_from_events(spark, sf_dir)
    return m.select("id", M.webhook_payload().alias("payload"))


@query(f"""SELECT count(*) AS collected, count(*) FILTER (msg_index = 0) AS failed, count(*) FILTER (msg_index > 0) AS succeeded, count(DISTINCT room_name) AS targets FROM {EVENTS_SQL}""")
def q_counters(spark, sf_dir):
    m = messages_from_events(spark, sf_dir)
    return m.agg(F.count(F.lit(1)).alias("collected"), F.count_if(F.col("msg_index") == 0).alias("failed"), F.count_if(F.col("msg_index") > 0).alias("succeeded"), F.countDistinct("room_name").alias("targets"))


