"""Queries over deduplication, filling and ingestion."""

from __future__ import annotations

from pyspark.sql import functions as F

from chatloom.functions.text import norm_content
from chatloom.operators import dedup as D
from chatloom.plans.registry import query
from chatloom.sources.messages import AS_OF_MS, DOCUMENTS_SQL, EVENTS_SQL, event_millis, messages_from_documents, messages_from_events

# Recognised messages: batches of 12 by event_id, times missing, bare or dated.
RECOGNIZED_SQL = """(SELECT event_id // 12 AS batch, CAST(event_id % 12 AS INT) AS idx, CASE event_id % 5 WHEN 0 THEN '' ELSE 'user_' || user_id % 3 END AS sender,
  CASE event_id % 11 WHEN 0 THEN '  ' WHEN 1 THEN 'Hello World' WHEN 2 THEN 'helloworld' ELSE props || event_id % 4 END AS content,
  CASE (event_id * 7) % 9 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN '14:27' WHEN 3 THEN '2月17日 14:27' WHEN 4 THEN '15:00' WHEN 5 THEN '昨天 15:00' WHEN 6 THEN '现在' ELSE NULL END AS time FROM events)"""


def recognized(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.selectExpr(
        "event_id div 12 AS batch",
        "CAST(event_id % 12 AS INT) AS idx",
        "CASE event_id % 5 WHEN 0 THEN '' ELSE concat('user_', user_id % 3) END AS sender",
        "CASE event_id % 11 WHEN 0 THEN '  ' WHEN 1 THEN 'Hello World' WHEN 2 THEN 'helloworld' ELSE concat(props, event_id % 4) END AS content",
        "CASE (event_id * 7) % 9 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN '14:27' WHEN 3 THEN '2月17日 14:27' WHEN 4 THEN '15:00' WHEN 5 THEN '昨天 15:00' WHEN 6 THEN '现在' ELSE NULL END AS time",
    )


_FILLED = """(SELECT batch, idx, {more} coalesce(last_value(nullif(time, '') IGNORE NULLS) OVER (PARTITION BY batch ORDER BY idx),
  first_value(nullif(time, '') IGNORE NULLS) OVER (PARTITION BY batch ORDER BY idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS time FROM {rows})"""
_TOKENS = """(SELECT * REPLACE (CASE WHEN regexp_matches(time, '[0-9]{{1,2}}:[0-9]{{2}}$') THEN first_value(time) OVER (PARTITION BY batch, regexp_extract(time, '([0-9]{{1,2}}:[0-9]{{2}})$', 1)
  ORDER BY length(time) DESC NULLS LAST, idx) ELSE time END AS time) FROM {rows})"""


@query(f"SELECT * FROM {_FILLED.format(more='', rows=RECOGNIZED_SQL)}")
def q_fill_times(spark, sf_dir):
    return D.fill_times(recognized(spark, sf_dir)).select("batch", "idx", "time")


@query(f"SELECT batch, idx, time FROM {_TOKENS.format(rows=RECOGNIZED_SQL)}")
def q_normalize_tokens(spark, sf_dir):
    return D.normalize_tokens(recognized(spark, sf_dir)).select("batch", "idx", "time")


_MERGED = f"""(SELECT batch, idx, content, first_value(nullif(sender, '') IGNORE NULLS) OVER g AS sender, first_value(nullif(time, '') IGNORE NULLS) OVER g AS time
  FROM (SELECT *, lower(replace(content, ' ', '')) AS norm FROM {RECOGNIZED_SQL}) WHERE norm <> ''
  WINDOW g AS (PARTITION BY batch, norm ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) QUALIFY row_number() OVER (PARTITION BY batch, norm ORDER BY idx) = 1)"""


@query(f"SELECT batch, idx, sender, content, time FROM {_TOKENS.format(rows=_FILLED.format(more='sender, content,', rows=_MERGED))}")
def q_dedup_batch(spark, sf_dir):
    return D.dedup_batch(recognized(spark, sf_dir)).select("batch", "idx", "sender", "content", "time")


_RECENT = f"SELECT 1 FROM {DOCUMENTS_SQL} e WHERE e.id % 2 = 0 AND left(e.room_name, 3) = left(b.room_name, 3) AND e.timestamp > {AS_OF_MS - 60000} AND lower(regexp_replace(e.content, '\\s', '', 'g')) = lower(regexp_replace(b.content, '\\s', '', 'g'))"


@query(f"SELECT id FROM {DOCUMENTS_SQL} b WHERE id % 2 = 1 AND EXISTS ({_RECENT})")
def q_exists_semi(spark, sf_dir):
    m = messages_from_documents(spark, sf_dir).withColumn("room_name", F.left("room_name", F.lit(3)))
    return D.known_in_room(m.filter("id % 2 = 1"), m.filter("id % 2 = 0"), AS_OF_MS, how="left_semi").select("id")


@query(f"SELECT id FROM {DOCUMENTS_SQL} b WHERE id % 2 = 1 AND NOT EXISTS ({_RECENT})")
def q_exists_anti(spark, sf_dir):
    m = messages_from_documents(spark, sf_dir).withColumn("room_name", F.left("room_name", F.lit(3)))
    return D.known_in_room(m.filter("id % 2 = 1"), m.filter("id % 2 = 0"), AS_OF_MS).select("id")


@query(f"SELECT min(id) AS id FROM {DOCUMENTS_SQL} GROUP BY room_name, substring(content, 1, 50)")
def q_text_mode_dedup(spark, sf_dir):
    m = messages_from_documents(spark, sf_dir)
    return D.first_by_key(m, [F.col("room_name"), F.substring("content", 1, 50)], "id").select("id")


NOTES_SQL = """(SELECT event_id + 1 AS idx, event_type AS room_name, 'user_' || user_id % 11 AS sender, 'Note ' || (event_id * 31) % 307 AS content, (epoch_us(ts) // 60000000) * 60000 AS timestamp FROM events)"""
NOTES_NOW_MS, NOTES_WITHIN_MS = 1706659200000, 777600000
INGEST_SQL = f"""WITH b AS (SELECT *, lower(replace(content, ' ', '')) AS norm FROM {NOTES_SQL} WHERE idx % 2 = 1 AND contains(room_name, 'i')),
f AS (SELECT * FROM b WHERE norm <> '' QUALIFY row_number() OVER (PARTITION BY room_name, sender, substring(content, 1, 50) ORDER BY idx) = 1),
g AS (SELECT *, max(timestamp) OVER (PARTITION BY room_name, norm ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS newest FROM f)
SELECT idx, room_name, sender, content, timestamp FROM g WHERE (newest IS NULL OR newest <= {NOTES_NOW_MS - NOTES_WITHIN_MS})
AND NOT EXISTS (SELECT 1 FROM {NOTES_SQL} e WHERE e.idx % 2 = 0 AND e.room_name = g.room_name AND e.timestamp > {NOTES_NOW_MS - NOTES_WITHIN_MS} AND lower(replace(e.content, ' ', '')) = g.norm)"""


def notes(spark, sf_dir):
    """Events as short notes that senders repeat: some by themselves, some by others in the room."""
    content = F.concat(F.lit("Note "), (F.col("event_id") * 31 % 307).cast("string"))
    sender = F.concat(F.lit("user_"), (F.col("user_id") % 11).cast("string"))
    minute = (F.floor(event_millis() / 60000) * 60000).alias("timestamp")
    return spark.read.parquet(f"{sf_dir}/events.parquet").select((F.col("event_id") + 1).alias("idx"), F.col("event_type").alias("room_name"), sender.alias("sender"), content.alias("content"), minute)


@query(INGEST_SQL)
def q_ingest(spark, sf_dir):
    n = notes(spark, sf_dir)
    existing = n.filter("idx % 2 = 0")
    return D.ingest(n.filter("idx % 2 = 1"), existing, NOTES_NOW_MS, ["i"], NOTES_WITHIN_MS)


_KEYED_SQL = "SELECT event_type, user_id % 5 AS u, epoch_us(ts) // 1000 AS t FROM events"


@query(f"""WITH RECURSIVE r AS (SELECT event_type, u, t, row_number() OVER (PARTITION BY event_type, u ORDER BY t) AS n FROM ({_KEYED_SQL})),
f AS (SELECT event_type, u, t, n, t AS anchor, true AS kept FROM r WHERE n = 1
  UNION ALL SELECT r.event_type, r.u, r.t, r.n, CASE WHEN r.t - f.anchor >= 3600000 THEN r.t ELSE f.anchor END, r.t - f.anchor >= 3600000
  FROM f JOIN r ON r.event_type = f.event_type AND r.u = f.u AND r.n = f.n + 1)
SELECT event_type, u, t FROM f WHERE kept""")
def q_seen_cache(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_type", (F.col("user_id") % 5).alias("u"), event_millis().alias("t"))
    return D.seen_cache(e, ["event_type", "u"], "t", 3600000)


@query(f"SELECT room_name, count(DISTINCT lower(regexp_replace(content, '\\s', '', 'g'))) AS n FROM {DOCUMENTS_SQL} GROUP BY room_name")
def q_distinct_contents(spark, sf_dir):
    m = messages_from_documents(spark, sf_dir)
    return m.groupBy("room_name").agg(F.countDistinct(norm_content(F.col("content"))).alias("n"))
