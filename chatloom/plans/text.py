"""Queries over text functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from chatloom.functions import text as X
from chatloom.functions.text import JS_WS_SQL
from chatloom.plans.registry import query
from chatloom.sources.messages import CONVERSATIONS_SQL, EVENTS_SQL, messages_from_conversations, messages_from_events

# Odd spaces around the content, the same in both engines.
SPACED_SQL = "(CASE id % 4 WHEN 0 THEN content WHEN 1 THEN chr(12288) || content || chr(160) WHEN 2 THEN chr(65279) || upper(content) WHEN 3 THEN ' ' || chr(9) || content END)"


def _spaced():
    c = F.col("content")
    return F.when(F.col("id") % 4 == 0, c).when(F.col("id") % 4 == 1, F.concat(F.lit("　"), c, F.lit(" "))).when(F.col("id") % 4 == 2, F.concat(F.lit("﻿"), F.upper(c))).otherwise(F.concat(F.lit(" \t"), c))


@query(f"SELECT id, lower(regexp_replace({SPACED_SQL}, '{JS_WS_SQL}', '', 'g')) AS norm FROM {EVENTS_SQL}")
def q_norm_content(spark, sf_dir):
    return messages_from_events(spark, sf_dir).select("id", X.norm_content(_spaced()).alias("norm"))


@query(f"SELECT id, regexp_replace(room_name || ' ' || content || '群-' || id, '[^a-zA-Z0-9\\x{{4e00}}-\\x{{9fa5}}]', '_', 'g') AS safe FROM {EVENTS_SQL}")
def q_safe_name(spark, sf_dir):
    m = messages_from_events(spark, sf_dir)
    return m.select("id", X.safe_name(F.concat("room_name", F.lit(" "), "content", F.lit("群-"), F.col("id").cast("string"))).alias("safe"))


@query(f"SELECT id, room_name || ':' || talker_name || ':' || substring(content, 1, 50) AS cache_key, room_name || '|未知|' || substring(content, 1, 50) AS text_key FROM {CONVERSATIONS_SQL}")
def q_dedup_key(spark, sf_dir):
    m = messages_from_conversations(spark, sf_dir)
    return m.select("id", X.dedup_key(F.col("room_name"), F.col("talker_name"), F.col("content")).alias("cache_key"), X.text_mode_key(F.col("room_name"), F.col("content")).alias("text_key"))


TABS = ("群聊", "TiE群聊", "群获", "群 友", "群x", "联系", "联系从", "功能", "功能x", "人")
_TABS_SQL = "['" + "', '".join(TABS) + "']"
_TARGETS_SQL = "['群聊', '联系人', '功能']"


@query(f"""WITH t AS (SELECT id, {_TABS_SQL}[CAST(id % {len(TABS)} + 1 AS INT)] AS tab, {_TARGETS_SQL}[CAST(id % 3 + 1 AS INT)] AS target FROM {EVENTS_SQL}),
b AS (SELECT *, replace(tab, ' ', '') AS bare FROM t)
SELECT id, tab, target, contains(bare, target) OR (target = '群聊' AND regexp_matches(bare, '^群[获了人友闭]'))
  OR (target = '联系人' AND starts_with(bare, '联系')) OR (target = '功能' AND starts_with(bare, '功能')) AS fits FROM b""")
def q_fuzzy(spark, sf_dir):
    m = messages_from_events(spark, sf_dir)
    tab = F.element_at(F.array(*map(F.lit, TABS)), (F.col("id") % len(TABS) + 1).cast("int"))
    target = F.element_at(F.array(*map(F.lit, ("群聊", "联系人", "功能"))), (F.col("id") % 3 + 1).cast("int"))
    return m.select("id", tab.alias("tab"), target.alias("target")).withColumn("fits", X.fuzzy_match(F.col("tab"), F.col("target")))


@query(f"SELECT id, right(CAST(timestamp + id AS VARCHAR), 6) AS run_id FROM {EVENTS_SQL}")
def q_run_id(spark, sf_dir):
    return messages_from_events(spark, sf_dir).select("id", X.run_id(F.col("timestamp") + F.col("id")).alias("run_id"))


@query(f"""WITH raw AS (SELECT id, room_name || '|群聊, ' || talker_name || ' ,|x,, ' AS v FROM {EVENTS_SQL}),
items AS (SELECT id, trim(unnest(string_split(v, ','))) AS item, generate_subscripts(string_split(v, ','), 1) AS pos FROM raw),
parts AS (SELECT id, pos, trim(split_part(item, '|', 1)) AS name, trim(split_part(item, '|', 2)) AS category FROM items WHERE item <> '')
SELECT id, name, CASE WHEN category = '' THEN '联系人' ELSE category END AS category FROM parts WHERE name <> ''""")
def q_targets(spark, sf_dir):
    m = messages_from_events(spark, sf_dir)
    v = F.concat("room_name", F.lit("|群聊, "), "talker_name", F.lit(" ,|x,, "))
    return m.select("id", F.inline(X.targets(v)))


_LOG_SQL = f"""(SELECT id, CASE WHEN id % 10 = 0 THEN 'no record ' || id ELSE strftime(make_timestamp(timestamp * 1000), '%Y-%m-%d %H:%M:%S') || ' ['
  || CASE id % 3 WHEN 0 THEN 'INFO' WHEN 1 THEN 'ERROR' ELSE 'Debug' END || ']: ' || content END AS line FROM {EVENTS_SQL})"""


@query(f"""SELECT id, regexp_extract(line, '^([0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}} [0-9]{{2}}:[0-9]{{2}}:[0-9]{{2}})', 1) AS time,
  lower(regexp_extract(line, '\\[(\\w+)\\]', 1)) AS level, regexp_extract(line, '\\]:\\s*(.+)', 1) AS message
FROM (SELECT * FROM {_LOG_SQL} ORDER BY id DESC LIMIT 50) WHERE regexp_matches(line, '^[0-9]{{4}}-')""")
def q_log_parse(spark, sf_dir):
    m = messages_from_events(spark, sf_dir)
    level = F.when(F.col("id") % 3 == 0, "INFO").when(F.col("id") % 3 == 1, "ERROR").otherwise("Debug")
    stamp = F.expr("date_format(timestampadd(MINUTE, timestamp div 60000, TIMESTAMP_NTZ '1970-01-01 00:00:00'), 'yyyy-MM-dd HH:mm:ss')")
    line = F.when(F.col("id") % 10 == 0, F.concat(F.lit("no record "), F.col("id").cast("string"))).otherwise(F.concat(stamp, F.lit(" ["), level, F.lit("]: "), "content"))
    tail = m.select("id", line.alias("line")).orderBy(F.desc("id")).limit(50)
    return tail.select("id", X.log_record(F.col("line")).alias("r")).filter("r IS NOT NULL").select("id", "r.time", "r.level", "r.message")


@query(f"""WITH c AS (SELECT id, CASE id % 3 WHEN 0 THEN content || '【图片：a' || id || '】' WHEN 1 THEN '报表.xlsx【文件|报表' || id || '.xlsx|2.5MB】' ELSE content END AS c FROM {EVENTS_SQL})
SELECT id, CASE id % 3 WHEN 0 THEN 'picture' WHEN 1 THEN 'file' END AS kind, CASE id % 3 WHEN 0 THEN 'a' || id WHEN 1 THEN '报表' || id || '.xlsx' END AS label,
  CASE id % 3 WHEN 0 THEN '' WHEN 1 THEN '2.5MB' END AS size FROM c""")
def q_markers(spark, sf_dir):
    i = F.col("id").cast("string")
    c = F.when(F.col("id") % 3 == 0, F.concat("content", F.lit("【图片：a"), i, F.lit("】"))).when(F.col("id") % 3 == 1, F.concat(F.lit("报表.xlsx【文件|报表"), i, F.lit(".xlsx|2.5MB】"))).otherwise(F.col("content"))
    return messages_from_events(spark, sf_dir).select("id", X.markers(c).alias("m")).select("id", "m.kind", "m.label", "m.size")
