"""Queries over recognition output."""

from __future__ import annotations

from pyspark.sql import functions as F

from chatloom.operators import vlm_json as V
from chatloom.plans.registry import query
from chatloom.sources.messages import AS_OF_MS, EVENTS_SQL, messages_from_events



def responses(spark, sf_dir):
    m = messages_from_events(spark, sf_dir)
    body = F.concat(F.lit('{"roomName":"'), "room_name", F.lit('","messages":[{"index":0,"sender":"'), "talker_name", F.lit('","content":"m'), F.col("id").cast("string"), F.lit('","time":"14:27"},{"index":1,"sender":"B","content":"n'), F.col("id").cast("string"), F.lit('","time":"15:00"}]}'))
    kind = F.col("id") % 6
    wrapped = F.when(kind == 0, body).when(kind == 1, F.concat(F.lit("Here:\n```json\n"), body, F.lit("\n```\nbye"))).when(kind == 2, F.concat(F.lit("The answer is "), body, F.lit(" as asked.")))
    cut = F.concat(F.regexp_replace(body, "\\}$", ""), F.lit(', "x'))
    return m.select("id", "room_name", wrapped.when(kind == 3, cut).when(kind == 4, F.lit("")).otherwise(F.lit('{"messages":[{"index":0')).alias("response"))


@query(f"""SELECT id, CAST([1, 2, 3, 4, 5, 5][CAST(id % 6 + 1 AS INT)] AS INT) AS step, CASE WHEN id % 6 <= 2 THEN room_name ELSE '未知群聊' END AS room, CAST(CASE WHEN id % 6 <= 3 THEN 2 ELSE 0 END AS INT) AS n FROM {EVENTS_SQL}""")
def q_vlm_parse(spark, sf_dir):
    r = V.recognized(responses(spark, sf_dir))
    return r.select("id", "step", F.col("recognized.roomName").alias("room"), F.size("recognized.messages").alias("n"))


@query(f"""SELECT id, CAST(i AS INT) AS pos, CASE WHEN id % 6 <= 2 THEN room_name ELSE '未知群聊' END AS room_name, CASE i WHEN 0 THEN talker_name ELSE 'B' END AS sender, CASE i WHEN 0 THEN 'm' || id ELSE 'n' || id END AS content,
  CASE i WHEN 0 THEN '14:27' ELSE '15:00' END AS time FROM {EVENTS_SQL}, (VALUES (0), (1)) v(i) WHERE id % 6 <= 3""")
def q_message_rows(spark, sf_dir):
    return V.message_rows(V.recognized(responses(spark, sf_dir)), ["id"]).select("id", "pos", "room_name", "sender", "content", "time")


@query(f"""SELECT id, '{{"index":' || msg_index || ',"sender":"' || talker_name || '","content":"m' || id || '","time":"14:27","recognizedAt":{AS_OF_MS},"provider":"stub"}}' AS raw FROM {EVENTS_SQL}""")
def q_raw_json(spark, sf_dir):
    m = messages_from_events(spark, sf_dir)
    message = F.struct(F.col("msg_index").alias("index"), F.col("talker_name").alias("sender"), F.concat(F.lit("m"), F.col("id").cast("string")).alias("content"), F.lit("14:27").alias("time"))
    return m.select("id", V.raw_data(message, AS_OF_MS, "stub").alias("raw"))
