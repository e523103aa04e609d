"""Queries over recognised fragments and decisions."""

from __future__ import annotations

from pyspark.sql import functions as F

from chatloom.operators import ocr as O
from chatloom.plans.registry import query
from chatloom.sources.messages import AS_OF_MS, event_millis

# Tokens of a line by event_id: with signs, without, joined, and none that parse.
_FORMS = ("[mo, '月', d, '日', c]", "[mo, d, c]", "['x', mo, d, c]", "[c]", "[mo, '月', d, '号', c, 'z']", "['on', c, d]")
_PARTS = "CAST(event_id % 14 AS VARCHAR) AS mo, CAST(event_id % 33 AS VARCHAR) AS d, CAST(event_id % 25 AS VARCHAR) || ':' || lpad(CAST(event_id % 60 AS VARCHAR), 2, '0') AS c"
_OK_CLOCK = "event_id % 25 <= 23"
_OK_DATE = "event_id % 14 BETWEEN 1 AND 12 AND event_id % 33 BETWEEN 1 AND 31"


@query(f"""SELECT event_id, CASE WHEN {_OK_CLOCK} THEN CASE event_id % 6 WHEN 3 THEN c WHEN 5 THEN NULL WHEN 0 THEN CASE WHEN {_OK_DATE} THEN mo || '月' || d || '日' || c END
  WHEN 4 THEN CASE WHEN {_OK_DATE} THEN mo || '月' || d || '号' || c END ELSE CASE WHEN {_OK_DATE} THEN mo || '月' || d || '日' || c END END END AS time_text FROM (SELECT event_id, {_PARTS} FROM events)""")
def q_token_recovery(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("event_id", "CAST(event_id % 14 AS STRING) AS mo", "CAST(event_id % 33 AS STRING) AS d", "concat(CAST(event_id % 25 AS STRING), ':', lpad(CAST(event_id % 60 AS STRING), 2, '0')) AS c")
    forms = " ".join(f"WHEN {i} THEN array({f[1:-1]})" for i, f in enumerate(_FORMS))
    lines = rows.select("event_id", F.expr(f"CASE event_id % 6 {forms} END").alias("tokens"))
    return O.line_times(lines, AS_OF_MS).select("event_id", "time_text")


@query("""SELECT event_id, event_id % 11 <> 0 AND NOT (event_id % 7 = 0) AND (event_id % 3 = 0 OR NOT (event_id % 2 = 0) OR (event_id % 5 = 0 AND event_id % 4 = 0)) AS wanted FROM events""")
def q_recognition_gate(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    i = F.col("event_id")
    return e.select("event_id", O.wants_recognition(i % 11 != 0, i % 7 == 0, i % 3 == 0, i % 2 == 0, i % 5, i % 4).alias("wanted"))


@query("""WITH c AS (SELECT event_id AS key, epoch_us(ts) // 1000 AS timestamp FROM events), m AS (SELECT max(timestamp) AS now, count(*) AS n FROM c)
SELECT key, timestamp FROM c, m WHERE n <= 500 OR timestamp >= 1706000000000 - 86400000""")
def q_cache_eviction(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("key"), event_millis().alias("timestamp"))
    return O.evicted(c, 1706000000000, 500, 86400000)
