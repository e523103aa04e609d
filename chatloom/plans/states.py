"""Queries over sequential operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from chatloom.operators import states as S
from chatloom.plans.registry import query
from chatloom.sources.messages import event_millis

_T = "SELECT event_type, event_id, epoch_us(ts) // 1000 AS t FROM events"


@query(f"""WITH RECURSIVE r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY t, event_id) AS n FROM ({_T})),
f AS (SELECT event_type, t, n, t + 7200000 AS reset, 1 AS c, true AS allowed FROM r WHERE n = 1
  UNION ALL SELECT r.event_type, r.t, r.n, CASE WHEN r.t >= f.reset THEN r.t + 7200000 ELSE f.reset END,
    CASE WHEN r.t >= f.reset THEN 1 WHEN f.c < 3 THEN f.c + 1 ELSE f.c END, r.t >= f.reset OR f.c < 3
  FROM f JOIN r ON r.event_type = f.event_type AND r.n = f.n + 1)
SELECT event_type, t, allowed FROM f""")
def q_rate_limit(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_type", event_millis().alias("t"))
    return S.rate_limit(e, "event_type", "t", 3, 7200000)


@query("""WITH RECURSIVE r AS (SELECT user_id, event_id, event_id % 7 <> 0 AS idle, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
f AS (SELECT user_id, event_id, n, CASE WHEN idle THEN 1 ELSE 0 END AS level FROM r WHERE n = 1
  UNION ALL SELECT r.user_id, r.event_id, r.n, CASE WHEN NOT r.idle THEN 0 WHEN f.level + 1 > 3 THEN 0 ELSE f.level + 1 END FROM f JOIN r ON r.user_id = f.user_id AND r.n = f.n + 1)
SELECT user_id, event_id, level, level + 1 AS multiplier, level + 2 AS wait_code, level + 1 AS wait_documented FROM f""")
def q_backoff(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "event_id", (F.col("event_id") % 7 != 0).alias("idle"))
    return S.backoff(e, "user_id", "event_id", "idle")


@query("""WITH RECURSIVE e AS (SELECT event_id // 20 AS page, CAST((event_id * 13) % 97 AS DOUBLE) AS y, CAST((event_id * 31) % 53 AS DOUBLE) AS x, CAST(event_id % 20 AS VARCHAR) || ';' AS text FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY y, x, text) AS n FROM e),
f AS (SELECT page, y, x, text, n, 0 AS line, y AS mean, 1 AS c FROM r WHERE n = 1
  UNION ALL SELECT r.page, r.y, r.x, r.text, r.n, CASE WHEN abs(r.y - f.mean) <= 8 THEN f.line ELSE f.line + 1 END,
    CASE WHEN abs(r.y - f.mean) <= 8 THEN floor((f.mean * f.c + r.y) / (f.c + 1) + 0.5) ELSE r.y END, CASE WHEN abs(r.y - f.mean) <= 8 THEN f.c + 1 ELSE 1 END
  FROM f JOIN r ON r.page = f.page AND r.n = f.n + 1)
SELECT page, line, last(mean ORDER BY n) AS y, string_agg(text, '' ORDER BY x, text) AS text FROM f GROUP BY page, line""")
def q_y_groups(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return S.y_groups(e.selectExpr("event_id div 20 AS page", "(event_id * 13) % 97 AS y", "(event_id * 31) % 53 AS x", "concat(CAST(event_id % 20 AS STRING), ';') AS text"))


@query("""WITH RECURSIVE r AS (SELECT event_type, event_id, floor(value) AS v, (event_id % 10) / 10.0 AS c, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS n FROM events),
f AS (SELECT event_type, n, CASE WHEN c < 0.5 THEN NULL ELSE v END AS s FROM r WHERE n = 1
  UNION ALL SELECT r.event_type, r.n, CASE WHEN r.c < 0.5 THEN f.s WHEN f.s IS NULL THEN r.v ELSE floor(f.s * CAST(0.65 AS DOUBLE) + r.v * (CAST(1 AS DOUBLE) - CAST(0.65 AS DOUBLE)) + 0.5) END FROM f JOIN r ON r.event_type = f.event_type AND r.n = f.n + 1)
SELECT event_type, last(s ORDER BY n) AS smoothed FROM f GROUP BY event_type""")
def q_ema(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_type", "event_id", F.floor("value").alias("v"), ((F.col("event_id") % 10) / 10.0).alias("c"))
    return S.ema(e, "event_type", "event_id", "v", "c")
