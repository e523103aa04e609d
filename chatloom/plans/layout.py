"""Queries over geometry, names and bands (extensions: present in the original, of little use for analytics)."""

from __future__ import annotations

from pyspark.sql import functions as F

from chatloom.functions import layout as L
from chatloom.functions import timeparse as P
from chatloom.plans.registry import query
from chatloom.plans.times import checkpoint_sql, times
from chatloom.sources.messages import AS_OF_MS


@query("""SELECT event_id, CASE event_id % 3 WHEN 0 THEN 1.5::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS scale,
  greatest(0, least(event_id % 90 - 10, 59)) AS x, greatest(1, least(event_id % 70, 60 - greatest(0, least(event_id % 90 - 10, 59)))) AS width,
  CAST(least(40, floor((event_id % 500) * 0.15 + 0.5)) AS BIGINT) AS click FROM events""")
def q_layout(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    i = F.col("event_id")
    w = F.when(i % 3 == 0, 2560).when(i % 3 == 1, 1920).otherwise(800)
    h = F.when(i % 3 == 0, 1440).when(i % 3 == 1, 1080).otherwise(600)
    box = F.struct((i % 90 - 10).alias("x"), F.lit(0).alias("y"), (i % 70).alias("width"), F.lit(1).alias("height"))
    rows = e.select("event_id", L.screen_scale(w, h).alias("scale"), L.clamped_box(box, F.lit(60), F.lit(40)).alias("box"), L.click_offset(i % 500).cast("long").alias("click"))
    return rows.select("event_id", "scale", "box.x", "box.width", "click")


@query("""SELECT event_id, title, (contains(lower(title), 'tray') OR contains(title, '消息')) AND title <> '' AS fits, event_id % 20 > 5 AND length(title) > 1 AS is_line,
  'data/attachments/' || regexp_replace(title, '[^a-zA-Z0-9\\x{4e00}-\\x{9fa5}]', '_', 'g') || '/' || md5(props) || '.png' AS path
FROM (SELECT *, CASE event_id % 4 WHEN 0 THEN '' WHEN 1 THEN 'MessageTray' WHEN 2 THEN '消息 ' || event_type ELSE event_type END AS title FROM events)""")
def q_titles(spark, sf_dir):
    i = F.col("event_id")
    title = F.when(i % 4 == 0, "").when(i % 4 == 1, "MessageTray").when(i % 4 == 2, F.concat(F.lit("消息 "), "event_type")).otherwise(F.col("event_type"))
    e = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("title", title)
    path = L.attachment_path(F.col("title"), F.md5(F.col("props").cast("binary")), F.lit("png"))
    return e.select("event_id", "title", L.title_matches(F.col("title"), ["tray"], ["消息"]).alias("fits"), L.is_text_line(i % 20, F.col("title")).alias("is_line"), path.alias("path"))


@query("""WITH p AS (SELECT event_id // 60 AS page, event_id % 60 AS x, floor(value) AS score FROM events),
h AS (SELECT *, score >= avg(score) OVER (PARTITION BY page) * 1.3 AS high FROM p),
b AS (SELECT *, x - sum(CASE WHEN high THEN 1 ELSE 0 END) OVER (PARTITION BY page ORDER BY x) AS band FROM h),
g AS (SELECT page, band, min(x) AS start_x, max(x) AS end_x, max(score) AS max_score FROM b WHERE high GROUP BY page, band)
SELECT page, start_x, end_x, (start_x + end_x) // 2 AS center_x, max_score FROM g WHERE end_x - start_x >= 2""")
def q_bands(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("event_id div 60 AS page", "event_id % 60 AS x", "floor(value) AS score")
    return L.bands(p, "page", "x", "score")


@query("SELECT event_type, sum(value * (event_id % 5)) / nullif(sum(event_id % 5), 0) AS mean FROM events GROUP BY event_type")
def q_weighted_mean(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.groupBy("event_type").agg(L.weighted_mean(F.col("value"), F.col("event_id") % 5).alias("mean"))


_STAMP_SQL = f"""{checkpoint_sql("周|是期|星期", "0").partition(chr(10) + "SELECT")[0]}
SELECT id, lpad(CAST(coalesce(year(day0), nullif(y, 0), 2024) AS VARCHAR), 4, '0') || lpad(CAST(coalesce(month(day0), nullif(m, 0), 2) AS VARCHAR), 2, '0')
  || lpad(CAST(coalesce(day(day0), nullif(d, 0), 1) AS VARCHAR), 2, '0') || '_' || lpad(CAST(hour AS VARCHAR), 2, '0') || lpad(CAST(minute AS VARCHAR), 2, '0') AS stamp FROM x"""


@query(_STAMP_SQL)
def q_checkpoint_stamp(spark, sf_dir):
    return times(spark, sf_dir).select("id", P.checkpoint_stamp(P.checkpoint(F.col("time_str"), AS_OF_MS), AS_OF_MS).alias("stamp"))
