"""Queries over array numerics."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chatloom.functions import arrays as A
from chatloom.operators import states as S
from chatloom.plans.registry import query

_PAIRS = "(SELECT a.vec_id AS a_id, b.vec_id AS b_id, a.embedding AS a, b.embedding AS b FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)"


def _pairs(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    b = e.select((F.col("vec_id") - 1).alias("a_id"), F.col("vec_id").alias("b_id"), F.col("embedding").alias("b"))
    return e.select(F.col("vec_id").alias("a_id"), F.col("embedding").alias("a")).join(b, "a_id")


@query(f"SELECT a_id, b_id, list_sum(list_transform(list_zip(a, b), lambda p: CASE WHEN abs(p[1] - p[2]) < 0.1 THEN 1 ELSE 0 END)) / len(a) AS similarity FROM {_PAIRS}")
def q_vec_similarity(spark, sf_dir):
    return _pairs(spark, sf_dir).select("a_id", "b_id", A.share_within(F.col("a"), F.col("b"), 0.1).alias("similarity"))


@query("SELECT event_type, user_id % 20 AS u, CASE WHEN coalesce(list_sort(list(v))[CAST(floor(count(*) * 0.75) AS INT) + 1], 0) <> 0 THEN list_sort(list(v))[CAST(floor(count(*) * 0.75) AS INT) + 1] ELSE 40.0 END AS p75 FROM (SELECT event_type, user_id, value AS v FROM events) GROUP BY ALL")
def q_p75(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_type", (F.col("user_id") % 20).alias("u"), "value")
    return S.upper_quartile(e, ["event_type", "u"], "value", 40.0)


@query("""WITH y AS (SELECT event_type, event_id // 25 AS page, floor(value) AS y FROM events),
g AS (SELECT event_type, page, y - lag(y) OVER (PARTITION BY event_type, page ORDER BY y) AS gap FROM y)
SELECT event_type, page, coalesce(median(gap) FILTER (gap > 0 AND gap < 200), 50.0) AS median_gap FROM g GROUP BY event_type, page""")
def q_gap_median(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("event_type", "event_id div 25 AS page", "CAST(floor(value) AS DOUBLE) AS y")
    g = e.withColumn("gap", F.col("y") - F.lag("y").over(W.partitionBy("event_type", "page").orderBy("y")))
    inside = F.when((F.col("gap") > 0) & (F.col("gap") < 200), F.col("gap"))
    return g.groupBy("event_type", "page").agg(F.coalesce(F.percentile(inside, F.lit(0.5)), F.lit(50.0)).alias("median_gap"))


@query("SELECT event_type, event_id, score FROM (SELECT event_type, event_id, CAST(floor(value) AS BIGINT) AS score FROM events) QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY score DESC, event_id) = 1")
def q_best_window(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_type", "event_id", F.floor("value").cast("long").alias("score"))
    w = W.partitionBy("event_type").orderBy(F.desc("score"), "event_id")
    return e.withColumn("nth", F.row_number().over(w)).filter("nth = 1").drop("nth")


@query(f"SELECT count(*) AS pairs, count(*) FILTER (list_sum(list_transform(list_zip(a, b), lambda p: CASE WHEN abs(p[1] - p[2]) < 0.5 THEN 1 ELSE 0 END)) / len(a) > 0.9) AS duplicates FROM {_PAIRS}")
def q_adjacent_duplicates(spark, sf_dir):
    p = _pairs(spark, sf_dir)
    return p.agg(F.count(F.lit(1)).alias("pairs"), F.count_if(A.is_duplicate(F.col("a"), F.col("b"), 0.5, 0.9)).alias("duplicates"))


@query("""WITH p AS (SELECT vec_id, embedding AS b, lag(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS a FROM embeddings)
SELECT vec_id FROM p WHERE a IS NULL OR list_sum(list_transform(list_zip(a, b), lambda p: CASE WHEN abs(p[1] - p[2]) < 0.2 THEN 1 ELSE 0 END)) / len(a) <= 0.75""")
def q_stitched_items(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return A.without_adjacent_duplicates(e, ["label"], "vec_id", "embedding", 0.2, 0.75).select("vec_id")


@query("""WITH x AS (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings),
h AS (SELECT vec_id, i, v > 0.05 AS above FROM x),
g AS (SELECT vec_id, above, i - row_number() OVER (PARTITION BY vec_id, above ORDER BY i) AS island FROM h),
r AS (SELECT vec_id, island, count(*) AS n FROM g WHERE above GROUP BY vec_id, island)
SELECT e.vec_id, CAST(coalesce(max(n), 0) AS INT) AS longest FROM embeddings e LEFT JOIN r ON r.vec_id = e.vec_id GROUP BY e.vec_id""")
def q_longest_run(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return e.select("vec_id", A.longest_run(F.col("embedding"), 0.05).alias("longest"))


@query("""WITH x AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i FROM embeddings),
s AS (SELECT a.vec_id, a.i, sum(b.v * (1 - abs(b.i - a.i) / 4.0)) / sum(1 - abs(b.i - a.i) / 4.0) AS v FROM x a JOIN x b ON a.vec_id = b.vec_id AND b.i BETWEEN a.i - 3 AND a.i + 3 GROUP BY a.vec_id, a.i)
SELECT vec_id, round(max(v), 6) AS peak, round(sum(v), 6) AS total FROM s GROUP BY vec_id""")
def q_smoothed(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    s = e.select("vec_id", A.smoothed(F.col("embedding").cast("array<double>"), 3).alias("s"))
    return s.select("vec_id", F.round(F.array_max("s"), 6).alias("peak"), F.round(F.aggregate("s", F.lit(0.0), lambda a, b: a + b), 6).alias("total"))
