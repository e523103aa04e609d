"""Queries over frames: embeddings in rows of pixels, with an edge that a frame's number decides."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chatloom.operators.frames import DividerRules, SeparatorRules, dividers, separators, strip_rows
from chatloom.plans.registry import query


def _smooth_sql(value: str, order: str, reach: int) -> str:
    """SQL of triangular smoothing along a frame."""
    near = [(1 - abs(j) / (reach + 1), f"lag({value}, {-j}) OVER w" if j <= 0 else f"lead({value}, {j}) OVER w") for j in range(-reach, reach + 1)]
    top = " + ".join(f"coalesce({v} * CAST({c} AS DOUBLE), 0)" for c, v in near)
    bottom = " + ".join(f"CASE WHEN {v} IS NOT NULL THEN CAST({c} AS DOUBLE) ELSE 0 END" for c, v in near)
    return f"({top}) / ({bottom})"


_FRAMES_SQL = """SELECT label, vec_id, lag(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS before, embedding FROM embeddings"""


@query(f"""WITH f AS (SELECT label, vec_id, list_concat(before[33:64], embedding) AS pixels FROM ({_FRAMES_SQL}) WHERE before IS NOT NULL),
p AS (SELECT label, vec_id, pixels AS b, lag(pixels) OVER (PARTITION BY label ORDER BY vec_id) AS a FROM f),
k AS (SELECT label, vec_id, b, lag(b) OVER (PARTITION BY label ORDER BY vec_id) AS a FROM p WHERE a IS NULL OR list_sum(list_transform(list_zip(a, b), lambda z: CASE WHEN abs(z[1] - z[2]) < 0.001 THEN 1 ELSE 0 END)) / len(a) <= 0.98),
c AS (SELECT label, vec_id, b, a, unnest(range(1, 10)) AS o FROM k),
s AS (SELECT label, vec_id, o FROM c WHERE a IS NOT NULL AND list_sum(list_transform(list_zip(a[97 - o * 8 : 96], b[1 : o * 8]), lambda z: CASE WHEN abs(z[1] - z[2]) < 0.02 THEN 1 ELSE 0 END)) / (o * 8) > 0.85),
m AS (SELECT k.label, k.vec_id, k.b, coalesce((SELECT max(o) FROM s WHERE s.vec_id = k.vec_id), 0) AS shared FROM k),
t AS (SELECT *, coalesce(sum(12 - shared) OVER (PARTITION BY label ORDER BY vec_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM m)
SELECT label, CAST(start + r - shared AS BIGINT) AS at, vec_id, CAST(r AS INT) AS row, b[r * 8 + 1] AS first_pixel FROM (SELECT *, unnest(range(shared, 12)) AS r FROM t)""")
def q_strip_rows(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    before = F.lag("embedding").over(W.partitionBy("label").orderBy("vec_id"))
    f = e.withColumn("before", before).filter("before IS NOT NULL").select("label", "vec_id", F.concat(F.slice("before", 33, 32), "embedding").alias("pixels"))
    rows = strip_rows(f, "label", "vec_id", "pixels", 8, step=1, tolerance=0.02, same=0.001)
    return rows.select("label", "at", "vec_id", "row", F.get("pixels", F.lit(0)).alias("first_pixel"))


_PANELS_SQL = """(SELECT vec_id // 20 AS frame, CAST(vec_id % 20 AS INT) AS y, CAST(x - 1 AS INT) AS x,
  floor(128 + embedding[x] * CASE WHEN x - 1 < 20 + vec_id // 20 * 7 % 25 THEN 90 ELSE 30 END) + CASE WHEN x - 1 >= 20 + vec_id // 20 * 7 % 25 AND vec_id // 20 % 5 <> 4 THEN 60 ELSE 0 END AS v
  FROM embeddings, (SELECT unnest(range(1, 65)) AS x))"""


@query(f"""WITH px AS {_PANELS_SQL},
e AS (SELECT * FROM (SELECT *, abs(v - lag(v) OVER (PARTITION BY frame, y ORDER BY x)) AS d FROM px) WHERE d IS NOT NULL AND y BETWEEN 2 AND 16),
c AS (SELECT * FROM e WHERE x > 6 AND x < 60),
th AS (SELECT frame, least(30, greatest(8, CASE WHEN d = 0 THEN 15 ELSE d END)) AS th FROM (SELECT frame, d, row_number() OVER (PARTITION BY frame ORDER BY d) AS k, count(*) OVER (PARTITION BY frame) AS n FROM c) WHERE k = floor(n * 0.75) + 1),
a AS (SELECT frame, x, y, d, d > th AS above FROM c JOIN th USING (frame)),
g AS (SELECT *, y - row_number() OVER (PARTITION BY frame, x, above ORDER BY y) AS island FROM a),
r AS (SELECT frame, x, above, island, count(*) AS n, sum(d) AS d FROM g GROUP BY ALL),
q AS (SELECT frame, x, sum(d) / sum(n) * (coalesce(sum(n) FILTER (above), 0) / sum(n)) * (0.5 + 0.5 * coalesce(max(n) FILTER (above), 0) / sum(n)) AS score FROM r GROUP BY frame, x),
s AS (SELECT frame, x, {_smooth_sql("score", "x", 3)} AS smooth FROM q WINDOW w AS (PARTITION BY frame ORDER BY x)),
h AS (SELECT *, x - row_number() OVER (PARTITION BY frame ORDER BY x) AS island FROM (SELECT *, avg(smooth) OVER (PARTITION BY frame) AS mean FROM s) WHERE smooth >= mean * CAST(1.3 AS DOUBLE)),
b AS (SELECT frame, (min(x) + max(x)) // 2 AS center, max(smooth) AS peak FROM h GROUP BY frame, island HAVING max(x) - min(x) >= 2 AND (min(x) + max(x)) // 2 BETWEEN 7 AND 48),
u AS (SELECT b.frame, center, y, d > th AS above FROM e JOIN b ON b.frame = e.frame AND e.x = greatest(1, least(62, center)) JOIN th ON th.frame = b.frame),
v AS (SELECT *, y - row_number() OVER (PARTITION BY frame, center, above ORDER BY y) AS island FROM u),
w AS (SELECT frame, center, above, count(*) AS n FROM v GROUP BY frame, center, above, island),
t AS (SELECT frame, center, coalesce(max(n) FILTER (above), 0) AS run, coalesce(sum(n) FILTER (above), 0) / sum(n) AS coverage FROM w GROUP BY frame, center),
l AS (SELECT b.frame, center, coalesce(avg(d) FILTER (x >= greatest(1, center - 10) AND x < greatest(1, center - 2)), 0) - coalesce(avg(d) FILTER (x >= least(62, center + 2) AND x < least(62, center + 10)), 0) AS delta
  FROM e JOIN b ON b.frame = e.frame GROUP BY b.frame, center),
z AS (SELECT * FROM b JOIN t USING (frame, center) JOIN l USING (frame, center) QUALIFY row_number() OVER (PARTITION BY frame ORDER BY round(run / 15 * 100 + coverage * 20 + greatest(0, delta) + peak * CAST(0.05 AS DOUBLE), 9) DESC, center) = 1)
SELECT f.frame, CAST(coalesce(center, -1) AS INT) AS center, CAST(coalesce(run, -1) AS BIGINT) AS run, coalesce(delta >= 0 AND run / 15 >= 0.55 AND coverage >= 0.1, false) AS confident,
  CAST(CASE WHEN delta >= 0 AND run / 15 >= 0.55 AND coverage >= 0.1 THEN center ELSE 20 END AS INT) AS divider FROM (SELECT DISTINCT frame FROM px) f LEFT JOIN z USING (frame)""")
def q_dividers(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    frame, edge = F.expr("vec_id div 20"), F.expr("20 + vec_id div 20 * 7 % 25")
    px = e.select(frame.alias("frame"), (F.col("vec_id") % 20).cast("int").alias("y"), edge.alias("edge"), F.posexplode("embedding").alias("x", "z"))
    v = F.floor(128 + F.col("z") * F.when(F.col("x") < F.col("edge"), 90).otherwise(30)) + F.when((F.col("x") >= F.col("edge")) & (F.col("frame") % 5 != 4), 60).otherwise(0)
    rules = DividerRules(right_pad=4, panel=8, gap=2, strength_step=1)
    found = dividers(px.select("frame", "y", "x", v.cast("double").alias("v")), 64, 20, rules)
    return found.select("frame", *(F.coalesce(c, F.lit(-1)).alias(c) for c in ("center", "run")), "confident", "divider")


_PAGES_SQL = """(SELECT vec_id // 50 AS frame, CAST(vec_id % 50 AS INT) AS y, CAST(x - 1 AS INT) AS x,
  floor(128 + embedding[x] * 40) + CASE WHEN vec_id % 50 >= 5 + vec_id // 50 % 8 THEN 50 ELSE 0 END + CASE WHEN vec_id % 50 >= 35 + vec_id // 50 % 9 AND vec_id // 50 % 4 <> 3 THEN 50 ELSE 0 END AS v
  FROM embeddings, (SELECT unnest(range(1, 65)) AS x))"""


@query(f"""WITH px AS {_PAGES_SQL},
e AS (SELECT * FROM (SELECT *, abs(v - lag(v) OVER (PARTITION BY frame, x ORDER BY y)) AS d FROM px) WHERE d IS NOT NULL AND x % 2 = 0),
n AS (SELECT frame, y, avg(d) AS energy FROM e GROUP BY frame, y),
s AS (SELECT frame, y, {_smooth_sql("energy", "y", 1)} AS smooth FROM n WINDOW w AS (PARTITION BY frame ORDER BY y)),
th AS (SELECT frame, least(25, greatest(6, CASE WHEN smooth = 0 THEN 10 ELSE smooth END)) AS th FROM (SELECT frame, smooth, row_number() OVER (PARTITION BY frame ORDER BY smooth) AS k, count(*) OVER (PARTITION BY frame) AS n FROM s) WHERE k = floor(n * 0.75) + 1),
m AS (SELECT *, avg(smooth) OVER (PARTITION BY frame) AS mean, CASE WHEN y - 1 BETWEEN 2 AND 14 THEN 0 WHEN y - 1 BETWEEN 32 AND 46 THEN 1 END AS zone FROM s),
h AS (SELECT *, y - row_number() OVER (PARTITION BY frame ORDER BY y) AS island FROM m WHERE smooth >= mean * 1.25 AND zone IS NOT NULL),
p AS (SELECT frame, zone, y, smooth AS peak FROM h QUALIFY row_number() OVER (PARTITION BY frame, zone, island ORDER BY smooth DESC, y) = 1),
c AS (SELECT p.frame, zone, p.y, peak, count(*) FILTER (d > th) / count(*) AS coverage FROM p JOIN e ON e.frame = p.frame AND e.y = p.y JOIN th ON th.frame = p.frame GROUP BY ALL),
b AS (SELECT frame, zone, y FROM c WHERE coverage >= 0.55 QUALIFY row_number() OVER (PARTITION BY frame, zone ORDER BY round(peak + coverage * 20, 9) DESC, y) = 1),
f AS (SELECT frame, max(y) FILTER (zone = 0) AS top, max(y) FILTER (zone = 1) AS bottom FROM (SELECT DISTINCT frame FROM px) LEFT JOIN b USING (frame) GROUP BY frame),
o AS (SELECT *, coalesce(bottom, 44) - coalesce(top, 6) >= 10 AS fits FROM f)
SELECT frame, CAST(CASE WHEN fits THEN coalesce(top, 6) ELSE 6 END AS INT) AS header_bottom, CAST(CASE WHEN fits THEN coalesce(bottom, 44) ELSE 44 END AS INT) AS input_top,
  CAST((CASE WHEN top IS NULL THEN 0 ELSE 1 END + CASE WHEN bottom IS NULL THEN 0 ELSE 1 END) AS DOUBLE) / 2 AS confidence FROM o""")
def q_separators(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    px = e.select(F.expr("vec_id div 50").alias("frame"), (F.col("vec_id") % 50).cast("int").alias("y"), F.posexplode("embedding").alias("x", "z"))
    head = F.when(F.col("y") >= 5 + F.col("frame") % 8, 50).otherwise(0)
    foot = F.when((F.col("y") >= 35 + F.col("frame") % 9) & (F.col("frame") % 4 != 3), 50).otherwise(0)
    v = F.floor(128 + F.col("z") * 40) + head + foot
    return separators(px.select("frame", "y", "x", v.cast("double").alias("v")), 50, SeparatorRules(reach=1, least_gap=10))
