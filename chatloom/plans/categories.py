"""Query over the category decision."""

from __future__ import annotations

from pyspark.sql import functions as F

from chatloom.operators.categories import category_positions
from chatloom.plans.registry import query

_TEXTS = ["搜索网络结果", "alpha team", "beta", "群 聊", "群获", "gamma room", "x", "联系人", "delta", "搜一搜 more", "epsilon", "功能", "zeta zeta"]
_LIST = ", ".join(f"'{t}'" for t in _TEXTS)
_HEADER = "(contains(bare, '群聊') OR regexp_matches(bare, '^群[获了人友闭]') OR contains(bare, '联系人') OR starts_with(bare, '联系') OR contains(bare, '功能'))"


@query(f"""WITH l AS (SELECT event_id // 12 AS page, event_id % 12 AS line, CAST((event_id % 12) * (9 + (event_id // 12) % 23) + (event_id * 7) % 5 AS BIGINT) AS y,
    replace([{_LIST}][CAST((event_id * 5 + event_id // 12 * 3 + CAST(floor(value) AS BIGINT)) % {len(_TEXTS)} AS INT) + 1], ' ', '') AS bare FROM events),
f AS (SELECT *, contains(bare, '群聊') OR regexp_matches(bare, '^群[获了人友闭]') AS fits, {_HEADER} AS header, contains(bare, '搜索') AS asks,
    contains(bare, '搜索') OR contains(bare, '搜一搜') AS suggests, y > 5 AND length(bare) > 1 AS counts FROM l),
c AS (SELECT page, arg_min(y, line) AS cy FROM f WHERE fits GROUP BY page),
k AS (SELECT f.*, cy, y - lag(y) OVER (PARTITION BY page ORDER BY y, line) AS gap, row_number() OVER (PARTITION BY page ORDER BY y, line) AS nth FROM f JOIN c USING (page) WHERE counts),
p AS (SELECT page, max(CASE WHEN nth = 1 AND header THEN 1 ELSE 0 END) AS first_header, max(CASE WHEN nth = 1 AND asks THEN 1 ELSE 0 END) AS first_asks, min(y) AS first_y,
    min(nth) FILTER (y > cy AND header) AS next_nth, min(nth) FILTER (y > cy AND NOT header AND NOT suggests) AS item_nth, min(y) FILTER (y > cy AND NOT header AND NOT suggests) AS item_y,
    count(*) FILTER (y < cy) AS n_before, coalesce(median(gap) FILTER (y <= cy AND gap > 0 AND gap < 200), 50) AS height FROM k GROUP BY page)
SELECT page, cy AS category_y, CAST(CASE WHEN first_header = 1 THEN 0 WHEN first_asks = 1 THEN n_before WHEN cy < 50 OR item_nth IS NULL OR item_nth > next_nth THEN 1
  ELSE greatest(0, floor((item_y - first_y) / height + 0.5) - 1) END AS BIGINT) AS down_count FROM c JOIN p USING (page)""")
def q_category_position(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    page, line = F.expr("event_id div 12"), F.col("event_id") % 12
    y = line * (9 + page % 23) + (F.col("event_id") * 7) % 5
    nth = (F.col("event_id") * 5 + page * 3 + F.floor("value")) % len(_TEXTS) + 1
    text = F.element_at(F.array(*map(F.lit, _TEXTS)), nth.cast("int"))
    return category_positions(e.select(page.alias("page"), line.alias("line"), y.alias("y"), text.alias("text")), "群聊")
