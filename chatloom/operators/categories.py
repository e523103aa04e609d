"""Where a category begins among recognised lines, and how many steps lead from the first line to its first item.

Every page is decided by comparisons of (y, number of the line): the first header that fits, the next header after it, and the first item between
the two, an as-of step that looks ahead only.  All pages go through one shuffle; a page's lines are aggregated, never collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chatloom.functions.text import fuzzy_match, without_space

# The headers of categories, and what marks a search suggestion.
CATEGORIES = ("群聊", "联系人", "功能")
SUGGESTIONS = ("搜索", "搜一搜")
NOISE_Y, TOP_Y, MOST_GAP, DEFAULT_HEIGHT = 5, 50, 200, 50


def _any(tests: list[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


def category_positions(lines: DataFrame, category: str, page: str = "page", order: str = "line", y: str = "y", text: str = "text") -> DataFrame:
    """(page, category_y, down_count) of the pages that have the category's header.  ``lines``: page, line (reading order), y, text.

    The count is 0 if the first line is a header (its first result is selected), all lines before the category if the first
    line is a search suggestion, 1 if the category is at the top or has no item, else the distance from the first line to the first
    item in units of the median gap between lines up to the category, less 1 and at least 0.
    """
    bare = without_space(F.col(text))
    header = _any([fuzzy_match(bare, F.lit(c)) for c in CATEGORIES])
    rows = lines.select(
        F.col(page), F.col(order).alias("_nth"), F.col(y).alias("_y"), F.struct(F.col(y).alias("y"), F.col(order).alias("nth")).alias("_at"),
        fuzzy_match(bare, F.lit(category)).alias("_fits"), header.alias("_header"), bare.contains(SUGGESTIONS[0]).alias("_asks"),
        _any([bare.contains(s) for s in SUGGESTIONS]).alias("_suggests"), ((F.col(y) > NOISE_Y) & (F.length(bare) > 1)).alias("_counts"),
    )
    of_page = W.partitionBy(page)
    rows = rows.withColumn("_c", F.min(F.when(F.col("_fits"), F.struct("_nth", "_y"))).over(of_page)["_y"]).filter(F.col("_c").isNotNull())
    gap = F.col("_y") - F.lag("_y").over(W.partitionBy(page, "_counts").orderBy("_at"))
    rows = rows.withColumn("_gap", F.when(F.col("_counts") & (F.col("_y") <= F.col("_c")) & (gap > 0) & (gap < MOST_GAP), gap))
    counts, after = F.col("_counts"), F.col("_counts") & (F.col("_y") > F.col("_c"))
    of = rows.groupBy(page).agg(
        F.first("_c").alias("category_y"),
        F.min(F.when(counts, F.struct("_at", "_header", "_asks"))).alias("_first"),
        F.min(F.when(after & F.col("_header"), F.col("_at"))).alias("_next"),
        F.min(F.when(after & ~F.col("_header") & ~F.col("_suggests"), F.col("_at"))).alias("_item"),
        F.count_if(counts & (F.col("_y") < F.col("_c"))).alias("_before"),
        F.coalesce(F.median("_gap"), F.lit(float(DEFAULT_HEIGHT))).alias("_height"),
    )
    found = F.col("_item").isNotNull() & (F.col("_next").isNull() | (F.col("_item") < F.col("_next")))
    steps = F.floor((F.col("_item")["y"] - F.col("_first")["_at"]["y"]) / F.col("_height") + 0.5) - 1
    count = F.when(F.col("_first")["_header"], 0).when(F.col("_first")["_asks"], F.col("_before")).when((F.col("category_y") < TOP_Y) | ~found, 1)
    return of.select(page, "category_y", count.otherwise(F.greatest(F.lit(0), steps)).cast("long").alias("down_count"))
