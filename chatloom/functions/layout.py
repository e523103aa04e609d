"""Geometry, names and bands as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chatloom.functions.text import js_round, safe_name

# Logical screen sizes and their scale.
SCREEN_SCALES = {"2560x1440": 1.5, "3072x1728": 1.25, "1920x1080": 2.0, "2048x1152": 1.25, "3200x1800": 1.25}


def screen_scale(width: Column, height: Column) -> Column:
    known = F.create_map(*(F.lit(x) for pair in SCREEN_SCALES.items() for x in pair))
    return F.coalesce(F.try_element_at(known, F.concat_ws("x", width.cast("string"), height.cast("string"))), F.lit(1.0))


def clamped_box(box: Column, width: Column, height: Column) -> Column:
    """struct<x, y, width, height> inside an image, of a pixel at least."""
    x = F.greatest(F.lit(0), F.least(box["x"], width - 1))
    y = F.greatest(F.lit(0), F.least(box["y"], height - 1))
    return F.struct(x.alias("x"), y.alias("y"), F.greatest(F.lit(1), F.least(box["width"], width - x)).alias("width"), F.greatest(F.lit(1), F.least(box["height"], height - y)).alias("height"))


def click_offset(size: Column) -> Column:
    return F.least(F.lit(40), js_round(size * 0.15))


def title_matches(title: Column, words: list[str], exact: list[str]) -> Column:
    """Does a window title hold one of the words in any case, or one of the exact texts?  Empty titles don't."""
    hit = F.lit(False)
    for word in words:
        hit = hit | F.lower(title).contains(word)
    for text in exact:
        hit = hit | title.contains(text)
    return F.coalesce(hit & (title != ""), F.lit(False))


def attachment_path(room: Column, digest: Column, extension: Column) -> Column:
    return F.concat(F.lit("data/attachments/"), safe_name(room), F.lit("/"), digest, F.lit("."), extension)


def is_text_line(y: Column, text: Column) -> Column:
    """Recognised lines that are no noise: not at the very top, of two characters at least."""
    return (y > 5) & (F.length(text) > 1)


def is_text_box(y0: Column, width: Column, height: Column) -> Column:
    return (y0 >= 10) & (width >= 5) & (height >= 5)


def bands(points: DataFrame, group: str, x: str, score: str, factor: float = 1.3, gap: int = 2, least_width: int = 2) -> DataFrame:
    """(group, start_x, end_x, center_x, max_score) of neighbouring points whose score is at least ``factor`` times the
    group's mean; a point below it, or a gap of more than ``gap``, ends a band, and narrow bands are left out."""
    w = W.partitionBy(group).orderBy(x)
    rows = points.withColumn("_high", F.col(score) >= F.avg(score).over(W.partitionBy(group)) * factor)
    breaks = ~F.col("_high") | F.coalesce(F.col(x) - F.lag(x).over(w) > gap, F.lit(True))
    rows = rows.withColumn("_band", F.sum(breaks.cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0))).filter("_high")
    # a low point before a high one has begun the band's number already, so numbers tell bands apart
    found = rows.groupBy(group, "_band").agg(F.min(x).alias("start_x"), F.max(x).alias("end_x"), F.max(score).alias("max_score"))
    found = found.filter(F.col("end_x") - F.col("start_x") >= least_width)
    return found.select(group, "start_x", "end_x", F.floor((F.col("start_x") + F.col("end_x")) / 2).alias("center_x"), "max_score")


def weighted_mean(value: Column, weight: Column) -> Column:
    """Aggregate; null where all weights are 0."""
    return F.sum(value * weight) / F.nullif(F.sum(weight), F.lit(0))


def setting_number(value: Column, default: int) -> Column:
    """A setting's leading whole number; the default if the setting is missing or empty, null if it has no number."""
    digits = F.regexp_extract(value, "^\\s*([+-]?[0-9]+)", 1)
    return F.when(F.coalesce(value, F.lit("")) == "", F.lit(default)).when(digits != "", digits.cast("int"))


def setting_flag(value: Column, default: bool) -> Column:
    return F.when(F.coalesce(value, F.lit("")) == "", F.lit(default)).otherwise(F.lower(value) == "true")
