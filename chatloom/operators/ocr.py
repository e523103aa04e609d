"""Timestamps from recognised fragments, and what is decided from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatloom.functions.timeparse import parse_timestamp

CLOCK_TOKEN = "^[0-9]{1,2}[:：][0-9]{2}\\z"
SMALL_NUMBER = "^[0-9]{1,2}\\z"


def time_candidates(tokens: Column) -> list[Column]:
    """Texts to try as a timestamp, the most certain first: dates rebuilt from the tokens before the first clock
    token (five tokens with both signs, then three without), and all tokens joined."""
    clocks = F.transform(tokens, lambda t: t.rlike(CLOCK_TOKEN))
    at = F.array_position(clocks, True)  # 1-based, 0 without one

    def back(n: int) -> Column:
        return F.when(at - n >= 1, F.get(tokens, (at - n - 1).cast("int")))

    clock = F.get(tokens, (at - 1).cast("int"))
    number = lambda c: F.coalesce(c.rlike(SMALL_NUMBER), F.lit(False))
    long_form = F.when((at >= 5) & number(back(4)) & (back(3) == "月") & number(back(2)) & back(1).isin("日", "号"), F.concat(back(4), F.lit("月"), back(2), back(1), clock))
    short_form = F.when((at >= 1) & number(back(2)) & number(back(1)), F.concat(back(2), F.lit("月"), back(1), F.lit("日"), clock))
    return [long_form, short_form, F.array_join(tokens, "")]


def line_times(lines: DataFrame, as_of_ms: int, tokens: str = "tokens", tz: str = "UTC") -> DataFrame:
    """``lines`` with the first candidate text that parses and its parsed parts; null where none does."""
    long_form, short_form, joined = time_candidates(F.col(tokens))
    tried = lines.withColumns({"_t0": long_form, "_t1": short_form, "_t2": joined})
    tried = tried.withColumns({f"_p{i}": parse_timestamp(F.col(f"_t{i}"), as_of_ms, tz, signs_only=i < 2) for i in range(3)})
    text = F.coalesce(*(F.when(F.col(f"_p{i}").isNotNull(), F.col(f"_t{i}")) for i in range(3)))
    return tried.select(*lines.columns, text.alias("time_text"), F.coalesce("_p0", "_p1", "_p2").alias("parsed"))


def wants_recognition(enabled: Column, stopped: Column, has_new: Column, has_checkpoint: Column, stamps: Column, scrolls: Column) -> Column:
    """Recognise a screenshot if enabled and not stopped, and it has news, or no checkpoint is known, or it is the first and shows no time."""
    return enabled & ~stopped & (has_new | ~has_checkpoint | ((stamps == 0) & (scrolls == 0)))


def evicted(cache: DataFrame, as_of_ms: int, most: int = 1000, age_ms: int = 60000) -> DataFrame:
    """A cache (key, timestamp) after eviction: with more than ``most`` entries, old ones go."""
    size = cache.agg(F.count(F.lit(1)).alias("_size"))  # one row
    return cache.join(F.broadcast(size)).filter((F.col("_size") <= most) | (F.col("timestamp") >= as_of_ms - age_ms)).drop("_size")
