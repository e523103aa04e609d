"""The layers of deduplication and what goes with them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chatloom.functions.text import KEY_CHARS, norm_content
from chatloom.operators.windows import window_starts

CLOCK_TAIL = "([0-9]{1,2}:[0-9]{2})\\z"


def present(c: Column) -> Column:
    """Null where empty."""
    return F.when(c != "", c)


def fill_times(rows: DataFrame, batch: str = "batch", order: str = "idx", time: str = "time") -> DataFrame:
    """Empty times take the nearest time above, leading ones the first time below."""
    w = W.partitionBy(batch).orderBy(order)
    above = F.last(present(F.col(time)), True).over(w.rowsBetween(W.unboundedPreceding, 0))
    below = F.first(present(F.col(time)), True).over(w.rowsBetween(0, W.unboundedFollowing))
    return rows.withColumn(time, F.coalesce(above, below))


def normalize_tokens(rows: DataFrame, batch: str = "batch", order: str = "idx", time: str = "time") -> DataFrame:
    """Times that end in the same HH:mm take the longest form in their batch, the first of equals."""
    key = F.regexp_extract(F.coalesce(F.col(time), F.lit("")), CLOCK_TAIL, 1)
    w = W.partitionBy(batch, "_hm").orderBy(F.length(time).desc(), order)
    longest = F.first(time).over(w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    return rows.withColumn("_hm", key).withColumn(time, F.when(F.col("_hm") == "", F.col(time)).otherwise(longest)).drop("_hm")


def dedup_batch(rows: DataFrame, batch: str = "batch", order: str = "idx") -> DataFrame:
    """One row for each content of a batch (blank ones go), first content kept, sender and time from the first duplicate
    that has one; then times are filled and made canonical."""
    rows = rows.withColumn("_norm", norm_content(F.col("content"))).filter("_norm <> ''")
    w = W.partitionBy(batch, "_norm").orderBy(order)
    every = w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    rows = rows.withColumns({c: F.first(present(F.col(c)), True).over(every) for c in ("sender", "time")} | {"_nth": F.row_number().over(w)})
    rows = rows.filter("_nth = 1").drop("_nth", "_norm")
    return normalize_tokens(fill_times(rows, batch, order), batch, order)


def content_digest(c: Column) -> Column:
    """32 bytes that tell apart what :func:`norm_content` tells apart (SHA-256); never null."""
    return F.coalesce(F.unhex(F.sha2(norm_content(c), 256)), F.lit(b""))


def known_in_room(batch: DataFrame, existing: DataFrame, as_of_ms: int, within_ms: int = 60000, how: str = "left_anti") -> DataFrame:
    """Rows of ``batch`` that no (anti) or some (semi) message of the room with equal content, newer than the window's start, matches.

    Contents are compared by digests that are columns before the join: each is normalised once, and its text is neither sorted nor, for the join, moved.
    """
    recent = existing.filter(F.col("timestamp") > as_of_ms - within_ms).select(F.col("room_name").alias("_room"), content_digest(F.col("content")).alias("_known")).distinct()
    same = (F.col("room_name") == F.col("_room")) & (F.col("_digest") == F.col("_known"))
    return batch.withColumn("_digest", content_digest(F.col("content"))).join(recent, same, how).drop("_digest")


def first_by_key(rows: DataFrame, keys: list[Column], order: str) -> DataFrame:
    """Unbounded deduplication: the first row of each key, whose parts are compared one by one (nulls equal nulls)."""
    return rows.withColumn("_nth", F.row_number().over(W.partitionBy(*keys).orderBy(order))).filter("_nth = 1").drop("_nth")


def seen_cache(rows: DataFrame, keys: list[str], time: str, window_ms: int) -> DataFrame:
    """Rows kept by a cache in which a key is a duplicate for ``window_ms`` after its last *kept* row."""
    windows = window_starts(rows, keys, time, window_ms)
    return windows.filter(F.col("start") == F.col(time)).select(*keys, time)


def first_of_cache_keys(batch: DataFrame, allowed: list[str]) -> DataFrame:
    """The rows of allowed rooms that say something, the first of each cache key.  ``batch``: idx, room_name, sender, content, timestamp."""
    keep = F.lit(not allowed)
    for part in allowed:
        keep = keep | F.col("room_name").contains(part)
    rows = batch.filter(keep).withColumn("content", F.coalesce("content", F.lit(""))).filter(norm_content(F.col("content")) != "")
    return first_by_key(rows, [F.col("room_name"), F.col("sender"), F.substring("content", 1, KEY_CHARS)], "idx")


def unknown_in_room(rows: DataFrame, as_of_ms: int, within_ms: int = 60000) -> DataFrame:
    """Rows whose content no row before them (by idx) has in the room within the window."""
    earlier = W.partitionBy("room_name", "_norm").orderBy("idx").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("_norm", norm_content(F.col("content"))).withColumn("_newest", F.max("timestamp").over(earlier))
    return rows.filter(F.col("_newest").isNull() | (F.col("_newest") <= as_of_ms - within_ms)).drop("_newest", "_norm")


def ingest(batch: DataFrame, existing: DataFrame, as_of_ms: int, allowed: list[str], within_ms: int = 60000) -> DataFrame:
    """The messages of a batch that are stored: allowed rooms, the first of each cache key, then none whose content is in
    the room already, from before or from earlier in the batch, within the window.

    ``batch``: idx, room_name, sender, content, timestamp.
    """
    rows = unknown_in_room(first_of_cache_keys(batch, allowed), as_of_ms, within_ms)
    return known_in_room(rows, existing, as_of_ms, within_ms)
