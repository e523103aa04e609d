"""What the data routes return, as DataFrames: request parameters in, rows out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatloom.operators import messages as M


def _millis(value: str | int | None) -> int | None:
    if value in (None, ""):
        return None
    if not str(value).lstrip("-").isdigit():
        raise ValueError("since and until are milliseconds")
    return int(value)


def get_messages(messages: DataFrame, since: str | None = None, until: str | None = None, room: str | None = None, limit: str | None = None) -> DataFrame:
    return M.query_messages(messages, _millis(since), _millis(until), room, limit)


def get_rooms(messages: DataFrame) -> DataFrame:
    return M.rooms(messages)


def get_count(messages: DataFrame) -> DataFrame:
    return messages.agg(F.count(F.lit(1)).alias("count"))


def get_status(messages: DataFrame, limit: str | None = None) -> DataFrame:
    return M.status_feed(messages, limit)


def patrol_status(counters: DataFrame, running: bool, settings: dict) -> DataFrame:
    """One row: whether a patrol runs, its settings, and its counters."""
    return counters.select(F.lit(running).alias("running"), *(F.lit(v).alias(k) for k, v in settings.items() if not isinstance(v, list)), F.array(*map(F.lit, settings.get("targets", []))).alias("targets"), F.struct(*counters.columns).alias("counters"))


def patrol_settings(interval: int | None = None, cap: int | None = None, targets: list | None = None) -> dict:
    """Validated settings; a bad value is refused as a bad request would be."""
    if interval is not None and interval < 1000:
        raise ValueError("interval must be at least 1000 ms")
    if cap is not None and cap < 0:
        raise ValueError("cap must not be negative")
    if targets is not None and not isinstance(targets, list):
        raise ValueError("targets must be a list")
    return {k: v for k, v in {"interval": interval, "cap": cap, "targets": targets}.items() if v is not None}
