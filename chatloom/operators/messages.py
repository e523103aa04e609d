"""The read and write operations on a message table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def newest_first() -> list[Column]:
    """Newest minute first, then position on the screen; id makes the order total."""
    return [F.col("timestamp").desc_nulls_last(), F.col("msg_index").asc_nulls_first(), F.col("id").asc()]


def as_limit(value: int | str | None, default: int) -> int | None:
    """A request's limit: 0, nothing or no number is the default, a leading number counts, negative means no limit."""
    digits = str(value if value is not None else "").strip()
    sign = digits[:1] == "-"
    head = "".join(c if c.isdigit() else " " for c in digits.lstrip("+-")).split(" ")[0]
    n = int(head) if head else 0
    return default if not n else None if sign else n


def limited(df: DataFrame, limit: int | None, offset: int = 0) -> DataFrame:
    df = df.offset(offset) if offset else df
    return df if limit is None else df.limit(limit)


def query_messages(messages: DataFrame, since: int | None = None, until: int | None = None, room: str | None = None, limit: int | str | None = None) -> DataFrame:
    """Messages with all given predicates, newest first; both bounds are inclusive, an empty room is no predicate."""
    for bound in (since, until):
        if bound is not None and not isinstance(bound, int):
            raise ValueError("since and until are milliseconds")
    predicates = [F.col("timestamp") >= since if since is not None else None, F.col("timestamp") <= until if until is not None else None, F.col("room_name") == room if room else None]
    for p in predicates:
        messages = messages if p is None else messages.filter(p)
    return limited(messages.orderBy(*newest_first()), as_limit(limit, 100))


def status_feed(messages: DataFrame, limit: int | str | None = None) -> DataFrame:
    columns = {"room_name": "roomName", "talker_name": "talkerName", "content": "content", "timestamp": "timestamp"}
    feed = limited(messages.orderBy(*newest_first()), as_limit(limit, 200))
    return feed.select(*(F.col(a).alias(b) for a, b in columns.items()))


def in_time_range(messages: DataFrame, start: int, end: int, limit: int = 1000) -> DataFrame:
    return messages.filter(F.col("timestamp").between(start, end)).orderBy(*newest_first()).limit(limit)


def room_page(messages: DataFrame, room_id: str, limit: int = 100, offset: int = 0) -> DataFrame:
    return limited(messages.filter(F.col("room_id") == room_id).orderBy(*newest_first()), limit, offset)


def allowed_rooms(messages: DataFrame, allowed: list[str]) -> DataFrame:
    """Rooms whose name contains one of the allowed strings; an empty list allows all."""
    keep = F.lit(not allowed)
    for part in allowed:
        keep = keep | F.col("room_name").contains(part)
    return messages.filter(keep)


def rooms(messages: DataFrame) -> DataFrame:
    return messages.select("room_name").distinct().orderBy(F.col("room_name").asc_nulls_first())


def room_counts(messages: DataFrame) -> DataFrame:
    return messages.groupBy("room_name").agg(F.count(F.lit(1)).alias("n"))


def retained(messages: DataFrame, cutoff: int) -> DataFrame:
    """What a deletion of everything before ``cutoff`` leaves; messages without a time stay."""
    return messages.filter((F.col("timestamp") >= cutoff) | F.col("timestamp").isNull())


def insert_ignore(existing: DataFrame, batch: DataFrame) -> DataFrame:
    """The rows of ``batch`` that get in: the first of each message_id that isn't there yet; null ids always do."""
    first = F.row_number().over(W.partitionBy("message_id").orderBy("id"))
    once = batch.withColumn("_nth", first).filter((F.col("_nth") == 1) | F.col("message_id").isNull()).drop("_nth")
    return once.join(existing.select("message_id"), "message_id", "left_anti").select(batch.columns)


# The fields of a webhook's payload and the columns they hold.
PAYLOAD = (("messageId", "message_id"), ("roomId", "room_id"), ("roomName", "room_name"), ("talkerId", "talker_id"), ("talkerName", "talker_name"), ("content", "content"), ("messageType", "message_type"), ("timestamp", "timestamp"))


def webhook_payload() -> Column:
    """The JSON that a webhook receives for a message."""
    return F.to_json(F.struct(*(F.col(c).alias(name) for name, c in PAYLOAD)))
