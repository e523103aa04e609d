"""The message table: schema, and message views over the event, conversation and document tables.

Times are Unix milliseconds truncated to the minute, as displayed times are; ``created_at`` is in seconds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MESSAGE = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("message_id", T.StringType()),
        T.StructField("room_id", T.StringType()),
        T.StructField("room_name", T.StringType()),
        T.StructField("talker_id", T.StringType()),
        T.StructField("talker_name", T.StringType()),
        T.StructField("content", T.StringType()),
        T.StructField("message_type", T.StringType()),
        T.StructField("timestamp", T.LongType()),
        T.StructField("msg_index", T.IntegerType()),
        T.StructField("raw_data", T.StringType()),
        T.StructField("created_at", T.LongType()),
    ]
)

AS_OF_MS = 1706788800000
"""2024-02-01T12:00:00Z: the fixed "now" of the queries."""


def event_millis(ts: Column | str = "ts") -> Column:
    """Milliseconds of a zoneless timestamp, whatever the session's zone is."""
    name = ts if isinstance(ts, str) else "ts"
    return F.floor(F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', {name})") / 1000)


def to_minute(ms: Column) -> Column:
    return F.floor(ms / 60000) * 60000


def messages_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    user = F.concat(F.lit("user_"), F.col("user_id").cast("string"))
    return e.select(
        (F.col("event_id") + 1).alias("id"),
        F.concat(F.lit("evt_"), F.col("event_id").cast("string")).alias("message_id"),
        F.col("event_type").alias("room_id"),
        F.col("event_type").alias("room_name"),
        user.alias("talker_id"),
        user.alias("talker_name"),
        F.col("props").alias("content"),
        F.lit("text").alias("message_type"),
        to_minute(event_millis()).alias("timestamp"),
        (F.col("event_id") % 10).cast("int").alias("msg_index"),
        F.col("props").alias("raw_data"),
        F.floor(event_millis() / 1000).alias("created_at"),
    )


def messages_from_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    room = F.concat(F.lit("conv_"), F.col("conv_id").cast("string"))
    return c.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("id"),
        F.concat_ws("_", F.lit("msg"), F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("message_id"),
        room.alias("room_id"),
        room.alias("room_name"),
        F.col("role").alias("talker_id"),
        F.col("role").alias("talker_name"),
        F.col("text").alias("content"),
        F.lit("text").alias("message_type"),
        (F.lit(1704067200000) + F.col("conv_id") * 3600000 + F.expr("turn div 2") * 60000).alias("timestamp"),
        F.col("turn").cast("int").alias("msg_index"),
        F.lit(None).cast("string").alias("raw_data"),
        (F.lit(1704067200) + F.col("conv_id") * 3600 + F.expr("turn div 2") * 60).alias("created_at"),
    )


def messages_from_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return d.select(
        F.col("doc_id").alias("id"),
        F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("message_id"),
        F.col("source").alias("room_id"),
        F.col("source").alias("room_name"),
        F.col("lang").alias("talker_id"),
        F.col("lang").alias("talker_name"),
        F.col("text").alias("content"),
        F.lit("text").alias("message_type"),
        (F.lit(AS_OF_MS) - (F.col("doc_id") % 7) * 20000).alias("timestamp"),
        F.lit(0).alias("msg_index"),
        F.lit(None).cast("string").alias("raw_data"),
        F.lit(AS_OF_MS // 1000).cast("long").alias("created_at"),
    )


def message_view(messages: DataFrame, name: str = "messages") -> DataFrame:
    """The rows by the schema of the table, as a view that ``spark.sql`` may name."""
    table = messages.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in MESSAGE.fields))
    table.createOrReplaceTempView(name)
    return table


EVENTS_SQL = """(SELECT event_id + 1 AS id, 'evt_' || event_id AS message_id, event_type AS room_id, event_type AS room_name,
  'user_' || user_id AS talker_id, 'user_' || user_id AS talker_name, props AS content, 'text' AS message_type,
  (epoch_us(ts) // 60000000) * 60000 AS timestamp, CAST(event_id % 10 AS INT) AS msg_index, props AS raw_data, epoch_us(ts) // 1000000 AS created_at FROM events)"""
CONVERSATIONS_SQL = """(SELECT conv_id * 1000 + turn AS id, 'msg_' || conv_id || '_' || turn AS message_id, 'conv_' || conv_id AS room_id,
  'conv_' || conv_id AS room_name, role AS talker_id, role AS talker_name, text AS content, 'text' AS message_type,
  1704067200000 + conv_id * 3600000 + (turn // 2) * 60000 AS timestamp, CAST(turn AS INT) AS msg_index,
  CAST(NULL AS VARCHAR) AS raw_data, 1704067200 + conv_id * 3600 + (turn // 2) * 60 AS created_at FROM conversations)"""
DOCUMENTS_SQL = """(SELECT doc_id AS id, 'doc_' || doc_id AS message_id, source AS room_id, source AS room_name, lang AS talker_id,
  lang AS talker_name, text AS content, 'text' AS message_type, 1706788800000 - (doc_id % 7) * 20000 AS timestamp, 0 AS msg_index,
  CAST(NULL AS VARCHAR) AS raw_data, 1706788800 AS created_at FROM documents)"""
