"""Ingestion as a stream: each epoch is written once, whatever is tried again.

A store is a folder of three tables, partitioned by epoch: ``messages`` that are kept, ``met`` (what passed the first rule of
:func:`chatloom.operators.dedup.ingest`, by which later epochs judge), and ``ledger``, whose entry commits an epoch.  An epoch reads only what
earlier epochs committed and overwrites only its own partitions, so one that stopped half-way leaves nothing that counts, and
one that is committed is skipped when it comes again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatloom.functions.text import KEY_CHARS
from chatloom.operators import dedup as D

_MESSAGES = "idx long, room_name string, sender string, content string, timestamp long"
_MET = "room_name string, sender string, head string, content string, timestamp long"
_LEDGER = "kept long"


def _table(spark: SparkSession, store: str, name: str, schema: str) -> DataFrame:
    """A table of the store with its epoch; there is always an epoch -1, without rows that count."""
    return spark.read.schema(f"{schema}, epoch long").parquet(f"{store}/{name}")


def open_store(spark: SparkSession, store: str) -> str:
    """Lay out an empty store in a new folder."""
    for name, schema in (("messages", _MESSAGES), ("met", _MET)):
        spark.createDataFrame([], schema).write.parquet(f"{store}/{name}/epoch=-1")
    spark.createDataFrame([(0,)], _LEDGER).write.parquet(f"{store}/ledger/epoch=-1")
    return store


def committed(spark: SparkSession, store: str) -> int:
    """The last epoch that counts."""
    return _table(spark, store, "ledger", _LEDGER).agg(F.max("epoch")).first()[0]


def stored(spark: SparkSession, store: str) -> DataFrame:
    """The messages of all committed epochs, with their epoch."""
    return _table(spark, store, "messages", _MESSAGES).filter(F.col("epoch") <= committed(spark, store))


def ingest_epoch(batch: DataFrame, epoch: int, store: str, existing: DataFrame, as_of_ms: int, allowed: list[str], within_ms: int = 60000) -> bool:
    """Ingest one micro-batch (idx, room_name, sender, content, timestamp); False if its epoch is committed already.

    Over epochs in order of idx, what is stored equals :func:`chatloom.operators.dedup.ingest` over all of them at once.
    """
    spark = batch.sparkSession
    if epoch <= committed(spark, store):
        return False
    met = _table(spark, store, "met", _MET).filter(F.col("epoch") < epoch)
    rows = D.first_of_cache_keys(batch, allowed)
    keys = met.select(F.col("room_name").alias("_room"), F.col("sender").alias("_sender"), "head").distinct()
    same = F.col("room_name").eqNullSafe(F.col("_room")) & F.col("sender").eqNullSafe(F.col("_sender")) & (F.substring("content", 1, KEY_CHARS) == F.col("head"))
    rows = rows.join(keys, same, "left_anti").select("idx", "room_name", "sender", "content", "timestamp")
    rows.select("room_name", "sender", F.substring("content", 1, KEY_CHARS).alias("head"), "content", "timestamp").write.mode("overwrite").parquet(f"{store}/met/epoch={epoch}")
    kept = D.unknown_in_room(rows, as_of_ms, within_ms)
    for known in (existing, met):
        kept = D.known_in_room(kept, known, as_of_ms, within_ms)
    kept.write.mode("overwrite").parquet(f"{store}/messages/epoch={epoch}")
    n = spark.read.schema(_MESSAGES).parquet(f"{store}/messages/epoch={epoch}").count()
    spark.createDataFrame([(n,)], _LEDGER).write.mode("overwrite").parquet(f"{store}/ledger/epoch={epoch}")
    return True


def ingest_sink(store: str, existing: DataFrame, as_of_ms: int, allowed: list[str], within_ms: int = 60000) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that ingests each micro-batch into the store once."""

    def sink(batch: DataFrame, epoch: int) -> None:
        batch.persist()
        try:
            ingest_epoch(batch, epoch, store, existing, as_of_ms, allowed, within_ms)
        finally:
            batch.unpersist()

    return sink

