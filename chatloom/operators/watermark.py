"""Watermarks over screenshot sequences: how far back a patrol looks, and where the next one starts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def shot_range(stamps: DataFrame) -> DataFrame:
    """(target, shot, min_epoch, max_epoch) of the epochs seen on each shot."""
    return stamps.groupBy("target", "shot").agg(F.min("epoch_ms").alias("min_epoch"), F.max("epoch_ms").alias("max_epoch"))


def patrol_stop(shots: DataFrame, marks: DataFrame, cap_with: int = 50, cap_without: int = 10) -> DataFrame:
    """Shots up to and including the first that reaches the target's watermark, within the caps; has_new marks newer times."""
    rows = shots.join(marks, "target", "left")
    reached = F.coalesce(F.col("min_epoch") <= F.col("watermark"), F.lit(False))
    w = W.partitionBy("target").orderBy("shot")
    before = F.coalesce(F.max(reached.cast("int")).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    nth = F.row_number().over(w)
    cap = F.when(F.col("watermark").isNull(), cap_without).otherwise(cap_with)
    rows = rows.withColumns({"reached": reached, "has_new": F.coalesce(F.col("max_epoch") > F.col("watermark"), F.lit(True)), "_before": before, "_nth": nth, "_cap": cap})
    return rows.filter("_before = 0 AND _nth <= _cap").drop("_before", "_nth", "_cap")


def newest_stamp(stamps: DataFrame, group: str = "target") -> DataFrame:
    """The stamp of the latest epoch, the first by position of equals."""
    w = W.partitionBy(group).orderBy(F.desc("epoch_ms"), "pos")
    return stamps.filter("epoch_ms IS NOT NULL").withColumn("_nth", F.row_number().over(w)).filter("_nth = 1").drop("_nth")


def advanced(marks: DataFrame, newest: DataFrame, as_of_ms: int) -> DataFrame:
    """The next watermark: the newest epoch of the round, else the old one, else now."""
    joined = marks.join(newest.select("target", F.col("epoch_ms").alias("_newest")), "target", "full")
    return joined.select("target", F.coalesce("_newest", "watermark", F.lit(as_of_ms)).alias("watermark"))


def before_stuck(items: DataFrame, group: str, order: str, digest: str, repeats: int = 3) -> DataFrame:
    """Items before and including the one at which a run of equal digests reaches ``repeats`` consecutive repeats."""
    w = W.partitionBy(group).orderBy(order)
    same = F.coalesce(F.col(digest) == F.lag(digest).over(w), F.lit(False))
    rows = items.withColumn("_same", same)
    rows = rows.withColumn("_island", F.sum(F.when(F.col("_same"), 0).otherwise(1)).over(w.rowsBetween(W.unboundedPreceding, 0)))
    in_run = F.row_number().over(W.partitionBy(group, "_island").orderBy(order)) - 1
    rows = rows.withColumn("run_length", in_run)
    stopped = F.coalesce(F.max(F.when(F.col("run_length") >= repeats, 1).otherwise(0)).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("_stopped", stopped).filter("_stopped = 0").drop("_stopped", "_same", "_island")
