"""Screenshot runs, overlapping batches and sink batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chatloom.session import written

SHOT_NAME = "patrol_.+_([0-9]{6})_([0-9]+)\\.png\\z"


def parse_shots(files: DataFrame, name: str = "name", prefix: str = "patrol_", suffix: str = ".png") -> DataFrame:
    """Run and index of screenshot names; other names are skipped."""
    c = F.col(name)
    fits = files.filter(c.startswith(prefix) & c.endswith(suffix) & c.rlike(SHOT_NAME))
    return fits.withColumns({"run_id": F.regexp_extract(c, SHOT_NAME, 1).cast("long"), "shot": F.regexp_extract(c, SHOT_NAME, 2).cast("long")})


def new_runs(shots: DataFrame, watermarks: DataFrame) -> DataFrame:
    """Shots of runs after their target's watermark (target, last_run), or of targets that have none."""
    joined = shots.join(watermarks, "target", "left")
    return joined.filter(F.col("last_run").isNull() | (F.col("run_id") > F.col("last_run"))).drop("last_run")


def runs_old_to_new(shots: DataFrame) -> DataFrame:
    """One row per target and run with its shots from old to new: the highest index is the oldest."""
    order = F.array_sort(F.collect_list(F.struct((-F.col("shot")).alias("minus"), F.col("mtime"), F.col("name"))))
    return shots.groupBy("target", "run_id").agg(F.transform(order, lambda s: s["name"]).alias("names"), F.count(F.lit(1)).alias("n"))


def overlapping_batches(rows: DataFrame, group: str, order: str, size: int = 5) -> DataFrame:
    """Each row with the numbers of the batches it is in.

    With overlap 1, batch 0 is [0, size) and batch k >= 1 is [k(size-1), k(size-1)+size+1), present if it adds rows.
    """
    step = size - 1
    i = F.row_number().over(W.partitionBy(group).orderBy(order)) - 1
    rows = rows.withColumns({"i": i, "n": F.count(F.lit(1)).over(W.partitionBy(group))})
    lowest = F.greatest(F.lit(0), F.floor((F.col("i") - size) / step)).cast("int")
    k = F.explode(F.sequence(lowest, F.floor(F.col("i") / step).cast("int")))
    rows = rows.withColumn("batch_no", k)
    start = F.col("batch_no") * step
    end = F.when(F.col("batch_no") == 0, size).otherwise(start + size + 1)
    exists = (F.col("batch_no") == 0) | ((F.col("batch_no") == 1) & (F.col("n") > size)) | ((F.col("batch_no") >= 2) & (F.col("n") > start + 2))
    return rows.filter(exists & (F.col("i") >= start) & (F.col("i") < end))


def sink_batches(rows: DataFrame, order: str, batch_size: int, within: str | None = None) -> DataFrame:
    """Number of the sink batch of each row, first in first out, per ``within``.

    Without ``within`` all rows are one queue: they are dealt by ranges of the order, written, and numbered in each
    range after the rows of the ranges before it, so no task holds the queue.
    """
    if within:
        return rows.withColumn("batch_no", F.floor((F.row_number().over(W.partitionBy(within).orderBy(order)) - 1) / batch_size))
    ranged = written(rows.repartitionByRange(order).withColumn("_range", F.spark_partition_id()), "sink-ranges")
    sizes = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))  # a row for each range
    before = F.coalesce(F.sum("_n").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    nth = F.row_number().over(W.partitionBy("_range").orderBy(order)) - 1 + F.col("_before")
    numbered = ranged.join(sizes.select("_range", before.alias("_before")), "_range").withColumn("batch_no", F.floor(nth / batch_size))
    return numbered.select(*rows.columns, "batch_no")


def retry_delays(retries: int = 3, base_ms: int = 1000) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(retries - 1)), lambda n: (F.lit(base_ms) * F.pow(F.lit(2), n)).cast("long"))
