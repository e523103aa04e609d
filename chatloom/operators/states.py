"""Operators that are sequential by nature, as ordered folds for batches (chatloom.streaming has them as state)."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chatloom.operators.folds import fold_keys
from chatloom.operators.windows import window_starts


def rate_limit(rows: DataFrame, key: str, time: str, limit: int, window_ms: int) -> DataFrame:
    """(key, time, allowed): a window begins at its first event and takes ``limit`` of them (one at least); rejected ones don't count."""
    windows = window_starts(rows, [key], time, window_ms)
    taken = F.least(F.greatest(F.lit(max(limit, 1)) - F.col("before"), F.lit(0)), F.col("n"))
    nth = F.explode(F.sequence(F.lit(1).cast("long"), F.col("n")))
    return windows.select(key, time, taken.alias("_taken"), nth.alias("_nth")).select(key, time, (F.col("_nth") <= F.col("_taken")).alias("allowed"))


def backoff(rounds: DataFrame, key: str, order: str, idle: str, top: int = 3) -> DataFrame:
    """(key, order, level, multiplier, wait_code, wait_documented): idle rounds raise the level, which wraps after ``top``; others reset it.

    In units of the poll interval, the waiting time is multiplier + 1 as the scheduler adds one more interval, and
    multiplier as documented.
    """
    w = W.partitionBy(key).orderBy(order)
    busy = F.sum(F.when(F.col(idle), 0).otherwise(1)).over(w.rowsBetween(W.unboundedPreceding, 0))
    rows = rounds.withColumn("_block", busy)
    streak = F.sum(F.when(F.col(idle), 1).otherwise(0)).over(W.partitionBy(key, "_block").orderBy(order).rowsBetween(W.unboundedPreceding, 0))
    rows = rows.withColumn("level", F.pmod(streak, F.lit(top + 1)))
    return rows.select(key, order, "level", (F.col("level") + 1).alias("multiplier"), (F.col("level") + 2).alias("wait_code"), (F.col("level") + 1).alias("wait_documented"))


def y_groups(fragments: DataFrame, page: str = "page", near: int = 8) -> DataFrame:
    """(page, line, y, text): fragments within ``near`` of the rounded running mean of a line belong to it, joined by x.

    The mean depends on what the line has so far, so it is a fold over a page's fragments in order of (y, x), of which a task holds a batch and one line.
    """
    kind = fragments.schema[page].dataType.simpleString()

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, line, mean, parts = None, -1, None, []
        field = None
        for batch in batches:
            field, done = batch.schema.field(0).type, []
            for on, y, x, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if parts and on == now and y is not None and mean is not None and abs(y - mean) <= near:
                    mean = float(math.floor((mean * len(parts) + y) / (len(parts) + 1) + 0.5))
                else:
                    if parts:
                        done.append((now, line, mean, _joined(parts)))
                    line = line + 1 if parts and on == now else 0
                    now, mean, parts = on, y, []
                parts.append((x, text))
            yield _lines(done, field, page)
        if parts:
            yield _lines([(now, line, mean, _joined(parts))], field, page)

    rows = fragments.select(F.col(page), F.col("y").cast("double").alias("y"), F.col("x").cast("double").alias("x"), "text")
    return rows.repartition(page).sortWithinPartitions(page, "y", "x", "text").mapInArrow(lines, f"`{page}` {kind}, line int, y double, text string")


def _joined(parts: list[tuple[float | None, str | None]]) -> str:
    """Texts in order of x, missing ones first."""
    ordered = sorted(parts, key=lambda p: (p[0] is not None, p[0] or 0.0, p[1] is not None, (p[1] or "").encode()))
    return "".join(t for _, t in ordered if t is not None)


def _lines(done: list[tuple], key: pa.DataType, page: str) -> pa.RecordBatch:
    kinds = (key, pa.int32(), pa.float64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], kind) for i, kind in enumerate(kinds)], names=[page, "line", "y", "text"])


def ema(rows: DataFrame, key: str, order: str, value: str, confidence: str, least: float = 0.5, old: float = 0.65, fallback: float | None = None, decay: float = 0.9) -> DataFrame:
    """(key, smoothed): rounded exponential mean of a sequence; rows of low confidence are skipped.

    With ``fallback`` a row without a value, in which nothing was found, draws the mean there by a tenth, or begins it.
    """

    def step(s: float | None, row: tuple) -> float | None:
        _, v, c = row
        if v is None and fallback is not None:
            return fallback if s is None else float(math.floor(s * decay + fallback * (1 - decay) + 0.5))
        if c is not None and c < least:
            return s
        if s is None or v is None:
            return v
        x = s * old + v * (1 - old) + 0.5
        return float(math.floor(x)) if math.isfinite(x) else x

    return fold_keys(rows.select(key, order, F.col(value).cast("double").alias(value), F.col(confidence).cast("double").alias(confidence)), [key], step, "smoothed")


def upper_quartile(rows: DataFrame, keys: list[str], value: str, default: float) -> DataFrame:
    """(keys, p75): the element at floor(0.75 n) of a key's sorted values, or the default if there is none or it is 0."""
    by_key = W.partitionBy(*keys)
    ranked = rows.select(*keys, value, F.count(value).over(by_key).alias("_n"), F.row_number().over(by_key.orderBy(F.col(value).asc_nulls_last())).alias("_nth"))
    v = F.when(F.col("_n") > 0, F.col(value))
    return ranked.filter(F.col("_nth") == F.floor(F.col("_n") * 0.75) + 1).select(*keys, F.when(F.coalesce(v, F.lit(0)) != 0, v).otherwise(F.lit(default)).alias("p75"))
