"""Frames as rows: one long picture from overlapping frames, the divider between two panels, and the separators inside one.

Pixels are (frame, y, x, v) rows with the brightness v, so a picture of any size is shared out by rows and columns; profiles are grouped sums,
neighbours are window functions, and bands are islands of consecutive places.  ``pixels_of`` makes them from arrays.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chatloom.functions.arrays import overlap, without_adjacent_duplicates
from chatloom.operators.states import upper_quartile


def pixels_of(frames: DataFrame, width: int, frame: str = "frame", values: str = "pixels") -> DataFrame:
    """(frame, y, x, v) of frames whose pixels are one array, row after row."""
    at = frames.select(F.col(frame).alias("frame"), F.posexplode(values).alias("i", "v"))
    return at.select("frame", F.floor(F.col("i") / width).cast("int").alias("y"), (F.col("i") % width).cast("int").alias("x"), F.col("v").cast("double").alias("v"))


def strip_rows(frames: DataFrame, strip: str, order: str, pixels: str, width: int, step: int = 20, tolerance: float = 15.0, least: float = 0.85, same: float = 10.0) -> DataFrame:
    """(strip, at, order, row, pixels): the rows of one long picture for each strip, its frames put one below the other.

    A frame that is nearly equal to the one before it goes; what the top of a frame repeats of the end of the frame before it is shown once.
    A frame's place is the running sum of what each frame before it adds.
    """
    kept = without_adjacent_duplicates(frames.select(strip, order, pixels), [strip], order, pixels, same)
    in_order = W.partitionBy(strip).orderBy(order)
    before = F.lag(pixels).over(in_order)
    height = F.floor(F.size(pixels) / width).cast("int")
    placed = kept.withColumn("_before", before).withColumn("_shared", F.when(F.col("_before").isNull(), 0).otherwise(overlap(F.col("_before"), F.col(pixels), width, step, tolerance, least)).cast("int"))
    added = placed.withColumn("_new", height - F.col("_shared")).drop("_before")
    start = F.coalesce(F.sum("_new").over(in_order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rows = added.withColumn("_start", start).filter("_new > 0").withColumn("row", F.explode(F.sequence(F.col("_shared"), height - 1)))
    line = F.slice(pixels, F.col("row") * width + 1, width)
    return rows.select(strip, (F.col("_start") + F.col("row") - F.col("_shared")).cast("long").alias("at"), order, "row", line.alias(pixels))


@dataclass(frozen=True)
class DividerRules:
    """Shares of width and height, and thresholds; the fixed values are those for screenshots."""

    left: float = 0.10
    right_pad: int = 30
    top: float = 0.10
    bottom: float = 0.15
    samples: int = 50
    texture_samples: int = 60
    reach: int = 3
    band_factor: float = 1.3
    least_width: int = 2
    least_center: float = 0.12
    most_center: float = 0.75
    strength_step: int = 2
    panel: int = 18
    gap: int = 6
    threshold: tuple[float, float, float] = (8.0, 30.0, 15.0)
    least_continuity: float = 0.55
    least_coverage: float = 0.10
    fallback: float = 0.32


def edges(pixels: DataFrame, along: str, across: str) -> DataFrame:
    """``pixels`` with d, the difference from the pixel before along an axis; none for the first."""
    before = F.lag("v").over(W.partitionBy("frame", across).orderBy(along))
    return pixels.withColumn("d", F.abs(F.col("v") - before)).filter(F.col("d").isNotNull())


def adaptive_threshold(values: DataFrame, value: str, low: float, high: float, default: float) -> DataFrame:
    """(frame, threshold): the upper quartile of a frame's values, between two bounds."""
    p75 = upper_quartile(values, ["frame"], value, default)
    return p75.select("frame", F.least(F.lit(high), F.greatest(F.lit(low), F.col("p75"))).alias("threshold"))


def longest_runs(samples: DataFrame, keys: list[str], order: str, above: str) -> DataFrame:
    """(keys, n, n_above, longest): of consecutive samples that are above."""
    w = W.partitionBy(*keys).orderBy(order)
    island = F.row_number().over(w) - F.row_number().over(W.partitionBy(*keys, above).orderBy(order))
    runs = samples.withColumn("_island", island).groupBy(*keys, above, "_island").agg(F.count(F.lit(1)).alias("_n"))
    mine = F.when(F.col(above), F.col("_n"))
    return runs.groupBy(*keys).agg(F.sum("_n").alias("n"), F.coalesce(F.sum(mine), F.lit(0)).alias("n_above"), F.coalesce(F.max(mine), F.lit(0)).alias("longest"))


def triangular(rows: DataFrame, order: str, value: str, reach: int, out: str) -> DataFrame:
    """Triangular smoothing along a frame's consecutive places, renormalised at the ends."""
    w = W.partitionBy("frame").orderBy(order)
    near = {j: (F.lag(value, -j) if j < 0 else F.lead(value, j)).over(w) for j in range(-reach, reach + 1)}
    weight = {j: 1 - abs(j) / (reach + 1) for j in near}
    top, bottom = F.lit(0.0), F.lit(0.0)
    for j, v in near.items():
        top = top + F.coalesce(v * weight[j], F.lit(0.0))
        bottom = bottom + F.when(v.isNotNull(), weight[j]).otherwise(0.0)
    return rows.withColumn(out, top / bottom)


def islands(rows: DataFrame, order: str, test: Column) -> DataFrame:
    """``rows`` that pass, with the number of their island of consecutive rows of the frame."""
    w = W.partitionBy("frame").orderBy(order)
    rows = rows.withColumn("_nth", F.row_number().over(w)).filter(test)
    return rows.withColumn("island", F.col("_nth") - F.row_number().over(w)).drop("_nth")


def dividers(pixels: DataFrame, width: int, height: int, rules: DividerRules = DividerRules()) -> DataFrame:
    """(frame, center, delta, run, coverage, confident, divider): the vertical divider of frames of one size.

    Columns score by edge energy, coverage and continuity; bands of high scores are candidates; of these the tallest edge wins that
    has more texture on its left.  Without a confident one the divider is at a fixed share of the width.  Nothing is kept from frame to frame: for
    that, smooth ``center`` of confident frames by :func:`chatloom.operators.states.ema`.
    """
    r = rules
    top, end = int(height * r.top), height - int(height * r.bottom)
    first, last = int(width * r.left), width - max(r.right_pad, int(width * 0.03))
    inside = edges(pixels, "x", "y").filter((F.col("y") >= top) & (F.col("y") < end))
    step = max(1, (end - top) // r.samples)
    coarse = inside.filter(((F.col("y") - top) % step == 0) & (F.col("x") > first) & (F.col("x") < last))
    threshold = adaptive_threshold(coarse, "d", *r.threshold)
    sampled = coarse.join(threshold, "frame").withColumn("above", F.col("d") > F.col("threshold"))
    profile = longest_runs(sampled, ["frame", "x"], "y", "above").join(coarse.groupBy("frame", "x").agg(F.sum("d").alias("energy")), ["frame", "x"])
    score = F.col("energy") / F.col("n") * (F.col("n_above") / F.col("n")) * (0.5 + 0.5 * F.col("longest") / F.col("n"))
    smooth = triangular(profile.withColumn("score", score), "x", "score", r.reach, "smooth")
    mean = F.avg("smooth").over(W.partitionBy("frame"))
    high = islands(smooth.withColumn("mean", mean), "x", F.col("smooth") >= F.col("mean") * r.band_factor)
    bands = high.groupBy("frame", "island").agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.max("smooth").alias("peak"))
    center = F.floor((F.col("x0") + F.col("x1")) / 2).cast("int")
    bands = bands.filter(F.col("x1") - F.col("x0") >= r.least_width).withColumn("center", center).filter(F.col("center").between(int(width * r.least_center), int(width * r.most_center)))
    bands = bands.select("frame", "center", "peak").join(threshold, "frame")

    at = F.greatest(F.lit(1), F.least(F.lit(width - 2), F.col("center")))
    tall = inside.filter((F.col("y") - top) % r.strength_step == 0).join(bands.select("frame", "center", "threshold", at.alias("at")), "frame").filter(F.col("x") == F.col("at"))
    tall = longest_runs(tall.withColumn("above", F.col("d") > F.col("threshold")), ["frame", "center"], "y", "above")
    texture_step = max(1, (end - top) // r.texture_samples)
    fine = inside.filter((F.col("y") - top) % texture_step == 0).groupBy("frame", "x").agg(F.sum("d").alias("s"), F.count(F.lit(1)).alias("c")).join(bands.select("frame", "center"), "frame")
    c, x = F.col("center"), F.col("x")
    left = (x >= F.greatest(F.lit(1), c - r.gap - r.panel)) & (x < F.greatest(F.lit(1), c - r.gap))
    right = (x >= F.least(F.lit(width - 2), c + r.gap)) & (x < F.least(F.lit(width - 2), c + r.gap + r.panel))
    mean_of = lambda side: F.coalesce(F.sum(F.when(side, F.col("s"))) / F.sum(F.when(side, F.col("c"))), F.lit(0.0))
    delta = fine.groupBy("frame", "center").agg((mean_of(left) - mean_of(right)).alias("delta"))

    run = F.col("longest") * r.strength_step
    tall = tall.select("frame", "center", run.alias("run"), (F.col("n_above") / F.col("n")).alias("coverage"))
    scored = bands.join(tall, ["frame", "center"]).join(delta, ["frame", "center"])
    continuity = F.col("run") / F.lit(max(end - top, 1))
    value = continuity * 100 + F.col("coverage") * 20 + F.greatest(F.lit(0.0), F.col("delta")) + F.col("peak") * 0.05
    best = scored.groupBy("frame").agg(F.max_by(F.struct("center", "delta", "run", "coverage"), F.struct(F.round(value, 9), (-F.col("center")).alias("c"))).alias("b"))
    found = pixels.select("frame").distinct().join(best, "frame", "left").select("frame", "b.*")
    confident = F.coalesce((F.col("delta") >= 0) & (F.col("run") / F.lit(max(end - top, 1)) >= r.least_continuity) & (F.col("coverage") >= r.least_coverage), F.lit(False))
    return found.withColumn("confident", confident).withColumn("divider", F.when(F.col("confident"), F.col("center")).otherwise(int(width * r.fallback)))


@dataclass(frozen=True)
class SeparatorRules:
    """Zones as shares of the height, and thresholds; the fixed values are those for screenshots."""

    step: int = 2
    reach: int = 6
    header: tuple[float, float] = (0.05, 0.30)
    entry: tuple[float, float] = (0.65, 0.95)
    band_factor: float = 1.25
    threshold: tuple[float, float, float] = (6.0, 25.0, 10.0)
    least_coverage: float = 0.55
    least_gap: int = 200
    fallback: tuple[float, float] = (0.12, 0.88)


def separators(pixels: DataFrame, height: int, rules: SeparatorRules = SeparatorRules()) -> DataFrame:
    """(frame, header_bottom, input_top, confidence): the horizontal separators of a panel, rows of it numbered from 0.

    In each zone the band of smoothed row energy wins whose strongest row is an edge over most of the width.
    """
    r = rules
    rows = edges(pixels, "y", "x").filter(F.col("x") % r.step == 0)
    energy = triangular(rows.groupBy("frame", "y").agg(F.avg("d").alias("energy")), "y", "energy", r.reach, "smooth")
    threshold = adaptive_threshold(energy, "smooth", *r.threshold)
    zone = F.lit(None).cast("int")
    for k, (a, b) in enumerate((r.header, r.entry)):
        zone = F.when(F.col("i").between(int(height * a), int(height * b) - 1), k).otherwise(zone)
    marked = energy.withColumns({"mean": F.avg("smooth").over(W.partitionBy("frame")), "i": F.col("y") - 1}).withColumn("zone", zone)
    high = islands(marked, "y", (F.col("smooth") >= F.col("mean") * r.band_factor) & F.col("zone").isNotNull())
    peaks = high.groupBy("frame", "zone", "island").agg(F.max(F.struct("smooth", (-F.col("y")).alias("minus"))).alias("p")).select("frame", "zone", F.col("p.smooth").alias("peak"), (-F.col("p.minus")).alias("y"))
    cover = rows.join(threshold, "frame").join(peaks, ["frame", "y"]).groupBy("frame", "zone", "y", "peak").agg(F.avg((F.col("d") > F.col("threshold")).cast("double")).alias("coverage"))
    fit = cover.filter(F.col("coverage") >= r.least_coverage).withColumn("score", F.round(F.col("peak") + F.col("coverage") * 20, 9))
    best = fit.groupBy("frame").agg(*(F.max(F.when(F.col("zone") == k, F.struct("score", (-F.col("y")).alias("minus")))).alias(name) for k, name in enumerate(("top", "bottom"))))
    found = pixels.select("frame").distinct().join(best, "frame", "left")
    header, entry = (int(height * s) for s in r.fallback)
    top, bottom = F.coalesce(-F.col("top.minus"), F.lit(header)), F.coalesce(-F.col("bottom.minus"), F.lit(entry))
    fits = bottom - top >= r.least_gap
    confidence = 0.5 * F.col("top").isNotNull().cast("double") + 0.5 * F.col("bottom").isNotNull().cast("double")
    return found.select("frame", F.when(fits, top).otherwise(header).alias("header_bottom"), F.when(fits, bottom).otherwise(entry).alias("input_top"), confidence.alias("confidence"))
