"""File sources: logs, settings, screenshots, and checkpoints of targets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatloom.functions.text import log_record
from chatloom.operators.batching import SHOT_NAME, parse_shots

CHECKPOINT = "target string, timestamp long, timeStr string, epochMs long, year int, month int, day int, hour int, minute int"


def log_records(spark: SparkSession, path: str, last: int = 20) -> DataFrame:
    """Of the last ``last`` non-blank lines of a log file, those that are records: time, level, message, in order."""
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    lines = spark.read.text(path).select(place.alias("nth"), F.col("value").alias("line")).filter(F.trim("line") != "")
    tail = lines.orderBy(F.desc("nth")).limit(last)
    return tail.withColumn("r", log_record(F.col("line"))).filter("r IS NOT NULL").orderBy("nth").select("r.*")


def settings(spark: SparkSession, path: str) -> DataFrame:
    """name, value of an environment file: the first = splits, blank lines and comments are skipped, the last of a name counts."""
    lines = spark.read.text(path).select(F.trim("value").alias("line"), F.monotonically_increasing_id().alias("nth"))
    pairs = lines.filter((F.col("line") != "") & ~F.col("line").startswith("#") & F.col("line").contains("="))
    split = F.split("line", "=", 2)
    return pairs.groupBy(F.trim(split[0]).alias("name")).agg(F.max_by(F.trim(split[1]), "nth").alias("value"))


def with_settings(old: DataFrame, new: DataFrame) -> DataFrame:
    """Upsert by name."""
    return old.join(new, "name", "left_anti").unionByName(new)


def screenshots(spark: SparkSession, folder: str) -> DataFrame:
    """name, run_id, shot, mtime of the screenshots of a folder; the content isn't read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "patrol_*.png").load(folder)
    return parse_shots(files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("modificationTime").alias("mtime")))


def screenshots_stream(spark: SparkSession, folder: str, files_at_a_time: int = 1000) -> DataFrame:
    """target, run_id, shot, name, mtime of the screenshots that come into a folder, as a stream; the content isn't read."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", "patrol_*.png").option("maxFilesPerTrigger", files_at_a_time).load(folder)
    shots = parse_shots(files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("modificationTime").alias("mtime")))
    return shots.select(F.regexp_extract("name", SHOT_NAME.replace(".+", "(.+)", 1), 1).alias("target"), "run_id", "shot", "name", "mtime")


def saved_checkpoints(old: DataFrame, new: DataFrame, path: str) -> None:
    """Write the checkpoints of all targets as JSON lines, those of ``new`` in place of the same target's; ``path`` is a new folder."""
    old.join(new, "target", "left_anti").unionByName(new).write.json(path)


def checkpoints(spark: SparkSession, path: str) -> DataFrame:
    """Checkpoints of targets, one JSON object a line."""
    return spark.read.schema(CHECKPOINT).json(path)
