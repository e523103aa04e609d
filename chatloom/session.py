"""Session helpers: the shared folder for cut lineage, and shipping this package to the executors."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_WRITTEN: dict[str, SparkSession] = {}


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``); where it is unset, a local one, which only a local master may use."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="chatloom-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder; what is there is removed when the driver ends."""
    path = f"{shared_root(spark)}/chatloom-{uuid.uuid4().hex[:12]}-{name}"
    _WRITTEN[path] = spark
    return path


def written(df: DataFrame, name: str, **options: object) -> DataFrame:
    """Cut the lineage of ``df``: write it as Parquet to the shared folder and read it back.

    The files survive the loss of any executor, and the scan has statistics by which Spark may choose joins.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.options(**{"compression": "zstd", **options}).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def written_alone(make: Callable[[], DataFrame], name: str) -> DataFrame:
    """``written`` of what ``make`` gives; the tables that were written on the way go as soon as it is there."""
    before = set(_WRITTEN)
    out = written(make(), name)
    *on_the_way, _ = [path for path in _WRITTEN if path not in before]  # in the order of writing
    for path in on_the_way:
        _remove(path, _WRITTEN.pop(path))
    return out


def _remove(path: str, spark: SparkSession) -> None:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(conf).delete(target, True)


@atexit.register
def _remove_written() -> None:
    for path, spark in _WRITTEN.items():
        try:
            _remove(path, spark)
        except Exception:  # the session has ended or the folder can't be reached; a cluster's own clean-up takes it
            continue


def ship(spark: SparkSession) -> SparkSession:
    """Send this package's source to the executors, once per application, so that tasks can import it."""
    context = spark.sparkContext
    if getattr(context, "_chatloom_shipped", False):
        return spark
    here = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="chatloom-src-"), "chatloom-src.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(here):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join("chatloom", os.path.relpath(full, here)))
    context.addPyFile(archive)
    context._chatloom_shipped = True
    return spark
