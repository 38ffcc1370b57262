"""Intermediate tables in the folder that the whole cluster shares."""

from __future__ import annotations

import tempfile
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Where a local session leaves it unset (tests, a laptop) a temporary folder of the
    driver is made.  On a cluster executors could not read that, so there it is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        known = getattr(spark.sparkContext, "_webkiln_dir", None)
        folder = known or tempfile.mkdtemp(prefix="spark-webkiln-")
        spark.sparkContext._webkiln_dir = folder
    return folder.rstrip("/")


def _file_system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def materialise(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and return a reader of it.

    The written table cuts lineage and survives lost executors.  Each call takes
    a folder of its own, so a repeated query never reads another run's rows.  The
    folder goes when the session's process ends, or with ``discard``.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/webkiln-{name}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    files, at = _file_system(spark, path)
    files.deleteOnExit(at)
    written(spark).append(path)
    return spark.read.schema(df.schema).parquet(path)


_mine = threading.local()


def written(spark: SparkSession) -> list[str]:
    """The tables that this thread has materialised in the session, oldest first.

    Queries that run side by side in threads of one session do not see each other's.
    """
    if getattr(_mine, "session", None) is not spark.sparkContext:
        _mine.session, _mine.paths = spark.sparkContext, []
    return _mine.paths


def discard(spark: SparkSession, paths: list[str]) -> None:
    """Delete materialised tables that nothing reads any more."""
    for path in paths:
        files, at = _file_system(spark, path)
        files.delete(at, True)
        written(spark).remove(path)
