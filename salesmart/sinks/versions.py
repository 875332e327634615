"""Tables replaced in one step: each load is a folder of its own, and the newest complete one counts.

A version is complete once its ``_SUCCESS`` marker is there, which Spark writes last. So readers see
the former rows until then, also if a load fails.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

PREFIX = "version-"
#: Complete versions that are kept: the newest, and the one that readers may still be in.
KEPT = 2


def file_system(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and the path as one of its objects."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def exists(spark: SparkSession, path: str) -> bool:
    system, place = file_system(spark, path)
    return system.exists(place)


def qualified(spark: SparkSession, path: str) -> str:
    system, place = file_system(spark, path)
    return system.makeQualified(place).toString()


def versions(spark: SparkSession, path: str) -> list[str]:
    """Complete versions of the table at ``path``, oldest first."""
    system, place = file_system(spark, path)
    if not system.exists(place):
        return []
    names = (status.getPath().getName() for status in system.listStatus(place))
    found = sorted(f"{path}/{name}" for name in names if name.startswith(PREFIX))
    return [version for version in found if exists(spark, f"{version}/_SUCCESS")]


def current(spark: SparkSession, path: str) -> str:
    """Folder of the newest version; the path itself for a table without versions."""
    found = versions(spark, path.rstrip("/"))
    return found[-1] if found else path


def write_version(frame: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Write ``frame`` as the new version of the table at ``path`` and remove older ones."""
    spark = frame.sparkSession
    path = path.rstrip("/")
    target = f"{path}/{PREFIX}{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
    writer = frame.write.mode("errorifexists").partitionBy(*partition_by)
    writer.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "true").parquet(target)
    system, _ = file_system(spark, path)
    for old in versions(spark, path)[:-KEPT]:
        system.delete(file_system(spark, old)[1], True)
