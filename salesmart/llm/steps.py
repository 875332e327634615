"""Written intermediate tables and hints whose size was counted first."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from salesmart.sinks.scratch import scratch_path

#: Rows of a narrow table that may be broadcast; a row has at most a few hundred bytes.
BROADCAST_ROWS = 20_000
#: Rows in a batch between Spark and Python, for the registered queries and the pipeline.
ROWS_AT_ONCE = 1_000


def settled(frame: DataFrame, name: str = "step") -> DataFrame:
    """Write ``frame`` to the shared scratch folder and read it again: its lineage ends there."""
    path = scratch_path(frame.sparkSession, name)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def small(frame: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``frame`` with a broadcast hint if it is counted to have few rows, else unchanged."""
    return F.broadcast(frame) if frame.limit(rows + 1).count() <= rows else frame


def indexed(frame: DataFrame, order: list, place: str = "place") -> DataFrame:
    """``frame`` sorted over all tasks, with the rank of each row from 0 as ``place``; it is written.

    Ranges of the order's values are sorted on their own. What the driver adds up is the rows of each
    range, so one number for each task, whatever the input. Rows that tie in all of ``order`` get
    ranks of their own.
    """
    spark = frame.sparkSession
    ranged = frame.repartitionByRange(*order).sortWithinPartitions(*order)
    written = settled(ranged.withColumn("__local", F.monotonically_increasing_id()), "indexed")
    part = F.shiftright("__local", 33)  # the task and, below, the row in it
    sizes = written.groupBy(part.alias("part")).count().orderBy("part").collect()
    starts, total = [], 0
    for row in sizes:
        starts.append((row["part"], total))
        total += row["count"]
    offsets = spark.createDataFrame(starts, "__part long, __start long")
    local = F.col("__local").bitwiseAND((1 << 33) - 1)
    joined = written.join(F.broadcast(offsets), part == F.col("__part"))
    return joined.withColumn(place, F.col("__start") + local).drop("__local", "__part", "__start")


def column(name: str):
    """A column by its literal name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def importable(spark: SparkSession) -> None:
    """Let Python workers on this machine import the package from where the driver did.

    On a cluster the package is installed or sent along (``--py-files``). Also hand at most ROWS_AT_ONCE
    rows over at once, because they hold whole texts.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS_AT_ONCE))
    root = str(Path(__file__).resolve().parents[2])
    environment = spark.sparkContext.environment
    paths = environment.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        environment["PYTHONPATH"] = os.pathsep.join(p for p in (root, *paths) if p)
