"""Parquet sinks for date partitions, safe to run again."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame

#: Bytes of a stored table, as the planner knows them, for each shuffle partition of a load.
STORED_BYTES = 4 << 20
#: Most bytes that adaptive execution gathers in one task of a load; they are several times as many in memory.
GATHERED_BYTES = 32 << 20
#: More partitions would cost more than they give; adaptive execution splits larger ones.
MOST_PARTITIONS = 10_000
#: What the planner says of a table that it knows nothing of is more than this.
KNOWN_BYTES = 1 << 60


def planner_bytes(frame: DataFrame) -> int:
    """The planner's own estimate of a frame's size."""
    return int(str(frame._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


@contextmanager
def partitions_for(stored: DataFrame, gathered: int = GATHERED_BYTES) -> Iterator[None]:
    """Let shuffles have partitions in proportion to ``stored`` while a load that reads it is made and written.

    A fixed number of partitions holds ever more rows each: joins, sums and sorts then spill, and a partition of many
    days is cut across all of them, so that each day gets many files. The settings of the session are never made
    coarser, and are put back. A table of unknown size, as of a database, leaves the number as it is.
    """
    spark = stored.sparkSession
    number, size = "spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = {key: spark.conf.get(key) for key in (number, size)}
    known = planner_bytes(stored)
    wanted = min(MOST_PARTITIONS, -(-known // STORED_BYTES)) if known < KNOWN_BYTES else 0
    as_bytes = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
    spark.conf.set(number, str(max(int(before[number]), wanted)))
    spark.conf.set(size, str(min(as_bytes(before[size]), gathered)))
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def gather_partitions(frame: DataFrame, partition_by: Sequence[str]) -> DataFrame:
    """Bring the rows of each partition together, so that it gets few files.

    The rebalance hint lets adaptive execution split a partition larger than
    ``spark.sql.adaptive.advisoryPartitionSizeInBytes`` over several tasks and merge small
    ones, so one hot day is never written by a single task.
    """
    return frame.hint("rebalance", *partition_by)


def write_partitions(frame: DataFrame, path: str, partition_by: Sequence[str]) -> None:
    """Replace only the partitions that occur in ``frame``; all others stay as they are."""
    writer = frame.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(*partition_by).parquet(path)
