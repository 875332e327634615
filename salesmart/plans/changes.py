"""Which partitions of a table differ from those of another, by a digest of each."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salesmart.sinks.manifest import NULL_PARTITION


def part_name(partition_by: Sequence[str]) -> Column:
    """Folder name of a row's partition."""
    values = (F.coalesce(F.col(c).cast("string"), F.lit(NULL_PARTITION)) for c in partition_by)
    named = (F.concat(F.lit(f"{c}="), v) for c, v in zip(partition_by, values, strict=True))
    return F.concat_ws("/", *named)


def day_digests(frame: DataFrame, partition_by: Sequence[str]) -> DataFrame:
    """``(part, digest)``: the number of a partition's rows and two sums of hashes of all their columns.

    The order of rows does not matter, and repeated rows count each. Nulls are told apart from values. Sums are taken in
    the map tasks first, so a hot day is no one task's work.
    """
    data = [F.col("`" + c.replace("`", "``") + "`") for c in frame.columns if c not in partition_by]
    empty = F.concat(*(F.when(c.isNull(), F.lit("0")).otherwise(F.lit("1")) for c in data))
    hashed = frame.select(
        part_name(partition_by).alias("part"),
        F.xxhash64(empty, *data).cast("decimal(20,0)").alias("first"),
        F.xxhash64(*reversed(data), empty).alias("second"),
    )
    sums = hashed.groupBy("part").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("first").alias("total"), F.bit_xor("second").alias("mixed")
    )
    return sums.select("part", F.concat_ws(":", "rows", F.col("total").cast("string"), "mixed").alias("digest"))


def changed_parts(old: DataFrame, new: DataFrame) -> tuple[list[str], dict[str, str]]:
    """Partitions that are on one side only or differ, and the digests of ``new``.

    What comes to the driver is a row for each partition.
    """
    both = old.withColumnRenamed("digest", "before").join(new, "part", "full_outer").collect()
    changed = [r["part"] for r in both if r["before"] != r["digest"]]
    return changed, {r["part"]: r["digest"] for r in both if r["digest"] is not None}
