"""Kept sums of the fact per day and track, followed load by load, for reports that read no sales lines."""

from __future__ import annotations

import hashlib
import json
from collections import defaultdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from salesmart.schemas import DATE_PARTITIONS, SUMS_PARTITIONS, TABLES, TRACK_DAY_SUMS, conform
from salesmart.sinks.manifest import PartitionLog, Scope
from salesmart.sinks.parquet import gather_partitions, partitions_for

#: Most bytes gathered in one task: nearly every sale may be a sum of its own, and takes eight times as much in memory.
SUMMED_BYTES = 16 << 20


def track_day_sums(sales: DataFrame) -> DataFrame:
    """Units, lines and amount per day and track; undated sales are a day of their own."""
    sums = sales.groupBy("InvoiceDateKey", "TrackKey", *DATE_PARTITIONS).agg(
        F.sum("Quantity").alias("units"), F.count(F.lit(1)).alias("lines"), F.sum("TotalAmount").alias("amount")
    )
    return conform(sums, TRACK_DAY_SUMS)


def _month(part: str) -> str:
    return part.rpartition("/")[0]


def refresh_sums(spark: SparkSession, base: str) -> list[str]:
    """Bring the kept sums up to the fact; the months summed again or removed.

    A month is summed again if any of its days is held by another load than when it was summed last: what its former
    days gave is retracted with it. The note of a month names the loads of its days. No other month is read, whatever
    loads there were between. A fact load that comes meanwhile is found by the next call.
    """
    facts = PartitionLog(spark, f"{base}/fact_sales", DATE_PARTITIONS)
    sums = PartitionLog(spark, f"{base}/{TRACK_DAY_SUMS}", SUMS_PARTITIONS)
    source, before = facts.state(), sums.state()
    days = defaultdict(list)
    for part, load in source.holder.items():
        days[_month(part)].append((part, load))
    notes = {m: hashlib.sha256(json.dumps(sorted(own)).encode()).hexdigest() for m, own in days.items()}
    stale = {m for m, note in notes.items() if before.notes.get(m) != note}
    gone = set(before.holder) - set(notes)
    if not stale and not gone:
        return []
    sales = facts.read(TABLES["fact_sales"].schema, source, lambda p: _month(p) in stale)
    load = None
    if stale:
        with partitions_for(sales, SUMMED_BYTES):
            load = sums.write(gather_partitions(track_day_sums(sales), SUMS_PARTITIONS))
    sums.publish(before, Scope(parts=frozenset(stale | gone)), load, {m: notes[m] for m in stale})
    return sorted(stale | gone)
