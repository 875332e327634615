"""A curated mart, loaded from altered tables first and then refreshed from the given ones.

Each part is written at most once per session and data folder, and only when a query asks for
it. The second load of every part is what the round-trip queries check: nothing of the first may
be left, and nothing may be missing.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from salesmart.catalog.tables import discover_partitions, register_tables
from salesmart.catalog.views import register_views
from salesmart.plans.kept import refresh_sums
from salesmart.plans.refresh import (
    refresh_calendar,
    refresh_changed_facts,
    refresh_dimensions,
    refresh_facts,
    refresh_history,
)
from salesmart.schemas import TRACK_DAY_SUMS
from salesmart.sinks.scratch import scratch_path
from salesmart.sources.tables import ReadTable, curated_tables
from workload.sample import SNAPSHOT_DAY, order_days, sample_tables

EARLIER_SNAPSHOT_DAY = "2001-12-30"
RELOADED_DAYS = ("2000-02-01", "2000-02-29")

_marts: dict[tuple[str, str], SampleMart] = {}


@contextmanager
def more_write_tasks(spark: SparkSession) -> Iterator[None]:
    """Let adaptive execution keep partitions below 1 MB while a small table is written.

    A small load over thousands of days would otherwise be merged into one task that opens all
    files in turn. A large load has larger partitions and is not affected.
    """
    key = "spark.sql.adaptive.coalescePartitions.minPartitionSize"
    before = spark.conf.get(key)
    spark.conf.set(key, "16KB")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def withdrawn(read: ReadTable) -> ReadTable:
    """With every seventh invoice ten days after the last day of all: days that have no sales later."""

    def table(name: str) -> DataFrame:
        frame = read(name)
        if name != "invoice":
            return frame
        last = frame.agg(F.max("invoice_date")).first()[0]
        moved = F.lit(last).cast("timestamp_ntz") + F.expr("INTERVAL 10 DAYS")
        return frame.withColumn(
            "invoice_date", F.when(F.col("invoice_id") % 7 == 0, moved).otherwise(F.col("invoice_date"))
        )

    return table


def redated(read: ReadTable) -> ReadTable:
    """With the date of every third invoice four days later."""

    def table(name: str) -> DataFrame:
        frame = read(name)
        if name != "invoice":
            return frame
        later = F.col("invoice_date") + F.expr("INTERVAL 4 DAYS")
        return frame.withColumn(
            "invoice_date", F.when(F.col("invoice_id") % 3 == 0, later).otherwise(F.col("invoice_date"))
        )

    return table


def before_corrections(read: ReadTable) -> ReadTable:
    """As the tables were before some corrections, each of one invoice in about a thousand.

    Invoices got another date (four days earlier now), were added, or lost lines that they had twice.
    """

    def table(name: str) -> DataFrame:
        frame = read(name)
        if name == "invoice":
            later = F.col("invoice_date") + F.expr("INTERVAL 4 DAYS")
            moved = F.when(F.col("invoice_id") % 997 == 0, later).otherwise(F.col("invoice_date"))
            return frame.filter("invoice_id % 1009 <> 1").withColumn("invoice_date", moved)
        if name == "invoice_line":
            return frame.unionByName(frame.filter("invoice_id % 1013 = 2"))
        return frame

    return table


def altered(read: ReadTable) -> ReadTable:
    """Tables that differ visibly in every curated table: what the first load is made from."""
    changes: dict[str, Callable[[DataFrame], DataFrame]] = {
        "customer": lambda f: f.filter("customer_id % 3 <> 0").withColumn("company", F.lit("former")),
        "artist": lambda f: f.withColumn("name", F.concat(F.lit("The "), "name")),
        "track": lambda f: f.filter("track_id % 5 <> 0"),
        "invoice_line": lambda f: f.withColumn("quantity", F.col("quantity") + 1),
        "employee": lambda f: f.filter("employee_id % 2 = 0").withColumn("title", F.lit("former")),
    }
    dated = redated(read)
    return lambda name: changes.get(name, lambda f: f)(dated(name))


class SampleMart:
    """``second``: without the second load the queries show the altered tables (for tests)."""

    def __init__(self, spark: SparkSession, sf_dir: str, second: bool = True) -> None:
        self.spark = spark
        self.base = scratch_path(spark, "salesmart")
        self.sf_dir = sf_dir
        self.source = sample_tables(spark, sf_dir)
        self.second = second
        self.database: str | None = None
        self._written: set[str] = set()

    @cached_property
    def days(self) -> tuple:
        return order_days(self.spark, self.sf_dir)

    def _load(self, part: str) -> None:
        if part in self._written:
            return
        if part == "calendar":
            refresh_calendar(self.spark, self.base, "1994-12-01", self.days[0])
            if self.second:
                refresh_calendar(self.spark, self.base, *self.days)
        elif part == "dimensions":
            refresh_dimensions(altered(self.source), self.base)
            if self.second:
                refresh_dimensions(self.source, self.base)
        elif part == "facts":
            with more_write_tasks(self.spark):
                refresh_facts(altered(self.source), self.base)
                if self.second:
                    refresh_facts(self.source, self.base)
                    refresh_facts(self.source, self.base, *RELOADED_DAYS)
        elif part == "sums":
            self._load("facts")
            refresh_facts(altered(self.source), self.base, *RELOADED_DAYS)
            refresh_sums(self.spark, self.base)
            if self.second:
                refresh_changed_facts(self.source, self.base)
                refresh_sums(self.spark, self.base)
        elif part == "history":
            for day in (EARLIER_SNAPSHOT_DAY, SNAPSHOT_DAY):
                refresh_history(altered(self.source), self.base, day)
                if self.second:
                    refresh_history(self.source, self.base, day)
        self._written.add(part)

    def table(self, name: str) -> DataFrame:
        """A curated table, read with its declared schema."""
        parts = {"dim_date": "calendar", "fact_sales": "facts", TRACK_DAY_SUMS: "sums"}
        kind = "history" if name.endswith("_history") else "dimensions"
        self._load(parts.get(name, kind))
        return curated_tables(self.spark, self.base)(name)

    def registered(self) -> str:
        """Database with all tables registered, their partitions found, and the views."""
        if self.database is None:
            for part in ("calendar", "dimensions", "facts", "history"):
                self._load(part)
            database = f"salesmart_{uuid.uuid4().hex}"
            register_tables(self.spark, database, self.base)
            discover_partitions(self.spark, database)
            register_views(self.spark, database)
            self.database = database
        return self.database


def sample_mart(spark: SparkSession, sf_dir: str) -> SampleMart:
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _marts:
        _marts[key] = SampleMart(spark, sf_dir)
    return _marts[key]
