"""Day ranges and the calendar dimension."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from salesmart.functions.dates import as_date, calendar_columns, partition_columns
from salesmart.operators.holiday_rules import country_holidays, first_year
from salesmart.operators.lookups import bounded_broadcast
from salesmart.schemas import conform


def date_range(spark: SparkSession, start: date | str, end: date | str) -> DataFrame:
    """One row per day in column ``day``, both ends included.

    Built from ``spark.range``, so the days are spread over tasks and the planner knows the
    exact size.
    """
    start, end = as_date(start), as_date(end)
    if end < start:
        raise ValueError(f"end {end} lies before start {start}")
    days = (end - start).days + 1
    return spark.range(days).select(
        F.date_add(F.lit(start), F.col("id").cast("int")).alias("day")
    )


def day_bounds(frame: DataFrame, column: str) -> tuple[date, date] | None:
    """First and last date in ``frame[column]``; None without any."""
    first, last = frame.agg(F.to_date(F.min(column)), F.to_date(F.max(column))).first()
    return None if first is None else (first, last)


def date_span(frame: DataFrame, column: str) -> DataFrame:
    """One row per day from the earliest to the latest date in ``frame[column]``."""
    ends = frame.agg(
        F.to_date(F.min(column)).alias("first"), F.to_date(F.max(column)).alias("last")
    )
    return ends.filter(F.col("first").isNotNull()).select(
        F.explode(F.sequence("first", "last", F.expr("INTERVAL 1 DAY"))).alias("day")
    )


def flag_holidays(frame: DataFrame, column: str, holidays: DataFrame) -> DataFrame:
    """Add ``IsHoliday``: whether the date in ``column`` occurs in ``holidays.holiday_date``.

    Two holidays may share a date, so the dates are made distinct before the join. They are broadcast
    once counted, since the planner takes them to be as large as what they are derived from.
    """
    dates = holidays.select(F.to_date("holiday_date").alias("_holiday")).distinct()
    return (
        frame.join(bounded_broadcast(dates), F.to_date(F.col(column)) == F.col("_holiday"), "left")
        .withColumn("IsHoliday", F.col("_holiday").isNotNull())
        .drop("_holiday")
    )


def calendar_table(days: DataFrame, holidays: DataFrame) -> DataFrame:
    """Calendar dimension over the dates in ``days.day``."""
    flagged = flag_holidays(days, "day", holidays)
    return conform(
        flagged.select(*calendar_columns("day"), "IsHoliday", *partition_columns("day")),
        "dim_date",
    )


def dim_date(
    spark: SparkSession,
    start: date | str,
    end: date | str,
    country: str = "CO",
    holidays: DataFrame | None = None,
) -> DataFrame:
    """Calendar dimension for a range of days.

    ``holidays`` is a frame ``(country, holiday_date, ...)``; without it the built-in rules of the
    country are used. A country without rules raises, and so do years before a country's first one.
    """
    start, end = as_date(start), as_date(end)
    days = date_range(spark, start, end)
    if holidays is None:
        if start.year < first_year(country):
            raise ValueError(f"built-in holidays of {country} start in {first_year(country)}")
        years = spark.range(start.year, end.year + 1).select(F.col("id").cast("int").alias("year"))
        holidays = country_holidays(years, country)
    return calendar_table(days, holidays.filter(F.col("country") == country))
