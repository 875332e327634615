"""Date columns: keys, calendar parts and parsing, all as built-in column expressions."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column
from pyspark.sql import functions as F


def _column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def date_key(value: Column | str) -> Column:
    """Integer ``yyyymmdd`` key of a date or timestamp; the time of day is dropped."""
    day = F.to_date(_column(value))
    return F.year(day) * 10000 + F.month(day) * 100 + F.dayofmonth(day)


def parse_date(text: Column | str) -> Column:
    """ISO text column to date."""
    return F.to_date(_column(text), "yyyy-MM-dd")


def as_date(value: date | str) -> date:
    """Driver-side argument to ``date``: a date, a datetime or ISO text."""
    if isinstance(value, datetime):
        return value.date()
    if isinstance(value, date):
        return value
    return datetime.strptime(value, "%Y-%m-%d").date()


def calendar_columns(day: Column | str) -> list[Column]:
    """Key, ISO text, year, quarter, month, day and English weekday name of a date."""
    day = F.to_date(_column(day))
    return [
        date_key(day).alias("DateKey"),
        F.date_format(day, "yyyy-MM-dd").alias("FullDate"),
        F.year(day).alias("Year"),
        F.quarter(day).alias("Quarter"),
        F.month(day).alias("Month"),
        F.dayofmonth(day).alias("Day"),
        F.date_format(day, "EEEE").alias("DayOfWeek"),
    ]


def partition_columns(day: Column | str) -> list[Column]:
    """Year, month and day partition columns of a date."""
    day = F.to_date(_column(day))
    return [
        F.year(day).alias("partition_year"),
        F.month(day).alias("partition_month"),
        F.dayofmonth(day).alias("partition_day"),
    ]
