"""The four sales reports over the star schema.

Facts are summed per day, or per month and track, before any dimension is joined. What is
shuffled is therefore bounded by days or by months x tracks, not by sales lines, and a day,
track or artist holding a large share of all lines is combined inside the map tasks.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salesmart.operators.lookups import bounded_broadcast
from salesmart.operators.topk import top_k, top_k_per_group
from salesmart.schemas import DATE_PARTITIONS

DATE_KEYS = ["InvoiceDateKey", *DATE_PARTITIONS]


@dataclass(frozen=True)
class Star:
    """The curated tables the reports read; only the artist report needs tracks.

    With ``sums``, those kept per day and track, the fact is not read and may be None. Any object with these attributes will do.
    """

    fact_sales: DataFrame | None
    dim_date: DataFrame
    dim_track: DataFrame | None = None
    sums: DataFrame | None = None


def _sums(star: Star) -> DataFrame:
    """Units, lines and amount per day."""
    kept = getattr(star, "sums", None)
    if kept is not None:
        totals = [F.sum(c).alias(c) for c in ("units", "lines", "amount")]
        return kept.groupBy(*DATE_KEYS).agg(*totals)
    return star.fact_sales.groupBy(*DATE_KEYS).agg(
        F.sum("Quantity").alias("units"),
        F.count("*").alias("lines"),
        F.sum("TotalAmount").alias("amount"),
    )


def _calendar(dim_date: DataFrame, *columns: str) -> DataFrame:
    """Calendar columns under the date keys of the fact.

    Joining on the partition columns as well lets a filter on the calendar prune fact
    partitions; they follow from the key, so the result is the same.
    """
    return dim_date.select(F.col("DateKey").alias("InvoiceDateKey"), *DATE_PARTITIONS, *columns)


def calendar_totals(star: Star, *columns: str) -> DataFrame:
    """Units, lines and revenue per group of calendar columns; days off the calendar drop."""
    return (
        _sums(star).join(_calendar(star.dim_date, *columns), DATE_KEYS)
        .groupBy(*columns)
        .agg(
            F.sum("units").alias("tracks_sold"),
            F.sum("lines").alias("sale_lines"),
            F.sum("amount").cast("decimal(20,2)").alias("revenue"),
        )
    )


def artist_month_totals(star: Star) -> DataFrame:
    """Units per year, month and artist."""
    months = bounded_broadcast(_calendar(star.dim_date, "Year", "Month"))
    kept = getattr(star, "sums", None)
    sold = star.fact_sales.withColumnRenamed("Quantity", "units") if kept is None else kept
    per_track = (
        sold.select(*DATE_KEYS, "TrackKey", "units")
        .join(months, DATE_KEYS)
        .groupBy("Year", "Month", "TrackKey")
        .agg(F.sum("units").alias("units"))
    )
    return (
        per_track.join(star.dim_track.select("TrackKey", "Artist"), "TrackKey")
        .groupBy("Year", "Month", "Artist")
        .agg(F.sum("units").alias("tracks_sold"))
    )


def tracks_sold_by_day(star: Star) -> DataFrame:
    """Units per day in date order."""
    return calendar_totals(star, "FullDate").select("FullDate", "tracks_sold").orderBy("FullDate")


def top_artist_by_month(star: Star, k: int = 1) -> DataFrame:
    """Best-selling artist of each month; ties go to the first name, an unknown artist last."""
    order = [F.desc("tracks_sold"), F.asc_nulls_last("Artist")]
    return top_k_per_group(artist_month_totals(star), ["Year", "Month"], order, k).orderBy(
        "Year", "Month", *order
    )


def best_day_of_week(star: Star, k: int = 1) -> DataFrame:
    """Weekday with the most units, then the most lines; ``k=7`` ranks the whole week."""
    totals = calendar_totals(star, "DayOfWeek").select("DayOfWeek", "tracks_sold", "sale_lines")
    return top_k(totals, [F.desc("tracks_sold"), F.desc("sale_lines"), F.asc("DayOfWeek")], k)


def best_sales_month(star: Star, k: int = 1) -> DataFrame:
    """Month with the most units, then the most revenue."""
    totals = calendar_totals(star, "Year", "Month").select("Year", "Month", "tracks_sold", "revenue")
    order = [F.desc("tracks_sold"), F.desc("revenue"), F.asc("Year"), F.asc("Month")]
    return top_k(totals, order, k)


REPORTS: dict[str, Callable[..., DataFrame]] = {
    "tracks_sold_by_day": tracks_sold_by_day,
    "top_artist_by_month": top_artist_by_month,
    "best_day_of_week": best_day_of_week,
    "best_sales_month": best_sales_month,
}
