"""Reporting views for BI clients, as SQL so that the catalog can store them.

They return every group, unordered. As in the reports, facts are summed before dimensions are
joined, and the calendar is joined on the partition columns too, so a client's filter on the
calendar prunes fact partitions.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

_PER_DAY = """
    WITH per_day AS (
      SELECT InvoiceDateKey, partition_year, partition_month, partition_day,
             sum(Quantity) AS units, count(*) AS lines, sum(TotalAmount) AS amount
      FROM {db}.fact_sales
      GROUP BY InvoiceDateKey, partition_year, partition_month, partition_day
    ),
    sales AS (
      SELECT c.*, units, lines, amount
      FROM per_day s
      JOIN {db}.dim_date c
        ON s.InvoiceDateKey = c.DateKey
       AND s.partition_year = c.partition_year
       AND s.partition_month = c.partition_month
       AND s.partition_day = c.partition_day
    )
"""

VIEWS = {
    "v_tracks_sold_by_day": _PER_DAY
    + "SELECT FullDate, sum(units) AS TracksSold FROM sales GROUP BY FullDate",
    "v_top_artist_by_month": """
    WITH per_track AS (
      SELECT c.Year, c.Month, s.TrackKey, sum(s.Quantity) AS units
      FROM {db}.fact_sales s
      JOIN {db}.dim_date c
        ON s.InvoiceDateKey = c.DateKey
       AND s.partition_year = c.partition_year
       AND s.partition_month = c.partition_month
       AND s.partition_day = c.partition_day
      GROUP BY c.Year, c.Month, s.TrackKey
    ),
    per_artist AS (
      SELECT Year, Month, Artist, sum(units) AS TracksSold
      FROM per_track JOIN {db}.dim_track USING (TrackKey)
      GROUP BY Year, Month, Artist
    ),
    ranked AS (
      SELECT *, row_number() OVER (
        PARTITION BY Year, Month ORDER BY TracksSold DESC, Artist ASC NULLS LAST) AS place
      FROM per_artist
    )
    SELECT Year, Month, Artist, TracksSold FROM ranked WHERE place = 1
    """,
    "v_best_day_of_week": _PER_DAY
    + "SELECT DayOfWeek, sum(units) AS TracksSold, sum(lines) AS SaleLines "
    "FROM sales GROUP BY DayOfWeek",
    "v_best_sales_month": _PER_DAY
    + "SELECT Year, Month, sum(units) AS TracksSold, "
    "CAST(sum(amount) AS DECIMAL(20,2)) AS Revenue FROM sales GROUP BY Year, Month",
}


def register_views(spark: SparkSession, database: str) -> None:
    """Create or replace the four views over the registered tables of ``database``.

    They hold no hint: how the calendar and the tracks are joined is decided when a view is read, from
    the statistics that ``discover_partitions`` keeps and from what adaptive execution measures.
    """
    for name, body in VIEWS.items():
        sql = body.format(db=database)
        spark.sql(f"CREATE OR REPLACE VIEW {database}.{name} AS {sql}")
