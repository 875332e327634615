"""Registered queries: every operator over the whole given tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from salesmart.catalog.tables import discover_partitions, register_tables
from salesmart.catalog.views import VIEWS
from salesmart.functions.dates import calendar_columns, date_key, parse_date
from salesmart.functions.values import line_amount
from salesmart.operators.calendar import calendar_table, date_span, dim_date, flag_holidays
from salesmart.operators.holiday_rules import country_holidays
from salesmart.operators.holidays import holidays_co
from salesmart.plans.dimensions import dim_customer
from salesmart.plans.facts import fact_sales, fact_sales_between
from salesmart.plans.history import customer_history, employee_reports
from salesmart.plans.intervals import ChangeHistory
from salesmart.plans.reports import (
    REPORTS,
    Star,
    best_day_of_week,
    calendar_totals,
    top_artist_by_month,
)
from salesmart.plans.refresh import refresh_changed_facts, refresh_facts
from salesmart.schemas import DATE_PARTITIONS, TABLES, TRACK_DAY_SUMS
from salesmart.sinks.manifest import day_of
from salesmart.sinks.scratch import scratch_path
from salesmart.sources.tables import ReadTable, curated_tables
from workload.mart import RELOADED_DAYS, before_corrections, more_write_tasks, redated, sample_mart, withdrawn
from workload.sample import (
    SNAPSHOT_DAY,
    SampleStar,
    given,
    sample_fact,
    sample_tables,
    sample_tracks,
    with_gaps,
)

Query = Callable[[SparkSession, str], DataFrame]

# Countries with rules for the years of the given orders.
HOLIDAY_COUNTRIES = ("CA", "CO", "DE", "FR", "GR", "US")
# Fixed value: the years that exist for queries about declared years.
DECLARED_YEARS = (1996, 1998)


def _order_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = given(spark, sf_dir, "orders")
    return orders.select(F.year("o_orderdate").alias("year")).distinct()


# -- dimensions, fact and snapshots ---------------------------------------------------------


def q_dim_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dim_customer(sample_tables(spark, sf_dir)("customer"))


def q_dim_track(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample_tracks(sample_tables(spark, sf_dir))


def q_dim_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = date_span(given(spark, sf_dir, "orders"), "o_orderdate")
    return calendar_table(days, holidays_co(_order_years(spark, sf_dir)))


def q_fact_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample_fact(sample_tables(spark, sf_dir))


def q_customer_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return customer_history(sample_tables(spark, sf_dir)("customer"), SNAPSHOT_DAY)


def q_employee_reports_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return employee_reports(sample_tables(spark, sf_dir)("employee"), SNAPSHOT_DAY)


def q_fact_one_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a load of some days reads: their invoices and the lines in the range of their ids."""
    return fact_sales_between(sample_tables(spark, sf_dir), *RELOADED_DAYS)


def q_fact_bounded_undated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A load of some days takes the sales without a date along."""
    read = sample_tables(spark, sf_dir)

    def undated(name: str) -> DataFrame:
        frame = read(name)
        if name != "invoice":
            return frame
        known = F.when(F.col("invoice_id") % 50 != 0, F.col("invoice_date"))
        return frame.withColumn("invoice_date", known)

    return fact_sales_between(undated, *RELOADED_DAYS)


# -- dates, holidays and amounts ------------------------------------------------------------


def q_date_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return date_span(given(spark, sf_dir, "orders"), "o_orderdate")


def q_date_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return given(spark, sf_dir, "events").select(
        "event_id",
        date_key("ts").alias("key_of_timestamp"),
        date_key(F.to_date("ts")).alias("key_of_date"),
    )


def q_calendar_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = given(spark, sf_dir, "orders").select("o_orderkey", *calendar_columns("o_orderdate"))
    return parts.withColumn("parsed_day", parse_date("FullDate"))


def q_holidays_co(spark: SparkSession, sf_dir: str) -> DataFrame:
    return holidays_co(_order_years(spark, sf_dir))


def q_holidays_by_country(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Holidays of several countries in the years of the orders."""
    years = _order_years(spark, sf_dir)
    return reduce(DataFrame.unionByName, [country_holidays(years, c) for c in HOLIDAY_COUNTRIES])


def q_order_holidays(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = given(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    flagged = flag_holidays(orders, "o_orderdate", holidays_co(_order_years(spark, sf_dir)))
    return flagged.select("o_orderkey", "IsHoliday")


def q_amount_overflow(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.col("l_extendedprice").cast("decimal(10,2)")
    return given(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        line_amount(price, F.col("l_partkey"), strict=False).alias("amount"),
    )


# -- joins that lose or keep rows -----------------------------------------------------------


def q_left_lookup_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = sample_tables(spark, sf_dir)
    known = read("customer").filter("company <> 'MACHINERY'")
    sales = fact_sales(read("invoice"), read("invoice_line"), known)
    return sales.groupBy("EmployeeKey").agg(
        F.count("*").alias("sale_lines"), F.sum("Quantity").alias("units")
    )


def q_track_lookup_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    tracks = sample_tracks(with_gaps(sample_tables(spark, sf_dir)))
    return tracks.groupBy("Artist", "MediaType").agg(F.count("*").alias("tracks"))


def q_inner_calendar_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    star = SampleStar(spark, sf_dir)
    shorter = Star(star.fact_sales, dim_date(spark, "1996-02-10", "2000-06-20"))
    return calendar_totals(shorter, "Year", "Month")


# -- reports --------------------------------------------------------------------------------


def _report(name: str) -> Query:
    return lambda spark, sf_dir: REPORTS[name](SampleStar(spark, sf_dir))


def q_weekday_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_day_of_week(SampleStar(spark, sf_dir), k=7)


def q_top_artist_null_tiebreak(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With no units sold all artists of a month tie, the unknown one among them."""
    star = SampleStar(spark, sf_dir, gaps=True)
    unsold = star.fact_sales.withColumn("Quantity", F.lit(0))
    return top_artist_by_month(Star(unsold, star.dim_date, star.dim_track))


# -- written, refreshed and registered tables -----------------------------------------------


def q_fact_partition_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    sales = sample_mart(spark, sf_dir).table("fact_sales")
    return sales.groupBy(*DATE_PARTITIONS).agg(
        F.count("*").alias("sale_lines"),
        F.sum("Quantity").alias("units"),
        F.sum("TotalAmount").alias("revenue"),
    )


def _per_day(sales: DataFrame) -> DataFrame:
    return sales.groupBy("InvoiceDateKey").agg(
        F.count("*").alias("sale_lines"), F.sum("Quantity").alias("units")
    )


def _reloaded(spark: SparkSession, first: ReadTable, read: ReadTable, bounds: tuple) -> DataFrame:
    """Sales per day after a load from ``first`` and one from ``read``."""
    base = scratch_path(spark, "reload")
    with more_write_tasks(spark):
        refresh_facts(first, base)
        refresh_facts(read, base, *bounds)
    return _per_day(curated_tables(spark, base)("fact_sales"))


def q_fact_reload_withdrawn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days whose sales were all withdrawn are gone after a load of their range."""
    read = sample_tables(spark, sf_dir)
    return _reloaded(spark, withdrawn(read), read, ("1900-01-01", "2100-01-01"))


def q_fact_reload_redated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sales that moved to another day are counted once after a load without bounds."""
    read = sample_tables(spark, sf_dir)
    return _reloaded(spark, redated(read), read, ())


def q_fact_changed_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sales per day after a load before some corrections and one of the changed days, and which these were."""
    read, base = sample_tables(spark, sf_dir), scratch_path(spark, "changed")
    with more_write_tasks(spark):
        refresh_facts(before_corrections(read), base)
        rewritten = refresh_changed_facts(read, base)
    days = [(int(day_of(part).strftime("%Y%m%d")),) for part in rewritten]
    listed = spark.createDataFrame(days, "InvoiceDateKey int").withColumn("rewritten", F.lit(True))
    per_day = _per_day(curated_tables(spark, base)("fact_sales"))
    joined = per_day.join(F.broadcast(listed), "InvoiceDateKey", "left")
    return joined.fillna(False, ["rewritten"])


def q_fact_declared_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by year of the fact and the calendar, read and registered, where only some years are declared."""
    mart = sample_mart(spark, sf_dir)
    for name in ("fact_sales", "dim_date"):
        mart.table(name)
    database = f"salesmart_{uuid.uuid4().hex}"
    register_tables(spark, database, mart.base)
    discover_partitions(spark, database, DECLARED_YEARS)
    read = curated_tables(spark, mart.base, DECLARED_YEARS)
    frames = {(name, how): frame for name in ("fact_sales", "dim_date") for how, frame in (
        ("read", read(name)), ("registered", spark.table(f"{database}.{name}"))
    )}
    counts = [
        frame.groupBy("partition_year").agg(F.count("*").alias("table_rows"))
        .select(F.lit(name).alias("table_name"), F.lit(how).alias("how"), "partition_year", "table_rows")
        for (name, how), frame in frames.items()
    ]
    return reduce(DataFrame.unionByName, counts)


def _kept_report(name: str) -> Query:
    """A report over sums that followed several loads, without the fact."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        mart = sample_mart(spark, sf_dir)
        sums = mart.table(TRACK_DAY_SUMS)
        return REPORTS[name](Star(None, mart.table("dim_date"), mart.table("dim_track"), sums))

    return query


def q_snapshot_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample_mart(spark, sf_dir).table("customer_history")


def q_employee_snapshot_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample_mart(spark, sf_dir).table("employee_reports_history")


def q_history_by_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full copies of ten days of customers, kept as changes."""
    customers = sample_tables(spark, sf_dir)("customer").select("customer_id", "company", "city")
    history = ChangeHistory(spark, scratch_path(spark, "changes"))
    for k in range(10):
        company = F.when(F.col("customer_id") % 97 == k, "moved").otherwise(F.col("company"))
        there = customers.filter(F.col("customer_id") % 89 != k).withColumn("company", company)
        history.take(there, f"2001-01-{k + 1:02}")
    return history.copies()


def q_dim_full_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample_mart(spark, sf_dir).table("dim_track")


def q_dim_date_overwrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rewritten calendar with the number of orders per day."""
    per_day = (
        given(spark, sf_dir, "orders")
        .groupBy(date_key("o_orderdate").alias("DateKey"))
        .agg(F.count("*").alias("orders"))
    )
    return (
        sample_mart(spark, sf_dir)
        .table("dim_date")
        .join(per_day, "DateKey", "left")
        .select(*TABLES["dim_date"].schema.names, F.coalesce("orders", F.lit(0)).alias("orders"))
    )


def q_partition_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each partitioned table before and after its partitions are discovered."""
    mart = sample_mart(spark, sf_dir)
    partitioned = [name for name, table in TABLES.items() if table.partition_by]
    for name in partitioned:
        mart.table(name)
    database = "salesmart_" + mart.base.rstrip("/").removesuffix("/data")[-8:].replace("-", "_") + "_found"
    spark.sql(f"DROP DATABASE IF EXISTS {database} CASCADE")  # of a former call
    register_tables(spark, database, mart.base)
    before = {name: spark.table(f"{database}.{name}").count() for name in partitioned}
    discover_partitions(spark, database)
    counts = [
        spark.table(f"{database}.{name}").agg(
            F.lit(name).alias("table_name"),
            F.lit(before[name]).cast("long").alias("rows_before"),
            F.count("*").alias("rows_after"),
        )
        for name in partitioned
    ]
    return reduce(DataFrame.unionByName, counts)


def q_registered_table_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    database = sample_mart(spark, sf_dir).registered()
    return (
        spark.table(f"{database}.fact_sales")
        .groupBy("EmployeeKey", "partition_year")
        .agg(F.sum("Quantity").alias("units"), F.sum("UnitPrice").alias("prices"))
    )


def q_mart_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and sum of keys of every table of the mart."""
    mart = sample_mart(spark, sf_dir)
    keys = {
        "dim_date": "DateKey",
        "dim_customer": "CustomerKey",
        "dim_track": "TrackKey",
        "fact_sales": "InvoiceDateKey",
        "customer_history": "customer_id",
        "employee_reports_history": "EmployeeKey",
    }
    totals = [
        mart.table(name).agg(
            F.lit(name).alias("table_name"),
            F.count("*").alias("table_rows"),
            F.sum(key).alias("key_sum"),
        )
        for name, key in keys.items()
    ]
    return reduce(DataFrame.unionByName, totals)


def _view(name: str) -> Query:
    return lambda spark, sf_dir: spark.table(f"{sample_mart(spark, sf_dir).registered()}.{name}")


QUERIES: dict[str, Query] = {
    name.removeprefix("q_"): query for name, query in list(globals().items()) if name[:2] == "q_"
}
QUERIES |= {f"report_{name}": _report(name) for name in REPORTS}
QUERIES |= {f"kept_{name}": _kept_report(name) for name in REPORTS}
QUERIES |= {f"view_{name.removeprefix('v_')}": _view(name) for name in VIEWS}
