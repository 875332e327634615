"""Sales fact at invoice-line grain."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass, replace
from datetime import date
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from salesmart.functions.dates import as_date, date_key, partition_columns
from salesmart.functions.values import line_amount
from salesmart.operators.lookups import salted_join
from salesmart.schemas import conform
from salesmart.sinks.parquet import gather_partitions
from salesmart.sources.tables import ReadTable, read_within

#: Headers of invoices are four numbers, so more of them are broadcast than of other lookups: about 60 bytes each.
MAX_BROADCAST_INVOICES = 1_000_000


@dataclass(frozen=True)
class Losses:
    """Counts what a load of the fact loses, while it is written.

    ``days`` are runs of days of the calendar, as pairs of their ends; without them days off the calendar are not counted.
    ``orphans``: whether lines without an invoice are counted. The counts are there once the load was written.
    """

    seen: Observation
    days: tuple[tuple[date, date], ...] | None = None
    orphans: bool = True

    def observe(self, joined: DataFrame, strict: bool) -> DataFrame:
        met = F.col("__met").isNotNull() if self.orphans else F.lit(True)
        day, zero = F.col("invoice_day"), F.lit(0).cast("long")
        whole = F.col("unit_price").isNotNull() & F.col("quantity").isNotNull()
        counts = {
            "lines": F.count(F.lit(1)),
            "lines_without_invoice": F.count_if(~met),
            "lines_without_day": F.count_if(met & day.isNull()),
        }
        if self.days is not None:
            within = reduce(Column.__or__, [day.between(F.lit(a), F.lit(b)) for a, b in self.days], F.lit(False))
            counts["lines_off_the_calendar"] = F.count_if(met & day.isNotNull() & ~within)
        if not strict:
            amount = line_amount("unit_price", "quantity", strict=False)
            counts["amounts_out_of_range"] = F.count_if(met & whole & amount.isNull())
        return joined.observe(self.seen, *(F.coalesce(c, zero).alias(n) for n, c in counts.items()))

    def counted(self) -> dict[str, int]:
        """The counts; no line was read where the planner found that there can be none, and left the counter out."""
        try:
            return dict(self.seen.get)
        except Py4JJavaError as error:
            if "AssertionError" not in str(error.java_exception):
                raise
            return {"lines": 0}


def runs_of_days(days: Iterable[date]) -> tuple[tuple[date, date], ...]:
    """First and last day of each run of days without a gap."""
    runs: list[tuple[date, date]] = []
    for day in sorted(set(days)):
        if runs and (day - runs[-1][1]).days == 1:
            runs[-1] = (runs[-1][0], day)
        else:
            runs.append((day, day))
    return tuple(runs)


def invoices_between(
    invoice: DataFrame, since: date | str | None = None, until: date | str | None = None
) -> DataFrame:
    """Invoices of the days from ``since`` to ``until``, both included, and all without a date.

    None leaves an end open. The bounds are compared with the bare column, so they reach the Parquet
    or JDBC scan.
    """
    when = F.col("invoice_date")
    kind = invoice.schema["invoice_date"].dataType
    bounds = []
    if since is not None:
        bounds.append(when >= F.lit(as_date(since)).cast(kind))
    if until is not None:
        bounds.append(when < F.date_add(F.lit(as_date(until)), 1).cast(kind))
    return invoice.filter(reduce(Column.__and__, bounds) | when.isNull()) if bounds else invoice


def key_ranges(invoice: DataFrame) -> tuple[int, list[tuple]]:
    """Number of invoices, and the ranges of their ids: of the dated ones and of the others.

    Apart, because the few undated invoices may lie anywhere; ranges that overlap are joined.
    """
    undated = F.col("invoice_date").isNull()
    rows = (
        invoice.groupBy(undated.alias("undated"))
        .agg(F.min("invoice_id").alias("low"), F.max("invoice_id").alias("high"), F.count("*").alias("n"))
        .collect()
    )
    ranges: list[tuple] = []
    for low, high in sorted((r["low"], r["high"]) for r in rows if r["low"] is not None):
        if ranges and low <= ranges[-1][1]:
            ranges[-1] = (ranges[-1][0], max(high, ranges[-1][1]))
        else:
            ranges.append((low, high))
    return sum(r["n"] for r in rows), ranges


def lines_within(read: ReadTable, ranges: Sequence[tuple]) -> DataFrame:
    """Invoice lines whose invoice id is in one of the ``ranges``, which do not overlap."""
    if not ranges:
        return read("invoice_line").filter(F.lit(False))
    parts = [read_within(read, "invoice_line", "invoice_id", low, high) for low, high in ranges]
    return reduce(DataFrame.unionByName, parts)


def invoices_on(invoice: DataFrame, days: Sequence[date], undated: bool = False) -> DataFrame:
    """Invoices of the given days, and with ``undated`` those without a date.

    The range of the days reaches the scan; the days themselves are joined, and are as few as a calendar has.
    """
    empty = invoice.filter(F.col("invoice_date").isNull())
    if not days:
        return empty if undated else invoice.filter(F.lit(False))
    wanted = invoice.sparkSession.createDataFrame([(d,) for d in sorted(days)], "wanted date")
    within = invoices_between(invoice, min(days), max(days)).filter(F.col("invoice_date").isNotNull())
    chosen = within.join(F.broadcast(wanted), F.to_date("invoice_date") == F.col("wanted"), "left_semi")
    return chosen.unionByName(empty) if undated else chosen


def fact_sales_between(
    read: ReadTable,
    since: date | str | None = None,
    until: date | str | None = None,
    *,
    strict: bool = True,
    losses: Losses | None = None,
    gathered: bool = False,
) -> DataFrame:
    """Sales of some days, and the undated ones, or all without bounds."""
    invoice = read("invoice")
    how = {"strict": strict, "losses": losses, "gathered": gathered}
    if since is None and until is None:
        return fact_sales(invoice, read("invoice_line"), read("customer"), **how)
    return fact_sales_of(read, invoices_between(invoice, since, until), **how)


def fact_sales_of(
    read: ReadTable,
    invoice: DataFrame,
    *,
    strict: bool = True,
    losses: Losses | None = None,
    gathered: bool = False,
) -> DataFrame:
    """Sales of the chosen invoices.

    Only the lines in the range of their ids are read. That range may
    hold others; the join decides. Few invoices are broadcast, so their lines are not shuffled.
    """
    chosen, ranges = key_ranges(invoice)
    lines = lines_within(read, ranges)
    few = chosen <= MAX_BROADCAST_INVOICES
    # A line in the range without a chosen invoice may belong to another day's, so it is no loss.
    own = None if losses is None else replace(losses, orphans=False)
    how = {"strict": strict, "few_invoices": few, "losses": own, "gathered": gathered}
    return fact_sales(invoice, lines, read("customer"), **how)


def fact_sales(
    invoice: DataFrame,
    invoice_line: DataFrame,
    customer: DataFrame,
    *,
    strict: bool = True,
    few_invoices: bool = False,
    losses: Losses | None = None,
    gathered: bool = False,
) -> DataFrame:
    """One row per invoice line; lines without an invoice drop, unknown customers stay.

    The sales rep is attached to the invoice headers before the lines are joined, so the lines
    are shuffled once, on ``invoice_id``. The rows of a hot customer or invoice are salted; below
    that adaptive execution splits what it finds too large. ``few_invoices`` tells that the invoices
    were counted to be few enough for a broadcast. ``strict`` decides whether an amount beyond
    ``decimal(10,2)`` raises or becomes null. ``losses`` counts in the same pass what no report will show.
    ``gathered`` brings the sales of a day together for the writer, before the columns that follow from others are added.
    """
    reps = customer.select("customer_id", "support_rep_id")
    headers = salted_join(
        invoice.select("invoice_id", "customer_id", F.to_date("invoice_date").alias("invoice_day")),
        reps,
        "customer_id",
        "left",
    )
    lines = invoice_line.select("invoice_id", "track_id", "unit_price", "quantity")
    counts = losses is not None and losses.orphans
    if counts:
        headers = headers.withColumn("__met", F.lit(True))
    if few_invoices:
        joined = lines.join(F.broadcast(headers), "invoice_id", "left" if counts else "inner")
    else:
        joined = salted_join(lines, headers, "invoice_id", "left" if counts else "inner")
    if losses is not None:
        joined = losses.observe(joined, strict)
    if counts:
        joined = joined.filter("__met").drop("__met")
    if gathered:
        joined = gather_partitions(joined, ["invoice_day"])
    sales = joined.select(
        F.col("customer_id").alias("CustomerKey"),
        F.col("track_id").alias("TrackKey"),
        date_key("invoice_day").alias("InvoiceDateKey"),
        F.col("support_rep_id").alias("EmployeeKey"),
        F.col("quantity").alias("Quantity"),
        F.col("unit_price").alias("UnitPrice"),
        line_amount("unit_price", "quantity", strict=strict).alias("TotalAmount"),
        *partition_columns("invoice_day"),
    )
    return conform(sales, "fact_sales")
