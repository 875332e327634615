"""Refresh of the curated tables from the source tables.

Four steps, as often as each needs: calendar once, dimensions, facts, history. Every step may
run again at any time without duplicating rows. Each is published at once: readers see all that a
step wrote or what was there before.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, Observation, SparkSession

from salesmart.functions.dates import as_date
from salesmart.operators.calendar import dim_date
from salesmart.plans.dimensions import dim_customer, dim_track
from salesmart.plans.changes import changed_parts, day_digests
from salesmart.plans.facts import Losses, fact_sales_between, fact_sales_of, invoices_on, runs_of_days
from salesmart.plans.history import customer_history, employee_reports
from salesmart.schemas import DATE_PARTITIONS, KEPT, SNAPSHOT_PARTITIONS, TABLES
from salesmart.sinks.manifest import PartitionLog, Scope, State, day_of
from salesmart.sinks.parquet import partitions_for
from salesmart.sinks.versions import write_version
from salesmart.sources.tables import ReadTable


def refresh_calendar(
    spark: SparkSession,
    base: str,
    start: date | str,
    end: date | str,
    country: str = "CO",
    holidays: DataFrame | None = None,
) -> None:
    """Replace the calendar dimension."""
    _replace(dim_date(spark, start, end, country, holidays), f"{base}/dim_date", DATE_PARTITIONS, Scope())


def refresh_dimensions(read: ReadTable, base: str) -> None:
    """Replace the customer and track dimensions."""
    write_version(dim_customer(read("customer")), f"{base}/dim_customer")
    tracks = dim_track(*(read(t) for t in ("track", "album", "artist", "genre", "media_type")))
    write_version(tracks, f"{base}/dim_track")


def _replace(frame: DataFrame, path: str, partition_by: list[str], scope: Scope) -> State:
    """Write ``frame`` and publish it as the content of the partitions in ``scope``."""
    log = PartitionLog(frame.sparkSession, path, partition_by)
    before = log.state()
    return log.publish(before, scope, log.write(frame))


def refresh_facts(
    read: ReadTable,
    base: str,
    since: date | str | None = None,
    until: date | str | None = None,
    *,
    replace: bool = False,
    strict: bool = True,
) -> dict[str, int]:
    """Rewrite the fact partitions of the days from ``since`` to ``until``, or of all days.

    Sales without a date are loaded each time. Readers see either all former rows or all new ones; days of the range that no
    longer have any sale are gone. A load of some days corrects
    these days only: where an invoice got another date, both its old and its new day must lie in the
    range (``refresh_changed_facts`` finds both by itself). ``replace`` insists on a load of all days. Of two loads of the
    same days at a time the later one raises LoadConflict and changes nothing.

    Returns what was counted while the fact was written: lines read, lines without an invoice (of a load of all days), without a
    day, on days off the calendar (once there is one), and without ``strict`` amounts out of range.
    """
    if replace and (since is not None or until is not None):
        raise ValueError("replace reloads all days: give no bounds")
    first = None if since is None else as_date(since)
    last = None if until is None else as_date(until)
    spark = read("invoice").sparkSession
    log = PartitionLog(spark, f"{base}/fact_sales", DATE_PARTITIONS)
    before = log.state()  # what is published while the source is read may be newer than what was read
    calendar = PartitionLog(spark, f"{base}/dim_date", DATE_PARTITIONS).state().holder
    days = runs_of_days(day_of(p) for p in calendar) if calendar else None
    losses = Losses(Observation(), days)
    with partitions_for(read("invoice_line")):
        load = log.write(fact_sales_between(read, since, until, strict=strict, losses=losses, gathered=True))
    log.publish(before, Scope(first, last), load)
    return losses.counted()


def refresh_changed_facts(
    read: ReadTable,
    base: str,
    since: date | str | None = None,
    until: date | str | None = None,
    *,
    strict: bool = True,
) -> list[str]:
    """Rewrite only the days whose sales differ from the stored ones; the partitions rewritten or removed.

    One pass over the source sums an order-free digest of each day. Days whose digest is not the kept one are loaded again:
    those with added, changed or withdrawn sales, and both days of an invoice that got another date. Digests are
    kept in the log; that of a day that was loaded otherwise is computed from its files once.
    Sales without a date are a day of their own. Bounds leave other days unread and unchanged.
    """
    spark = read("invoice").sparkSession
    scope = Scope(None if since is None else as_date(since), None if until is None else as_date(until))
    log = PartitionLog(spark, f"{base}/fact_sales", DATE_PARTITIONS)
    before = log.state()
    known = {p: before.notes.get(p) for p in before.holder if scope.covers(p)}
    stored = log.read(TABLES["fact_sales"].schema, before, lambda p: p in known and known[p] is None)
    told = spark.createDataFrame([(p, d) for p, d in known.items() if d is not None], "part string, digest string")
    old = told.unionByName(day_digests(stored, DATE_PARTITIONS))
    with partitions_for(read("invoice_line")):
        new = day_digests(fact_sales_between(read, since, until, strict=strict), DATE_PARTITIONS)
        changed, digests = changed_parts(old, new)
    fresh = {p: d for p, d in digests.items() if known.get(p) != d}
    if not changed:
        if fresh:
            log.publish(before, Scope(parts=frozenset()), None, fresh)
        return []
    days = [day_of(p) for p in changed]
    chosen = invoices_on(read("invoice"), [d for d in days if d is not None], undated=None in days)
    with partitions_for(read("invoice_line")):
        load = log.write(fact_sales_of(read, chosen, strict=strict, gathered=True))
    log.publish(before, Scope(parts=frozenset(changed)), load, fresh)
    return sorted(changed)


def refresh_history(read: ReadTable, base: str, as_of: date | str | None = None) -> None:
    """Write the snapshots of one day, today by default, replacing any earlier ones of that day."""
    customer = read("customer")
    if as_of is None:
        as_of = customer.sparkSession.sql("SELECT current_date()").first()[0]
    frames = {
        "customer_history": customer_history(customer, as_of),
        "employee_reports_history": employee_reports(read("employee"), as_of),
    }
    day = Scope(parts=frozenset([f"snapshot_date={as_date(as_of).isoformat()}"]))
    for name, frame in frames.items():
        _replace(frame, f"{base}/{name}", SNAPSHOT_PARTITIONS, day)


def clean_tables(spark: SparkSession, base: str, versions: int = 2) -> list[str]:
    """Remove what none of the newest ``versions`` of each partitioned table holds, and lost loads of former days."""
    every = [(name, t.partition_by) for name, t in (TABLES | KEPT).items() if t.partition_by]
    logs = [PartitionLog(spark, f"{base}/{name}", by) for name, by in every]
    return [folder for log in logs if log.is_used() for folder in log.clean(versions)]


def refresh_all(
    spark: SparkSession,
    read: ReadTable,
    base: str,
    *,
    start: date | str = "2009-01-01",
    end: date | str = "2030-12-31",
    as_of: date | str | None = None,
    country: str = "CO",
    holidays: DataFrame | None = None,
) -> None:
    """Build the whole mart in order: calendar, dimensions, facts, history."""
    refresh_calendar(spark, base, start, end, country, holidays)
    refresh_dimensions(read, base)
    refresh_facts(read, base)
    refresh_history(read, base, as_of)
