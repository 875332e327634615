"""Dated full copies of customers and of the reporting lines."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salesmart.functions.dates import as_date
from salesmart.functions.values import full_name
from salesmart.operators.lookups import lookup_chain
from salesmart.schemas import conform


def _snapshot_date(as_of: date | str | None) -> Column:
    return F.current_date() if as_of is None else F.lit(as_date(as_of))


def snapshot(frame: DataFrame, as_of: date | str | None = None) -> DataFrame:
    """The whole frame with a ``snapshot_date``: the given day, or today."""
    return frame.withColumn("snapshot_date", _snapshot_date(as_of))


def customer_history(customer: DataFrame, as_of: date | str | None = None) -> DataFrame:
    """Snapshot of customers, declared columns first and any further source columns kept."""
    return conform(snapshot(customer, as_of), "customer_history", keep_extra=True)


def employee_reports(employee: DataFrame, as_of: date | str | None = None) -> DataFrame:
    """Snapshot of employees with their manager's key and name.

    An employee without a manager, or whose manager is missing, has an empty manager name.
    """
    managers = employee.select(
        F.col("employee_id").alias("reports_to"),
        full_name("first_name", "last_name").alias("manager_name"),
    )
    reports = lookup_chain(employee, [(managers, "reports_to")]).select(
        F.col("employee_id").alias("EmployeeKey"),
        F.col("first_name").alias("FirstName"),
        F.col("last_name").alias("LastName"),
        F.col("title").alias("Title"),
        F.col("reports_to").alias("ReportsToEmployeeKey"),
        F.coalesce("manager_name", F.lit("")).alias("ReportsToName"),
    )
    return conform(snapshot(reports, as_of), "employee_reports_history")
