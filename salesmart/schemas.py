"""Schemas of the curated tables, declared once and used by builders, sinks and DDL."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import types as T

DATE_PARTITIONS = ["partition_year", "partition_month", "partition_day"]
SNAPSHOT_PARTITIONS = ["snapshot_date"]
#: Sums kept per day and track; a partition is a month.
TRACK_DAY_SUMS = "track_day_sums"
SUMS_PARTITIONS = DATE_PARTITIONS[:2]


@dataclass(frozen=True)
class CuratedTable:
    """Data columns and partition columns of one curated table, as DDL strings."""

    columns: str
    partitions: str = ""
    partition_by: list[str] = field(default_factory=list)

    @property
    def schema(self) -> T.StructType:
        return T.StructType.fromDDL(", ".join(p for p in (self.columns, self.partitions) if p))


_DATE_PARTITION_DDL = ", ".join(f"{name} INT" for name in DATE_PARTITIONS)

# Column names, types and partitioning of the curated tables.
TABLES = {
    "dim_customer": CuratedTable(
        "CustomerKey INT, FirstName STRING, LastName STRING, Company STRING, "
        "Country STRING, City STRING, State STRING, Email STRING"
    ),
    "dim_track": CuratedTable(
        "TrackKey INT, Name STRING, Album STRING, Artist STRING, "
        "Genre STRING, MediaType STRING, Composer STRING, Milliseconds INT"
    ),
    "dim_date": CuratedTable(
        "DateKey INT, FullDate STRING, Year INT, Quarter INT, Month INT, Day INT, "
        "DayOfWeek STRING, IsHoliday BOOLEAN",
        _DATE_PARTITION_DDL,
        DATE_PARTITIONS,
    ),
    "fact_sales": CuratedTable(
        "CustomerKey INT, TrackKey INT, InvoiceDateKey INT, EmployeeKey INT, "
        "Quantity INT, UnitPrice DECIMAL(10,2), TotalAmount DECIMAL(10,2)",
        _DATE_PARTITION_DDL,
        DATE_PARTITIONS,
    ),
    "customer_history": CuratedTable(
        "customer_id INT, first_name STRING, last_name STRING, company STRING, address STRING, "
        "city STRING, state STRING, country STRING, postal_code STRING, phone STRING, "
        "fax STRING, email STRING, support_rep_id INT",
        "snapshot_date DATE",
        SNAPSHOT_PARTITIONS,
    ),
    "employee_reports_history": CuratedTable(
        "EmployeeKey INT, FirstName STRING, LastName STRING, Title STRING, "
        "ReportsToEmployeeKey INT, ReportsToName STRING",
        "snapshot_date DATE",
        SNAPSHOT_PARTITIONS,
    ),
}


# Kept beside the curated tables, which are derived from no other of them.
KEPT = {
    TRACK_DAY_SUMS: CuratedTable(
        "InvoiceDateKey INT, TrackKey INT, units BIGINT, lines BIGINT, amount DECIMAL(20,2), partition_day INT",
        "partition_year INT, partition_month INT",
        SUMS_PARTITIONS,
    ),
}


def conform(frame: DataFrame, table: str, *, keep_extra: bool = False) -> DataFrame:
    """Cast to the declared columns of ``table``; extra columns are dropped or kept at the end."""
    schema = (TABLES | KEPT)[table].schema
    columns = [f"CAST({f.name} AS {f.dataType.simpleString()}) AS {f.name}" for f in schema.fields]
    if keep_extra:
        declared = {name.lower() for name in schema.names}
        columns += [f"`{name}`" for name in frame.columns if name.lower() not in declared]
    return frame.selectExpr(*columns)
