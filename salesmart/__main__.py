"""Refresh jobs for ``spark-submit`` or ``python -m salesmart``.

    calendar   --target BASE --start 2009-01-01 --end 2030-12-31 [--country CO] [--holidays PATH]
    dimensions --target BASE --source SOURCE
    facts      --target BASE --source SOURCE [--since DAY] [--until DAY] [--replace | --changed] [--null-overflow]
    sums       --target BASE
    clean      --target BASE [--versions 2]
    history    --target BASE --source SOURCE [--as-of DAY]
    tables     --target BASE --database NAME

SOURCE is a folder of Parquet tables or a ``jdbc:`` URL. A database user and password are taken
from the environment variables SALESMART_JDBC_USER and SALESMART_JDBC_PASSWORD; other options of the
connection are given as ``--jdbc-option NAME=VALUE``; ``--balanced`` splits its tables into parts of equally many rows. PATH is a Parquet folder of holidays (country,
holiday_date). The calendar should cover all sales: reports leave out days that it lacks.
"""

from __future__ import annotations

import argparse
import os
from collections.abc import Sequence

from pyspark.sql import SparkSession

from salesmart.catalog.tables import discover_partitions, register_tables
from salesmart.catalog.views import register_views
from salesmart.functions.dates import as_date
from salesmart.plans.kept import refresh_sums
from salesmart.plans.refresh import (
    clean_tables,
    refresh_calendar,
    refresh_changed_facts,
    refresh_dimensions,
    refresh_facts,
    refresh_history,
)
from salesmart.sources.tables import ReadTable, jdbc_tables, parquet_tables


def parser() -> argparse.ArgumentParser:
    root = argparse.ArgumentParser(prog="salesmart")
    jobs = root.add_subparsers(dest="job", required=True)

    def job(name: str, *, reads_source: bool = False) -> argparse.ArgumentParser:
        added = jobs.add_parser(name)
        added.add_argument("--target", required=True)
        if reads_source:
            added.add_argument("--source", required=True)
            added.add_argument("--split", action="append", default=[], metavar="TABLE=COLUMN")
            added.add_argument("--partitions", type=int, default=64)
            added.add_argument("--balanced", action="store_true", help="split reads by rows, not by keys")
            added.add_argument("--jdbc-option", action="append", default=[], metavar="NAME=VALUE")
        return added

    calendar = job("calendar")
    calendar.add_argument("--start", type=as_date, default="2009-01-01")
    calendar.add_argument("--end", type=as_date, default="2030-12-31")
    calendar.add_argument("--country", default="CO")
    calendar.add_argument("--holidays", metavar="PATH")
    job("dimensions", reads_source=True)
    facts = job("facts", reads_source=True)
    facts.add_argument("--since", type=as_date)
    facts.add_argument("--until", type=as_date)
    which = facts.add_mutually_exclusive_group()
    which.add_argument("--replace", action="store_true")
    which.add_argument("--changed", action="store_true", help="only days that differ from the stored ones")
    facts.add_argument("--null-overflow", action="store_true", help="null for amounts beyond the type")
    history = job("history", reads_source=True)
    history.add_argument("--as-of", type=as_date)
    tables = job("tables")
    tables.add_argument("--database", required=True)
    tables.add_argument("--years", nargs=2, type=int, metavar=("FIRST", "LAST"))
    job("sums")
    clean = job("clean")
    clean.add_argument("--versions", type=int, default=2)
    return root


def source_reader(
    spark: SparkSession,
    source: str,
    split: Sequence[str],
    partitions: int,
    further: Sequence[str] = (),
    balanced: bool = False,
) -> ReadTable:
    if not source.startswith("jdbc:"):
        return parquet_tables(spark, source)
    login = {"user": "SALESMART_JDBC_USER", "password": "SALESMART_JDBC_PASSWORD"}
    options = {key: os.environ[name] for key, name in login.items() if name in os.environ}
    options |= dict(pair.split("=", 1) for pair in further)
    split_on = dict(pair.split("=", 1) for pair in split)
    return jdbc_tables(spark, source, split_on=split_on, partitions=partitions, balanced=balanced, **options)


def main(arguments: Sequence[str] | None = None) -> None:
    args = parser().parse_args(arguments)
    spark = SparkSession.builder.appName(f"salesmart-{args.job}").getOrCreate()
    if args.job == "calendar":
        holidays = spark.read.parquet(args.holidays) if args.holidays else None
        refresh_calendar(spark, args.target, args.start, args.end, args.country, holidays)
    elif args.job == "tables":
        register_tables(spark, args.database, args.target)
        discover_partitions(spark, args.database, args.years and tuple(args.years))
        register_views(spark, args.database)
    elif args.job == "sums":
        refresh_sums(spark, args.target)
    elif args.job == "clean":
        clean_tables(spark, args.target, args.versions)
    else:
        read = source_reader(spark, args.source, args.split, args.partitions, args.jdbc_option, args.balanced)
        if args.job == "dimensions":
            refresh_dimensions(read, args.target)
        elif args.job == "facts" and args.changed:
            refresh_changed_facts(read, args.target, args.since, args.until, strict=not args.null_overflow)
        elif args.job == "facts":
            refresh_facts(
                read,
                args.target,
                args.since,
                args.until,
                replace=args.replace,
                strict=not args.null_overflow,
            )
        else:
            refresh_history(read, args.target, args.as_of)


if __name__ == "__main__":
    main()
