"""Compare registered queries with their SQL in DuckDB: ``python -m workload.compare [sf_dir] [name ...]``."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
from pyspark.sql import DataFrame, SparkSession

from salesmart.session import local_session
from workload.oracles import ORACLES
from workload.queries import QUERIES


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    """DuckDB with the given tables as views."""
    connection = duckdb.connect()
    for file in sorted(Path(sf_dir).glob("*.parquet")):
        connection.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return connection


def sorted_rows(columns: list[str], rows: list) -> list[tuple[str, ...]]:
    """Rows as text with columns in name order, sorted; column names are part of the rows."""
    order = sorted(range(len(columns)), key=lambda i: columns[i].lower())
    header = tuple(columns[i].lower() for i in order)
    return [header, *sorted(tuple(str(row[i]) for i in order) for row in rows)]


# DuckDB's name of each Spark type that occurs.
TYPE_NAMES = {"int": "INTEGER", "bigint": "BIGINT", "string": "VARCHAR"}


def spark_rows(frame: DataFrame) -> list[tuple[str, ...]]:
    return sorted_rows(frame.columns, [tuple(row) for row in frame.collect()])


def spark_types(frame: DataFrame) -> dict[str, str]:
    return {name: TYPE_NAMES.get(kind, kind.upper()) for name, kind in frame.dtypes}


def oracle_rows(connection: duckdb.DuckDBPyConnection, sql: str) -> list[tuple[str, ...]]:
    connection.execute(sql)
    columns = [column[0] for column in connection.description]
    return sorted_rows(columns, connection.fetchall())


def oracle_types(connection: duckdb.DuckDBPyConnection, sql: str) -> dict[str, str]:
    connection.execute(f"DESCRIBE {sql}")
    return {row[0]: row[1].replace(" ", "") for row in connection.fetchall()}


def differences(spark: SparkSession, sf_dir: str, name: str) -> tuple[int, list]:
    """Number of rows in Spark's result, and types and up to five rows found on one side only."""
    frame, connection, sql = QUERIES[name](spark, sf_dir), connect(sf_dir), ORACLES[name]
    actual, expected = spark_rows(frame), oracle_rows(connection, sql)
    found, wanted = spark_types(frame), oracle_types(connection, sql)
    odd = [("types", found, wanted)] if found != wanted else []
    if actual != expected:
        odd += [("rows", len(actual) - 1, len(expected) - 1)]
        odd += [("spark", r) for r in actual if r not in set(expected)][:5]
        odd += [("oracle", r) for r in expected if r not in set(actual)][:5]
    return len(actual) - 1, odd


def main(sf_dir: str = "/root/testdata/sf0.01", *names: str) -> int:
    spark = local_session()
    failed = 0
    for name in names or QUERIES:
        started = time.time()
        rows, odd = differences(spark, sf_dir, name)
        failed += bool(odd)
        print(f"{'FAIL' if odd else 'ok  '} {name} rows={rows} {time.time() - started:.1f}s", *odd[:6])
    print(f"{failed} of {len(names or QUERIES)} differ")
    return failed


if __name__ == "__main__":
    sys.exit(bool(main(*sys.argv[1:])))
