"""Every registered query against DuckDB on the same tables."""

import os
import re

import pytest

import __spark_entry__ as contract
from workload.compare import differences, spark_rows
from workload.mart import SampleMart
from workload.oracles import ORACLES
from workload.queries import QUERIES

SF_DIR = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.001")


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(contract.queries())
    assert set(ORACLES) <= set(contract.oracle_sql()) <= set(contract.queries())


def test_entry(spark):
    frame = contract.entry(spark)
    assert frame.columns == ["Year", "Month", "Artist", "tracks_sold"]
    assert frame.count() == 80


def test_scans_read_only_needed_columns(spark, conf, plan):
    conf(spark__sql__maxMetadataStringLength="10000")
    text = plan(contract.queries()["report_tracks_sold_by_day"](spark, SF_DIR))
    schemas = set(re.findall(r"ReadSchema: struct<([^>]*)>", text))
    assert "l_orderkey:bigint,l_quantity:double" in schemas
    assert "o_orderkey:bigint,o_custkey:bigint,o_orderdate:timestamp_ntz" in schemas
    assert "PushedFilters: [IsNotNull(l_orderkey)]" in text
    assert "holiday" not in text


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, name):
    rows, odd = differences(spark, SF_DIR, name)
    assert rows and not odd


ROUND_TRIPS = (
    "fact_partition_roundtrip",
    "snapshot_roundtrip",
    "employee_snapshot_roundtrip",
    "dim_full_refresh",
    "dim_date_overwrite",
    "registered_table_scan",
    "mart_refresh",
    "view_top_artist_by_month",
    "view_best_sales_month",
)


def test_round_trips_would_show_a_missing_second_load(spark, monkeypatch):
    """Each is another result if only the altered tables were loaded."""
    true = {name: spark_rows(QUERIES[name](spark, SF_DIR)) for name in ROUND_TRIPS}
    altered = SampleMart(spark, SF_DIR, second=False)
    monkeypatch.setattr("workload.queries.sample_mart", lambda *_: altered)
    for name in ROUND_TRIPS:
        assert spark_rows(QUERIES[name](spark, SF_DIR)) != true[name], name
