"""Loads whose shuffles would have too few partitions: each day or month still gets few files."""

import pytest
from pyspark.sql import functions as F

from salesmart.plans.kept import refresh_sums
from salesmart.plans.refresh import refresh_changed_facts, refresh_facts
from salesmart.sinks import parquet
from salesmart.sinks.parquet import partitions_for
from salesmart.sources.tables import curated_tables, parquet_tables

DAYS = 48


@pytest.fixture
def large(spark, conf, tmp_path, monkeypatch):
    """Sales of 48 days in as many months, in a session of eight shuffle partitions."""
    monkeypatch.setattr(parquet, "STORED_BYTES", 8 << 10, raising=False)
    conf(
        spark__sql__shuffle__partitions="8",
        spark__sql__autoBroadcastJoinThreshold="-1",
        spark__sql__adaptive__advisoryPartitionSizeInBytes="64KB",
        spark__sql__adaptive__coalescePartitions__minPartitionSize="1KB",
    )
    day = F.expr(f"timestamp'2022-01-15 12:00:00' + make_ym_interval(0, CAST(invoice_id % {DAYS} AS INT))")
    invoice = spark.range(20_000).select(F.col("id").cast("int").alias("invoice_id"))
    invoice = invoice.select("invoice_id", (F.col("invoice_id") % 100).alias("customer_id"), day.alias("invoice_date"))
    line = spark.range(100_000).select(
        (F.col("id") % 20_000).cast("int").alias("invoice_id"),
        F.col("id").cast("int").alias("track_id"),
        (F.pmod(F.xxhash64("id"), F.lit(9999)) / 100).cast("decimal(10,2)").alias("unit_price"),
        F.lit(1).alias("quantity"),
    )
    customer = spark.range(100).selectExpr("CAST(id AS INT) customer_id", "CAST(id % 7 AS INT) support_rep_id")
    for name, frame in {"invoice": invoice, "invoice_line": line, "customer": customer}.items():
        frame.write.parquet(str(tmp_path / "source" / name))
    return parquet_tables(spark, str(tmp_path / "source")), str(tmp_path / "mart")


def files_of_parts(frame, *parts):
    files = frame.select(*parts, F.input_file_name().alias("file")).distinct()
    return [r["count"] for r in files.groupBy(*parts).count().collect()]


def test_days_of_a_load_have_few_files(spark, large):
    read, base = large
    refresh_facts(read, base)
    sales = curated_tables(spark, base)("fact_sales")
    assert sales.agg(F.count("*"), F.countDistinct("TrackKey")).first()[:] == (100_000, 100_000)
    counts = files_of_parts(sales, "InvoiceDateKey")
    assert len(counts) == DAYS and sum(counts) <= 2 * DAYS


def test_months_of_sums_have_few_files(spark, large):
    read, base = large
    refresh_facts(read, base)
    assert len(refresh_sums(spark, base)) == DAYS
    sums = curated_tables(spark, base)("track_day_sums")
    assert sums.agg(F.count("*"), F.countDistinct("TrackKey"), F.sum("units")).first()[:] == (100_000,) * 3
    counts = files_of_parts(sums, "partition_year", "partition_month")
    assert len(counts) == DAYS and sum(counts) <= 2 * DAYS


def test_changed_days_have_few_files(spark, large):
    read, base = large
    assert len(refresh_changed_facts(read, base)) == DAYS
    sales = curated_tables(spark, base)("fact_sales")
    assert sales.agg(F.count("*"), F.countDistinct("TrackKey")).first()[:] == (100_000, 100_000)
    counts = files_of_parts(sales, "InvoiceDateKey")
    assert len(counts) == DAYS and sum(counts) <= 2 * DAYS


def test_settings_are_put_back_and_never_coarser(spark, conf):
    sizes = "spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    conf(spark__sql__shuffle__partitions="5000", spark__sql__adaptive__advisoryPartitionSizeInBytes="3KB")
    with pytest.raises(ZeroDivisionError), partitions_for(spark.range(10)):
        assert [spark.conf.get(s) for s in sizes] == ["5000", "3072"]
        raise ZeroDivisionError
    assert [spark.conf.get(s) for s in sizes] == ["5000", "3KB"]
