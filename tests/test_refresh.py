import uuid
from datetime import date, datetime
from decimal import Decimal
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from salesmart.__main__ import main
from salesmart.catalog.tables import discover_partitions, register_tables
from salesmart.catalog.views import VIEWS, register_views
from salesmart.plans.refresh import (
    refresh_all,
    refresh_calendar,
    refresh_dimensions,
    refresh_facts,
    refresh_history,
)
from salesmart.plans.reports import REPORTS, Star
from salesmart.schemas import DATE_PARTITIONS, TABLES
from salesmart.sinks.parquet import gather_partitions, write_partitions
from salesmart.sinks.versions import versions
from salesmart.sources.tables import (
    SOURCE_KEYS,
    curated_tables,
    parquet_tables,
    whole_customer_history,
)

SOURCES = {
    "customer": (
        "customer_id int, first_name string, last_name string, company string, address string, "
        "city string, state string, country string, postal_code string, phone string, fax string, "
        "email string, support_rep_id int",
        [(i, f"f{i}", f"l{i}", *[None] * 8, f"{i}@x", i % 2) for i in range(4)],
    ),
    "track": (
        "track_id int, name string, album_id int, genre_id int, media_type_id int, "
        "composer string, milliseconds int",
        [(i, f"t{i}", i % 2, 0, 0, None, i) for i in range(4)],
    ),
    "album": ("album_id int, title string, artist_id int", [(0, "a0", 0), (1, "a1", 1)]),
    "artist": ("artist_id int, name string", [(0, "Abba"), (1, "Beck")]),
    "genre": ("genre_id int, name string", [(0, "g")]),
    "media_type": ("media_type_id int, name string", [(0, "m")]),
    "invoice": (
        "invoice_id int, customer_id int, invoice_date timestamp",
        [(i, i % 4, datetime(2024, 1 + i % 2, 1 + i % 5, 12)) for i in range(20)],
    ),
    "invoice_line": (
        "invoice_id int, track_id int, unit_price decimal(10,2), quantity int",
        [(i // 2, i % 4, Decimal("1.50"), 1 + i % 3) for i in range(40)],
    ),
    "employee": (
        "employee_id int, first_name string, last_name string, title string, reports_to int",
        [(0, "A", "A", "Boss", None), (1, "B", "B", "Rep", 0)],
    ),
}


@pytest.fixture
def base(tmp_path):
    return str(tmp_path / "mart")


@pytest.fixture
def read(spark, tmp_path):
    for name, (ddl, rows) in SOURCES.items():
        spark.createDataFrame(rows, ddl).write.parquet(str(tmp_path / "source" / name))
    return parquet_tables(spark, str(tmp_path / "source"))


def rows(frame):
    return sorted(map(str, frame.collect()))


def test_fixture_covers_all_sources():
    assert set(SOURCES) == set(SOURCE_KEYS)


def test_refresh_twice_changes_nothing(spark, read, base):
    days = {"start": "2024-01-01", "end": "2024-02-29", "as_of": "2024-03-01"}
    refresh_all(spark, read, base, **days)
    tables = curated_tables(spark, base)
    first = {name: rows(tables(name)) for name in TABLES}
    assert {name: len(found) for name, found in first.items()} == {
        "dim_customer": 4,
        "dim_track": 4,
        "dim_date": 60,
        "fact_sales": 40,
        "customer_history": 4,
        "employee_reports_history": 2,
    }
    refresh_all(spark, read, base, **days)
    assert {name: rows(tables(name)) for name in TABLES} == first


def test_reload_of_one_day_leaves_the_others(spark, read, base):
    refresh_facts(read, base)

    def corrected(name):
        frame = read(name)
        return frame.withColumn("quantity", F.lit(100)) if name == "invoice_line" else frame

    refresh_facts(corrected, base, "2024-01-03", "2024-01-03")
    sales = curated_tables(spark, base)("fact_sales")
    by_day = {r.InvoiceDateKey: (r.lines, r.top) for r in sales.groupBy("InvoiceDateKey").agg(
        F.count("*").alias("lines"), F.max("Quantity").alias("top")).collect()}
    assert sum(lines for lines, _ in by_day.values()) == len(SOURCES["invoice_line"][1])
    assert {day for day, (_, top) in by_day.items() if top == 100} == {20240103}


def test_replace_drops_days_without_sales(spark, read, base):
    def later(name):
        return read(name).filter("invoice_id % 5 <> 3") if name == "invoice" else read(name)

    def days():
        return curated_tables(spark, base)("fact_sales").select("InvoiceDateKey").distinct().count()

    refresh_facts(read, base)
    assert days() == 10
    refresh_facts(later, base)
    assert days() == 8
    refresh_facts(read, base)
    refresh_facts(later, base, replace=True)
    assert days() == 8
    with pytest.raises(ValueError):
        refresh_facts(read, base, "2024-01-01", replace=True)


def test_a_bounded_load_drops_withdrawn_days_of_its_range_only(spark, read, base):
    def fewer(name):
        return read(name).filter("invoice_id % 5 <> 3") if name == "invoice" else read(name)

    def days():
        sales = curated_tables(spark, base)("fact_sales")
        return {r.InvoiceDateKey for r in sales.select("InvoiceDateKey").distinct().collect()}

    refresh_facts(read, base)
    assert {20240104, 20240204} <= days()
    refresh_facts(fewer, base, "2024-01-01", "2024-01-31")
    assert 20240104 not in days()
    assert 20240204 in days()


def test_redated_sales_are_counted_once(spark, read, base):
    def later(name):
        frame = read(name)
        if name != "invoice":
            return frame
        return frame.withColumn("invoice_date", F.expr("invoice_date + INTERVAL 40 DAYS"))

    refresh_facts(later, base)
    refresh_facts(read, base)
    sales = curated_tables(spark, base)("fact_sales")
    assert sales.count() == 40
    assert sales.filter("InvoiceDateKey > 20240229").count() == 0


def test_a_bounded_load_takes_undated_sales_along(spark, read, base):
    def undated(name):
        frame = read(name)
        if name != "invoice":
            return frame
        return frame.withColumn("invoice_date", F.expr("IF(invoice_id = 19, NULL, invoice_date)"))

    refresh_facts(undated, base, "2024-01-03", "2024-01-03")
    sales = curated_tables(spark, base)("fact_sales")
    assert sales.filter("InvoiceDateKey IS NULL").count() == 2
    assert {r.InvoiceDateKey for r in sales.select("InvoiceDateKey").distinct().collect()} == {None, 20240103}
    refresh_facts(read, base, "2024-01-03", "2024-01-03")
    assert curated_tables(spark, base)("fact_sales").filter("InvoiceDateKey IS NULL").count() == 0


def test_a_failed_replacement_leaves_the_former_rows(spark, read, base):
    refresh_dimensions(read, base)
    refresh_calendar(spark, base, "2024-01-01", "2024-01-03")

    def broken(name):
        frame = read(name)
        if name not in ("customer", "track"):
            return frame
        column = frame.columns[1]
        return frame.withColumn(column, F.expr("CAST(raise_error('lost') AS STRING)"))

    with pytest.raises(Exception, match="lost"):
        refresh_dimensions(broken, base)
    tables = curated_tables(spark, base)
    assert (tables("dim_customer").count(), tables("dim_track").count()) == (4, 4)
    assert tables("dim_date").count() == 3


def test_older_versions_are_removed(spark, read, base):
    for _ in range(4):
        refresh_dimensions(read, base)
    assert len(versions(spark, f"{base}/dim_track")) == 2


def test_a_null_date_is_stored_and_read_back(spark, read, base):
    def undated(name):
        no_date = F.lit(None).cast("timestamp")
        return read(name).withColumn("invoice_date", no_date) if name == "invoice" else read(name)

    refresh_facts(undated, base)
    refresh_facts(undated, base)
    sales = curated_tables(spark, base)("fact_sales")
    assert sales.filter("InvoiceDateKey IS NULL AND partition_day IS NULL").count() == 40


def test_dimensions_are_replaced(spark, read, base):
    refresh_dimensions(read, base)
    refresh_dimensions(lambda name: read(name).limit(1) if name == "track" else read(name), base)
    tables = curated_tables(spark, base)
    assert (tables("dim_track").count(), tables("dim_customer").count()) == (1, 4)


def test_calendar_is_replaced(spark, base):
    refresh_calendar(spark, base, "2023-12-30", "2023-12-31")
    refresh_calendar(spark, base, "2024-01-01", "2024-01-03")
    calendar = curated_tables(spark, base)("dim_date")
    assert sorted(r.DateKey for r in calendar.collect()) == [20240101, 20240102, 20240103]


def test_snapshots_accumulate_by_day(spark, read, base):
    for day in ("2024-01-01", "2024-01-02", "2024-01-02"):
        refresh_history(read, base, day)
    refresh_history(read, base)
    history = curated_tables(spark, base)("customer_history")
    days = {r.snapshot_date: r["count"] for r in history.groupBy("snapshot_date").count().collect()}
    assert days.pop(date(2024, 1, 1)) == days.pop(date(2024, 1, 2)) == 4
    assert list(days.values()) == [4]


def test_a_hot_day_is_written_by_several_tasks(spark, conf, base):
    """Two thirds of all rows on one day, the rest over thirty."""
    conf(
        spark__sql__adaptive__advisoryPartitionSizeInBytes="64KB",
        spark__sql__adaptive__coalescePartitions__minPartitionSize="1KB",
    )
    n = 90_000
    frame = spark.range(n, numPartitions=8).select(
        F.col("id"),
        F.lit(2024).alias("partition_year"),
        F.lit(1).alias("partition_month"),
        F.when(F.col("id") % 3 != 0, 1).otherwise(1 + F.col("id") % 31).alias("partition_day"),
    )
    write_partitions(gather_partitions(frame, DATE_PARTITIONS), base, DATE_PARTITIONS)
    written = spark.read.parquet(base)
    assert written.agg(F.count("*"), F.countDistinct("id")).first()[:] == (n, n)
    files = written.select("partition_day", F.input_file_name().alias("file")).distinct()
    per_day = {r.partition_day: r["count"] for r in files.groupBy("partition_day").count().collect()}
    assert per_day[1] > 2
    assert sum(count <= 2 for count in per_day.values()) > 15


@pytest.fixture
def database(spark, read, base):
    refresh_all(spark, read, base, start="2024-01-01", end="2024-02-29", as_of="2024-03-01")
    name = f"mart_{uuid.uuid4().hex}"
    register_tables(spark, name, base)
    yield name
    spark.sql(f"DROP DATABASE {name} CASCADE")


def test_tables_show_partitions_after_discovery(spark, database, read, base):
    assert spark.table(f"{database}.dim_customer").count() == 4
    assert spark.table(f"{database}.fact_sales").count() == 0
    discover_partitions(spark, database)
    assert spark.table(f"{database}.fact_sales").count() == 40
    for name, table in TABLES.items():
        registered = spark.table(f"{database}.{name}").schema
        assert [(f.name, f.dataType) for f in registered] == [(f.name, f.dataType) for f in table.schema]
    refresh_history(read, base, "2024-03-02")
    register_tables(spark, database, base)
    discover_partitions(spark, database)
    assert spark.table(f"{database}.customer_history").count() == 8


def test_discovery_after_a_reload_and_a_replacement(spark, database, read, base):
    discover_partitions(spark, database)
    sales = f"{database}.fact_sales"
    assert spark.table(sales).count() == 40
    refresh_facts(read, base)
    discover_partitions(spark, database)
    assert spark.table(sales).agg(F.sum("Quantity")).first()[0] == 79

    def fewer(name):
        return read(name).filter("invoice_id % 5 <> 3") if name == "invoice" else read(name)

    refresh_facts(fewer, base)
    discover_partitions(spark, database)
    assert spark.table(sales).count() == 32
    assert spark.sql(f"SHOW PARTITIONS {sales}").count() == 8


def test_views_agree_with_reports(spark, database, base):
    discover_partitions(spark, database)
    register_views(spark, database)
    register_views(spark, database)
    tables = curated_tables(spark, base)
    star = Star(*(tables(name) for name in ("fact_sales", "dim_date", "dim_track")))
    every = {"best_day_of_week": {"k": 7}, "best_sales_month": {"k": 1000}}
    for name in REPORTS:
        view = spark.table(f"{database}.v_{name}")
        report = REPORTS[name](star, **every.get(name, {}))
        assert sorted(map(tuple, view.collect())) == sorted(map(tuple, report.collect()))
        assert len(view.columns) == len(report.columns)
    assert set(VIEWS) == {f"v_{name}" for name in REPORTS}
    assert spark.table(f"{database}.v_best_day_of_week").columns == [
        "DayOfWeek",
        "TracksSold",
        "SaleLines",
    ]


def test_a_calendar_filter_prunes_fact_partitions(spark, database, conf, plan):
    conf(spark__sql__maxMetadataStringLength="10000")
    discover_partitions(spark, database)
    register_views(spark, database)
    for name in ("v_best_sales_month", "v_top_artist_by_month"):
        january = spark.table(f"{database}.{name}").filter("Year = 2024 AND Month = 1")
        fact_scan = next(l for l in plan(january).splitlines() if "FileScan" in l and "Quantity" in l)
        assert "dynamicpruning" in fact_scan


def test_views_hold_no_hint_and_follow_the_calendar(spark, database, conf, plan, base):
    discover_partitions(spark, database)
    register_views(spark, database)
    stored = spark.sql(f"SHOW CREATE TABLE {database}.v_best_sales_month").first()[0]
    assert "BROADCAST" not in stored
    conf(spark__sql__autoBroadcastJoinThreshold="-1")
    view = spark.table(f"{database}.v_best_sales_month")
    assert "BroadcastHashJoin" not in plan(view)
    before = sorted(map(tuple, view.collect()))
    refresh_calendar(spark, base, "2020-01-01", "2024-02-29")
    discover_partitions(spark, database)
    assert spark.table(f"{database}.dim_date").count() > 1500
    assert sorted(map(tuple, spark.table(f"{database}.v_best_sales_month").collect())) == before


def files(base):
    return sorted(str(p) for p in Path(base).rglob("*.parquet"))


def test_dropping_the_database_leaves_the_files(spark, read, base):
    refresh_all(spark, read, base, start="2024-01-01", end="2024-02-29", as_of="2024-03-01")
    name = f"mart_{uuid.uuid4().hex}"
    register_tables(spark, name, base)
    discover_partitions(spark, name)
    before = files(base)
    spark.sql(f"DROP DATABASE {name} CASCADE")
    assert before and files(base) == before


def test_tables_can_be_registered_before_they_are_written(spark, read, base, tmp_path):
    source = ["--target", base, "--source", str(tmp_path / "source")]
    database = f"mart_{uuid.uuid4().hex}"
    main(["dimensions", *source])
    main(["tables", "--target", base, "--database", database])
    assert spark.table(f"{database}.dim_track").count() == 4
    assert spark.table(f"{database}.fact_sales").count() == 0
    assert spark.table(f"{database}.v_best_sales_month").count() == 0
    main(["calendar", "--target", base, "--start", "2024-01-01", "--end", "2024-02-29"])
    main(["facts", *source])
    main(["tables", "--target", base, "--database", database])
    assert spark.table(f"{database}.dim_date").count() == 60
    assert spark.table(f"{database}.v_best_sales_month").count() == 2
    spark.sql(f"DROP DATABASE {database} CASCADE")


def test_registration_over_another_base_raises(spark, database, tmp_path):
    with pytest.raises(ValueError, match="registered over"):
        register_tables(spark, database, str(tmp_path / "other"))


def test_further_customer_columns_can_be_read(spark, read, base):
    def wider(name):
        frame = read(name)
        return frame.withColumn("tier", F.lit("vip")) if name == "customer" else frame

    refresh_history(read, base, "2024-01-01")
    refresh_history(wider, base, "2024-01-02")
    frame = whole_customer_history(spark, base)
    tiers = {(r.snapshot_date, r.tier) for r in frame.select("snapshot_date", "tier").collect()}
    assert tiers == {(date(2024, 1, 1), None), (date(2024, 1, 2), "vip")}
    assert curated_tables(spark, base)("customer_history").columns == frame.columns[:-1]


def test_jobs_build_the_mart_in_order(spark, read, base, tmp_path):
    source = ["--target", base, "--source", str(tmp_path / "source")]
    main(["calendar", "--target", base, "--start", "2024-01-01", "--end", "2024-02-29"])
    main(["dimensions", *source])
    main(["facts", *source])
    main(["facts", *source, "--since", "2024-01-03", "--until", "2024-01-04"])
    main(["history", *source, "--as-of", "2024-03-01"])
    database = f"mart_{uuid.uuid4().hex}"
    main(["tables", "--target", base, "--database", database])
    assert spark.table(f"{database}.fact_sales").count() == 40
    assert spark.table(f"{database}.v_best_sales_month").count() == 2
    spark.sql(f"DROP DATABASE {database} CASCADE")
    with pytest.raises(SystemExit):
        main(["calendar", "--target", base, "--start", "yesterday"])
    days = [("XX", date(2024, 1, 2))]
    spark.createDataFrame(days, "country string, holiday_date date").write.parquet(str(tmp_path / "days"))
    given = ["--country", "XX", "--holidays", str(tmp_path / "days")]
    main(["calendar", "--target", base, "--start", "2024-01-01", "--end", "2024-01-03", *given])
    calendar = curated_tables(spark, base)("dim_date")
    assert [r.DateKey for r in calendar.filter("IsHoliday").collect()] == [20240102]
