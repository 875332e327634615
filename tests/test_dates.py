from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from salesmart.functions.dates import calendar_columns, date_key, parse_date
from salesmart.operators.calendar import date_range, date_span, dim_date


def test_key_of_a_date_and_of_a_datetime(spark):
    frame = spark.createDataFrame(
        [(date(2026, 4, 26), datetime(2026, 4, 26, 10, 30)), (None, None)], "d date, t timestamp"
    )
    rows = frame.select(date_key("d").alias("d"), date_key(F.col("t")).alias("t")).collect()
    assert [tuple(r) for r in rows] == [(20260426, 20260426), (None, None)]


def test_two_day_calendar(spark):
    frame = dim_date(spark, "2026-01-01", date(2026, 1, 2), "CO").orderBy("DateKey")
    first, second = [row.asDict() for row in frame.collect()]
    assert first == {
        "DateKey": 20260101,
        "FullDate": "2026-01-01",
        "Year": 2026,
        "Quarter": 1,
        "Month": 1,
        "Day": 1,
        "DayOfWeek": "Thursday",
        "IsHoliday": True,
        "partition_year": 2026,
        "partition_month": 1,
        "partition_day": 1,
    }
    assert (second["FullDate"], second["DayOfWeek"], second["IsHoliday"]) == (
        "2026-01-02",
        "Friday",
        False,
    )


def test_calendar_has_one_row_per_day_of_its_range(spark):
    frame = dim_date(spark, "2009-01-01", "2030-12-31")
    ends = frame.agg(F.count("*"), F.countDistinct("DateKey"), F.min("DateKey"), F.max("DateKey"))
    assert tuple(ends.first()) == (8035, 8035, 20090101, 20301231)
    assert dict(frame.dtypes)["DateKey"] == "int"


EDGES = ["1969-12-31", "2024-02-29", "2023-04-01", "2023-09-30", "2023-12-31"]


@pytest.mark.parametrize("day", [date.fromisoformat(d) for d in EDGES])
def test_calendar_parts_agree_with_python(spark, day):
    frame = spark.createDataFrame([(day,)], "day date").select(*calendar_columns("day"))
    assert tuple(frame.first()) == (
        int(day.strftime("%Y%m%d")),
        day.isoformat(),
        day.year,
        (day.month - 1) // 3 + 1,
        day.month,
        day.day,
        day.strftime("%A"),
    )


def test_parse_date(spark):
    assert spark.range(1).select(parse_date(F.lit("2024-02-29"))).first()[0] == date(2024, 2, 29)


def test_date_range_includes_both_ends(spark):
    days = [r.day for r in date_range(spark, "2024-02-28", "2024-03-01").orderBy("day").collect()]
    assert days == [date(2024, 2, 28), date(2024, 2, 29), date(2024, 3, 1)]
    assert date_range(spark, "2024-01-01", "2024-01-01").count() == 1


def test_end_before_start_is_refused(spark):
    with pytest.raises(ValueError):
        date_range(spark, "2024-01-02", "2024-01-01")
    with pytest.raises(ValueError):
        dim_date(spark, "2024-01-02", "2024-01-01")


def test_date_span_follows_the_data(spark):
    frame = spark.createDataFrame(
        [(datetime(2024, 1, 3, 23, 59),), (datetime(2024, 1, 1, 0, 0),), (None,)], "t timestamp"
    )
    assert date_span(frame, "t").count() == 3
    assert date_span(frame.filter("t IS NULL"), "t").count() == 0
