from datetime import date

import pytest
from dateutil.easter import easter
from pyspark.sql import functions as F

from salesmart.operators.calendar import dim_date, flag_holidays
from salesmart.operators.holidays import holidays_co, with_easter


def years(spark, first, last):
    return spark.range(first, last + 1).select(F.col("id").cast("int").alias("year"))


def test_easter(spark):
    rows = with_easter(years(spark, 1984, 2199)).collect()
    assert [r for r in rows if r.easter != easter(r.year)] == []


def test_holidays_of_2026(spark):
    rows = holidays_co(years(spark, 2026, 2026)).collect()
    assert sorted(r.holiday_date for r in rows) == [
        date(2026, m, d)
        for m, d in [
            (1, 1), (1, 12), (3, 23), (4, 2), (4, 3), (5, 1), (5, 18), (6, 8), (6, 15),
            (6, 29), (7, 20), (8, 7), (8, 17), (10, 12), (11, 2), (11, 16), (12, 8), (12, 25),
        ]
    ]


def test_two_holidays_on_one_date_leave_one_calendar_row(spark):
    rules = holidays_co(years(spark, 2011, 2011))
    assert rules.count() == 18 and rules.select("holiday_date").distinct().count() == 17
    calendar = dim_date(spark, "2011-01-01", "2011-12-31")
    assert (calendar.count(), calendar.filter("IsHoliday").count()) == (365, 17)


def test_years_before_the_monday_rule_are_refused(spark):
    with pytest.raises(ValueError):
        dim_date(spark, "1983-12-31", "1984-01-01")
    with pytest.raises(Exception, match="1984"):
        holidays_co(years(spark, 1983, 1984)).collect()


def test_holidays_of_another_country_are_supplied(spark):
    supplied = spark.createDataFrame(
        [("XX", date(2026, 1, 2), "Second"), ("CO", date(2026, 1, 1), "First")],
        "country string, holiday_date date, name string",
    )
    calendar = dim_date(spark, "2026-01-01", "2026-01-03", "XX", supplied)
    assert [r.FullDate for r in calendar.filter("IsHoliday").collect()] == ["2026-01-02"]
    with pytest.raises(ValueError):
        dim_date(spark, "2026-01-01", "2026-01-03", "XX")


def test_holidays_derived_from_the_flagged_frame(spark):
    orders = spark.createDataFrame(
        [(1, date(2026, 1, 1)), (2, date(2026, 1, 2)), (3, None)], "id int, day date"
    )
    flagged = flag_holidays(
        orders, "day", holidays_co(orders.filter("day IS NOT NULL").select(F.year("day").alias("year")))
    )
    assert {r.id: r.IsHoliday for r in flagged.collect()} == {1: True, 2: False, 3: False}


# Public holidays of Colombia as published, as month * 100 + day.
PUBLISHED = {
    2019: [101, 107, 325, 418, 419, 501, 603, 624, 701, 720, 807, 819, 1014, 1104, 1111, 1208, 1225],
    2023: [101, 109, 320, 406, 407, 501, 522, 612, 619, 703, 720, 807, 821, 1016, 1106, 1113, 1208, 1225],
    2024: [101, 108, 325, 328, 329, 501, 513, 603, 610, 701, 720, 807, 819, 1014, 1104, 1111, 1208, 1225],
    2025: [101, 106, 324, 417, 418, 501, 602, 623, 630, 720, 807, 818, 1013, 1103, 1117, 1208, 1225],
}


def test_published_holidays_of_several_years(spark):
    years = spark.createDataFrame([(y,) for y in PUBLISHED], "year int")
    found = {y: set() for y in PUBLISHED}
    for row in holidays_co(years).collect():
        found[row.holiday_date.year].add(row.holiday_date.month * 100 + row.holiday_date.day)
    assert {y: sorted(days) for y, days in found.items()} == PUBLISHED
