from datetime import date

import pytest
from dateutil.easter import EASTER_ORTHODOX, easter
from pyspark.sql import functions as F

from salesmart.operators.calendar import dim_date
from salesmart.operators.holiday_rules import COUNTRIES, country_holidays, first_year, with_orthodox_easter

# Public holidays as published, as month * 100 + day; observed days included.
PUBLISHED = {
    ("US", 2020): [101, 120, 217, 525, 703, 704, 907, 1012, 1111, 1126, 1225],
    ("US", 2021): [101, 118, 215, 531, 618, 619, 704, 705, 906, 1011, 1111, 1125, 1224, 1225, 1231],
    ("US", 2022): [101, 117, 221, 530, 619, 620, 704, 905, 1010, 1111, 1124, 1225, 1226],
    ("US", 2023): [101, 102, 116, 220, 529, 619, 704, 904, 1009, 1110, 1111, 1123, 1225],
    ("US", 2024): [101, 115, 219, 527, 619, 704, 902, 1014, 1111, 1128, 1225],
    ("US", 1977): [101, 221, 530, 704, 905, 1010, 1024, 1124, 1225, 1226],
    ("DE", 1994): [101, 401, 404, 501, 512, 523, 1003, 1116, 1225, 1226],
    ("DE", 2017): [101, 414, 417, 501, 525, 605, 1003, 1031, 1225, 1226],
    ("DE", 2024): [101, 329, 401, 501, 509, 520, 1003, 1225, 1226],
    ("DE", 2025): [101, 418, 421, 501, 529, 609, 1003, 1225, 1226],
    ("FR", 2024): [101, 401, 501, 508, 509, 520, 714, 815, 1101, 1111, 1225],
    ("FR", 2008): [101, 324, 501, 501, 508, 512, 714, 815, 1101, 1111, 1225],
    ("GR", 2024): [101, 106, 318, 325, 501, 503, 506, 624, 815, 1028, 1225, 1226],
    ("GR", 2023): [101, 106, 227, 325, 414, 417, 501, 605, 815, 1028, 1225, 1226],
    ("GR", 2021): [101, 106, 315, 325, 430, 501, 503, 621, 815, 1028, 1225, 1226],
    ("CA", 2024): [101, 329, 520, 701, 902, 930, 1014, 1111, 1225],
    ("CA", 2020): [101, 410, 518, 701, 907, 1012, 1111, 1225],
    ("SE", 2024): [101, 106, 329, 331, 401, 501, 509, 519, 606, 622, 1102, 1225, 1226],
    ("SE", 2020): [101, 106, 410, 412, 413, 501, 521, 531, 606, 620, 1031, 1225, 1226],
}


def years(spark, *found):
    return spark.createDataFrame([(y,) for y in found], "year int")


def test_published_holidays(spark):
    for country in COUNTRIES:
        own = [y for c, y in PUBLISHED if c == country]
        rows = country_holidays(years(spark, *own, None, own[0]), country).collect()
        for year in own:
            days = sorted(r.holiday_date.month * 100 + r.holiday_date.day for r in rows if r.holiday_date.year == year)
            assert days == PUBLISHED[country, year], (country, year)
        assert {r.country for r in rows} == {country}
        assert {r.holiday_date.year for r in rows} == set(own)


def test_eastern_easter(spark):
    every = spark.range(1900, 2200).select(F.col("id").cast("int").alias("year"))
    rows = with_orthodox_easter(every).collect()
    assert [r for r in rows if r.orthodox != easter(r.year, EASTER_ORTHODOX)] == []


def test_an_observed_day_in_the_year_before(spark):
    rows = country_holidays(years(spark, 2010), "US").where("month(holiday_date) = 12").collect()
    assert sorted((r.holiday_date, r.name) for r in rows) == [
        (date(2010, 12, 24), "Christmas Day (observed)"),
        (date(2010, 12, 25), "Christmas Day"),
        (date(2010, 12, 31), "New Year's Day (observed)"),
    ]


def test_calendars_of_several_countries(spark):
    for country, n in (("US", 11), ("DE", 9), ("FR", 11), ("GR", 12), ("CO", 18)):
        calendar = dim_date(spark, "2024-01-01", "2024-12-31", country)
        assert (calendar.count(), calendar.filter("IsHoliday").count()) == (366, n), country


def test_unknown_countries_and_early_years_are_refused(spark):
    with pytest.raises(ValueError, match="CO, DE"):
        first_year("XX")
    with pytest.raises(ValueError):
        country_holidays(years(spark, 2024), "us")
    with pytest.raises(ValueError, match="1991"):
        dim_date(spark, "1990-12-31", "1991-01-01", "DE")
    with pytest.raises(Exception, match="1991"):
        country_holidays(years(spark, 1990), "DE").collect()
    assert first_year("CO") == 1984
    assert country_holidays(years(spark, 2024), "CO").count() == 18
