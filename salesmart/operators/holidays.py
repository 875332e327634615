"""Public holidays of Colombia, computed from the rules of law 51 of 1983."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FIRST_YEAR = 1984

# Holidays kept on their own date (month, day, name).
FIXED = [
    (1, 1, "New Year's Day"),
    (5, 1, "Labour Day"),
    (7, 20, "Independence Day"),
    (8, 7, "Battle of Boyaca"),
    (12, 8, "Immaculate Conception"),
    (12, 25, "Christmas Day"),
]

# Holidays moved to the next Monday unless they fall on one (month, day, name).
MOVED = [
    (1, 6, "Epiphany"),
    (3, 19, "Saint Joseph's Day"),
    (6, 29, "Saint Peter and Saint Paul"),
    (8, 15, "Assumption"),
    (10, 12, "Columbus Day"),
    (11, 1, "All Saints' Day"),
    (11, 11, "Independence of Cartagena"),
]

# Days after Easter Sunday and name.
AROUND_EASTER = [
    (-3, "Maundy Thursday"),
    (-2, "Good Friday"),
    (43, "Ascension"),
    (64, "Corpus Christi"),
    (71, "Sacred Heart"),
]


def with_easter(years: DataFrame) -> DataFrame:
    """Add the date of Easter Sunday to a frame with an int column ``year``.

    The anonymous Gregorian algorithm in integer arithmetic, each step naming the next.
    """
    steps = years.selectExpr(
        "*",
        "year % 19 AS golden",
        "year div 100 AS century",
        "(19 * golden + century - century div 4"
        " - (century - (century + 8) div 25 + 1) div 3 + 15) % 30 AS epact",
        "(32 + 2 * (century % 4) + 2 * ((year % 100) div 4) - epact - year % 100 % 4) % 7"
        " AS weekday",
        "epact + weekday - 7 * ((golden + 11 * epact + 22 * weekday) div 451) AS offset",
    )
    march_22 = F.make_date("year", F.lit(3), F.lit(22))
    return steps.select(
        *years.columns, F.date_add(march_22, F.col("offset").cast("int")).alias("easter")
    )


def holidays_co(years: DataFrame) -> DataFrame:
    """``(country, holiday_date, name)`` for every year in ``years.year``.

    One row per holiday; two holidays may share a date. Years before 1984 raise, since the
    Monday rule did not hold then.
    """
    rules = [(f"make_date(year, {month}, {day})", name) for month, day, name in FIXED]
    rules += [
        (f"next_day(date_sub(make_date(year, {month}, {day}), 1), 'MON')", name)
        for month, day, name in MOVED
    ]
    rules += [(f"date_add(easter, {days})", name) for days, name in AROUND_EASTER]
    structs = []
    for day, name in rules:
        quoted = name.replace("'", "\\'")
        structs.append(f"struct({day} AS holiday_date, '{quoted}' AS name)")
    checked = years.selectExpr(
        f"IF(year < {FIRST_YEAR}, raise_error('built-in holidays start in {FIRST_YEAR}'), year)"
        " AS year"
    )
    return with_easter(checked).selectExpr("'CO' AS country", f"inline(array({', '.join(structs)}))")
