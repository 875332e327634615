"""Public holidays of several countries, computed from a table of rules.

A rule names a day of each year it is in force: a fixed date, the n-th or last weekday of a month, the weekday before or
from a date, or days from Easter Sunday of the western or the eastern church. A holiday on a weekend may have an
observed day as well, which is a holiday of its own. Rules are data; one expression evaluates them for any year.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salesmart.operators.holidays import FIRST_YEAR, holidays_co, with_easter


def fixed(month: int, day: int) -> str:
    return f"make_date(year, {month}, {day})"


def nth(n: int, weekday: str, month: int) -> str:
    """The n-th ``weekday`` of a month, or the last with -1."""
    first = fixed(month, 1)
    if n < 0:
        return f"next_day(date_sub(last_day({first}), 7), '{weekday}')"
    return f"date_add(next_day(date_sub({first}, 1), '{weekday}'), {7 * (n - 1)})"


def before(weekday: str, month: int, day: int) -> str:
    """The last ``weekday`` before a date."""
    return f"next_day(date_sub({fixed(month, day)}, 8), '{weekday}')"


def since(weekday: str, month: int, day: int) -> str:
    """The first ``weekday`` on a date or after it."""
    return f"next_day(date_sub({fixed(month, day)}, 1), '{weekday}')"


def easter(days: int) -> str:
    return f"date_add(easter, {days})"


def orthodox(days: int) -> str:
    return f"date_add(orthodox, {days})"


@dataclass(frozen=True)
class Rule:
    """``first`` and ``last``: years in force. ``saturday`` and ``sunday``: days to the observed day."""

    name: str
    day: str
    first: int | None = None
    last: int | None = None
    saturday: int = 0
    sunday: int = 0


def _nearest(name: str, day: str, first: int | None = None) -> Rule:
    """Observed on the Friday before or the Monday after."""
    return Rule(name, day, first, saturday=-1, sunday=1)


@dataclass(frozen=True)
class Country:
    """``since``: the first year for which the rules hold; earlier years raise."""

    since: int
    rules: tuple[Rule, ...]


# Nationwide public holidays by law.
COUNTRIES = {
    "US": Country(
        1971,
        (
            _nearest("New Year's Day", fixed(1, 1)),
            Rule("Martin Luther King Jr. Day", nth(3, "MON", 1), 1986),
            Rule("Washington's Birthday", nth(3, "MON", 2)),
            Rule("Memorial Day", nth(-1, "MON", 5)),
            _nearest("Juneteenth", fixed(6, 19), 2021),
            _nearest("Independence Day", fixed(7, 4)),
            Rule("Labor Day", nth(1, "MON", 9)),
            Rule("Columbus Day", nth(2, "MON", 10)),
            Rule("Veterans Day", nth(4, "MON", 10), last=1977),
            _nearest("Veterans Day", fixed(11, 11), 1978),
            Rule("Thanksgiving", nth(4, "THU", 11)),
            _nearest("Christmas Day", fixed(12, 25)),
        ),
    ),
    "DE": Country(
        1991,
        (
            Rule("New Year's Day", fixed(1, 1)),
            Rule("Good Friday", easter(-2)),
            Rule("Easter Monday", easter(1)),
            Rule("Labour Day", fixed(5, 1)),
            Rule("Ascension", easter(39)),
            Rule("Whit Monday", easter(50)),
            Rule("German Unity Day", fixed(10, 3)),
            Rule("Reformation Day", fixed(10, 31), 2017, 2017),
            Rule("Repentance Day", before("WED", 11, 23), last=1994),
            Rule("Christmas Day", fixed(12, 25)),
            Rule("Second Day of Christmas", fixed(12, 26)),
        ),
    ),
    "FR": Country(
        1982,
        (
            Rule("New Year's Day", fixed(1, 1)),
            Rule("Easter Monday", easter(1)),
            Rule("Labour Day", fixed(5, 1)),
            Rule("Victory Day", fixed(5, 8)),
            Rule("Ascension", easter(39)),
            Rule("Whit Monday", easter(50)),
            Rule("National Day", fixed(7, 14)),
            Rule("Assumption", fixed(8, 15)),
            Rule("All Saints' Day", fixed(11, 1)),
            Rule("Armistice Day", fixed(11, 11)),
            Rule("Christmas Day", fixed(12, 25)),
        ),
    ),
    "GR": Country(
        1975,
        (
            Rule("New Year's Day", fixed(1, 1)),
            Rule("Epiphany", fixed(1, 6)),
            Rule("Clean Monday", orthodox(-48)),
            Rule("Independence Day", fixed(3, 25)),
            Rule("Good Friday", orthodox(-2)),
            Rule("Easter Monday", orthodox(1)),
            Rule("Labour Day", fixed(5, 1)),
            Rule("Whit Monday", orthodox(50)),
            Rule("Assumption", fixed(8, 15)),
            Rule("Ochi Day", fixed(10, 28)),
            Rule("Christmas Day", fixed(12, 25)),
            Rule("Glorifying of the Mother of God", fixed(12, 26)),
        ),
    ),
    "CA": Country(
        1983,
        (
            Rule("New Year's Day", fixed(1, 1)),
            Rule("Good Friday", easter(-2)),
            Rule("Victoria Day", before("MON", 5, 25)),
            Rule("Canada Day", fixed(7, 1)),
            Rule("Labour Day", nth(1, "MON", 9)),
            Rule("Truth and Reconciliation Day", fixed(9, 30), 2021),
            Rule("Thanksgiving", nth(2, "MON", 10)),
            Rule("Remembrance Day", fixed(11, 11)),
            Rule("Christmas Day", fixed(12, 25)),
        ),
    ),
    "SE": Country(
        2005,
        (
            Rule("New Year's Day", fixed(1, 1)),
            Rule("Epiphany", fixed(1, 6)),
            Rule("Good Friday", easter(-2)),
            Rule("Easter Sunday", easter(0)),
            Rule("Easter Monday", easter(1)),
            Rule("Labour Day", fixed(5, 1)),
            Rule("Ascension", easter(39)),
            Rule("Whit Sunday", easter(49)),
            Rule("National Day", fixed(6, 6)),
            Rule("Midsummer Day", since("SAT", 6, 20)),
            Rule("All Saints' Day", since("SAT", 10, 31)),
            Rule("Christmas Day", fixed(12, 25)),
            Rule("Second Day of Christmas", fixed(12, 26)),
        ),
    ),
}


def first_year(country: str) -> int:
    """The first year with holidays of a country; a country without rules raises."""
    if country == "CO":
        return FIRST_YEAR
    if country not in COUNTRIES:
        known = ", ".join(sorted([*COUNTRIES, "CO"]))
        raise ValueError(f"no built-in holidays for {country!r} (there are {known}): pass a holidays frame")
    return COUNTRIES[country].since


def with_orthodox_easter(years: DataFrame) -> DataFrame:
    """Add the Gregorian date of the eastern Easter Sunday, reckoned in the Julian calendar.

    The full moon of the 19-year cycle gives a Julian day of March, the weekday the Sunday after it; the calendars
    differ by a number of days that grows with the centuries.
    """
    steps = years.selectExpr(
        "*",
        "(19 * (year % 19) + 15) % 30 AS moon",
        "(2 * (year % 4) + 4 * (year % 7) - moon + 34) % 7 AS sunday",
        "year div 100 - year div 400 - 2 AS apart",
    )
    march_21 = F.make_date("year", F.lit(3), F.lit(21))
    days = (F.col("moon") + F.col("sunday") + 1 + F.col("apart")).cast("int")
    return steps.select(*years.columns, F.date_add(march_21, days).alias("orthodox"))


def country_holidays(years: DataFrame, country: str) -> DataFrame:
    """``(country, holiday_date, name)`` of the holidays that fall into the years of ``years.year``.

    Observed days are rows of their own, named so; one may fall into the year before that of its holiday. Two holidays may share a
    date. Null years give no rows; years before the country's first one raise, and so does an unknown country.
    """
    first = first_year(country)
    if country == "CO":
        return holidays_co(years)
    wanted = years.where("year IS NOT NULL").selectExpr(
        f"IF(year < {first}, raise_error('holidays of {country} start in {first}'), year) AS wanted"
    )
    each = wanted.distinct().selectExpr("wanted", "explode(array(wanted, wanted + 1)) AS year")
    structs = []
    for rule in COUNTRIES[country].rules:
        name = rule.name.replace("'", "\\'")
        low, high = rule.first or first, rule.last or 9999
        day = f"IF(year BETWEEN {low} AND {high}, {rule.day}, NULL)"
        structs.append(f"struct({day} AS holiday_date, '{name}' AS name)")
        for weekday, shift in ((7, rule.saturday), (1, rule.sunday)):
            if shift:
                moved = f"IF(dayofweek({day}) = {weekday}, date_add({day}, {shift}), NULL)"
                structs.append(f"struct({moved} AS holiday_date, '{name} (observed)' AS name)")
    dated = with_orthodox_easter(with_easter(each)).selectExpr("wanted", f"inline(array({', '.join(structs)}))")
    return dated.where("year(holiday_date) = wanted").select(F.lit(country).alias("country"), "holiday_date", "name")
