"""Reports on random small stars against join-first SQL: nulls, strays, ties, unknown artists."""

import random
from datetime import date, timedelta
from decimal import Decimal

import duckdb
import pytest

from salesmart.operators.calendar import dim_date
from salesmart.plans.reports import REPORTS, Star
from salesmart.schemas import TABLES
from workload.compare import oracle_rows, spark_rows

JOINED = "fact f JOIN calendar d ON f.InvoiceDateKey = d.DateKey"
SQL = {
    "tracks_sold_by_day": f"""SELECT FullDate, CAST(sum(Quantity) AS BIGINT) AS tracks_sold
        FROM {JOINED} GROUP BY FullDate""",
    "best_day_of_week": f"""SELECT DayOfWeek, CAST(sum(Quantity) AS BIGINT) AS tracks_sold,
        count(*) AS sale_lines FROM {JOINED} GROUP BY DayOfWeek
        ORDER BY tracks_sold DESC NULLS LAST, sale_lines DESC, DayOfWeek LIMIT 3""",
    "best_sales_month": f"""SELECT "Year", "Month", CAST(sum(Quantity) AS BIGINT) AS tracks_sold,
        CAST(sum(TotalAmount) AS DECIMAL(20,2)) AS revenue FROM {JOINED} GROUP BY "Year", "Month"
        ORDER BY tracks_sold DESC NULLS LAST, revenue DESC NULLS LAST, "Year", "Month" LIMIT 3""",
    "top_artist_by_month": f"""SELECT "Year", "Month", Artist, tracks_sold FROM (
        SELECT "Year", "Month", Artist, CAST(sum(Quantity) AS BIGINT) AS tracks_sold,
          row_number() OVER (PARTITION BY "Year", "Month"
            ORDER BY sum(Quantity) DESC NULLS LAST, Artist ASC NULLS LAST) AS rn
        FROM {JOINED} JOIN track t ON f.TrackKey = t.TrackKey
        GROUP BY "Year", "Month", Artist) WHERE rn <= 3""",
}


def random_facts(rng, size):
    for _ in range(size):
        day = date(2024, 1, 1) + timedelta(days=rng.choice([0, 0, 0, *range(120)]))
        known = rng.random() > 0.05
        yield (
            rng.randrange(9),
            rng.choice([0, 0, 0, 1, 2, 3, 4, 5, 6, 7, None]),
            int(day.strftime("%Y%m%d")) if known else None,
            None,
            rng.choice([1, 1, 2, 3, None]),
            Decimal("1.00"),
            rng.choice([Decimal("1.25"), Decimal("-0.50"), None]),
            *((day.year, day.month, day.day) if known else (None, None, None)),
        )


@pytest.mark.parametrize("seed", range(3))
def test_reports_on_random_stars(spark, seed):
    rng = random.Random(seed)
    facts = list(random_facts(rng, rng.choice([5, 60, 400])))
    tracks = [
        (key, "t", None, rng.choice(["A", "B", "C", None]), None, None, None, 1) for key in range(7)
    ]
    star = Star(
        spark.createDataFrame(facts, TABLES["fact_sales"].schema),
        dim_date(spark, "2024-01-01", "2024-03-15"),
        spark.createDataFrame(tracks, TABLES["dim_track"].schema),
    )
    connection = duckdb.connect()
    for name, frame in {
        "fact": star.fact_sales,
        "calendar": star.dim_date,
        "track": star.dim_track,
    }.items():
        arrow = frame.toArrow()
        connection.register(name, arrow)
    for name, sql in SQL.items():
        options = {} if name == "tracks_sold_by_day" else {"k": 3}
        report = REPORTS[name](star, **options)
        assert spark_rows(report) == oracle_rows(connection, sql), name
