"""The same results as plain SQL over the given tables, for DuckDB.

Written join-first and aggregated once, unlike the Spark plans. Easter uses a different
algorithm (Gauss, valid 1900-2099).
"""

from __future__ import annotations

from workload.mart import EARLIER_SNAPSHOT_DAY, RELOADED_DAYS
from workload.sample import SNAPSHOT_DAY

CUSTOMER = """
customer_src AS (
  SELECT c_custkey AS customer_id, split_part(c_name, '#', 1) AS first_name,
         split_part(c_name, '#', 2) AS last_name, c_mktsegment AS company,
         CAST(NULL AS VARCHAR) AS address,
         'City ' || CAST(c_custkey % 97 AS VARCHAR) AS city, r_name AS state, n_name AS country,
         CAST(NULL AS VARCHAR) AS postal_code, CAST(NULL AS VARCHAR) AS phone,
         CAST(NULL AS VARCHAR) AS fax,
         'c' || CAST(c_custkey AS VARCHAR) || '@example.com' AS email,
         c_nationkey AS support_rep_id
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
)"""

TRACK = """
track_dim AS (
  SELECT CAST(p_partkey AS INTEGER) AS TrackKey, p_name AS Name, Album, n_name AS Artist,
         p_type AS Genre, MediaType, CAST(NULL AS VARCHAR) AS Composer,
         CAST(p_size * 1000 AS INTEGER) AS Milliseconds
  FROM part
  LEFT JOIN (SELECT DISTINCT p_size AS album_id, 'Album ' || CAST(p_size AS VARCHAR) AS Album
             FROM part) ON album_id = p_size
  LEFT JOIN (SELECT n_nationkey, n_name FROM nation WHERE n_nationkey <> {artist})
    ON n_nationkey = album_id % 25
  LEFT JOIN (SELECT DISTINCT p_brand AS MediaType FROM part WHERE p_brand <> '{media}')
    ON MediaType = p_brand
)"""
GAP_TRACK = TRACK.replace("{artist}", "24").replace("{media}", "Brand#13")
TRACK = TRACK.replace(" WHERE n_nationkey <> {artist}", "").replace(" WHERE p_brand <> '{media}'", "")

FACT = f"""{CUSTOMER},
fact AS (
  SELECT CAST(o_custkey AS INTEGER) AS CustomerKey, CAST(l_partkey AS INTEGER) AS TrackKey,
         CAST(strftime(o_orderdate, '%Y%m%d') AS INTEGER) AS InvoiceDateKey,
         support_rep_id AS EmployeeKey, CAST(l_quantity AS INTEGER) AS Quantity,
         CAST(l_extendedprice AS DECIMAL(10,2)) AS UnitPrice,
         CAST(CAST(l_extendedprice AS DECIMAL(10,2)) * CAST(l_quantity AS INTEGER)
              AS DECIMAL(10,2)) AS TotalAmount,
         CAST(year(o_orderdate) AS INTEGER) AS partition_year,
         CAST(month(o_orderdate) AS INTEGER) AS partition_month,
         CAST(day(o_orderdate) AS INTEGER) AS partition_day
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  LEFT JOIN {{customers}} ON customer_id = o_custkey
)"""

SALES = FACT.replace("{customers}", "customer_src")

EMPLOYEE = """
employee_src AS (
  SELECT CAST(s_suppkey AS INTEGER) AS employee_id, split_part(s_name, '#', 1) AS first_name,
         split_part(s_name, '#', 2) AS last_name, n_name AS title,
         CASE WHEN s_suppkey % 10 <> 0 THEN CAST(s_suppkey - s_suppkey % 10 AS INTEGER) END
           AS reports_to
  FROM supplier JOIN nation ON s_nationkey = n_nationkey
),
reports AS (
  SELECT e.employee_id AS EmployeeKey, e.first_name AS FirstName, e.last_name AS LastName,
         e.title AS Title, e.reports_to AS ReportsToEmployeeKey,
         concat_ws(' ', m.first_name, m.last_name) AS ReportsToName
  FROM employee_src e LEFT JOIN employee_src m ON e.reports_to = m.employee_id
)"""


def days(first: str, last: str) -> str:
    return (
        "days AS (SELECT CAST(unnest(generate_series("
        f"CAST({first} AS TIMESTAMP), CAST({last} AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS day)"
    )


ORDER_DAYS = days(
    "(SELECT CAST(min(o_orderdate) AS DATE) FROM orders)",
    "(SELECT CAST(max(o_orderdate) AS DATE) FROM orders)",
)
CALENDAR_YEARS = "years AS (SELECT DISTINCT CAST(year(day) AS INTEGER) AS y FROM days)"
ORDER_YEARS = "years AS (SELECT DISTINCT CAST(year(o_orderdate) AS INTEGER) AS y FROM orders)"

_FIXED = [
    (1, 1, "New Year''s Day"),
    (5, 1, "Labour Day"),
    (7, 20, "Independence Day"),
    (8, 7, "Battle of Boyaca"),
    (12, 8, "Immaculate Conception"),
    (12, 25, "Christmas Day"),
]
_MOVED = [
    (1, 6, "Epiphany"),
    (3, 19, "Saint Joseph''s Day"),
    (6, 29, "Saint Peter and Saint Paul"),
    (8, 15, "Assumption"),
    (10, 12, "Columbus Day"),
    (11, 1, "All Saints'' Day"),
    (11, 11, "Independence of Cartagena"),
]
_EASTER = [
    (-3, "Maundy Thursday"),
    (-2, "Good Friday"),
    (43, "Ascension"),
    (64, "Corpus Christi"),
    (71, "Sacred Heart"),
]


def _rules(rows: list[tuple]) -> str:
    return "VALUES " + ", ".join(
        "(" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in row) + ")"
        for row in rows
    )


HOLIDAYS = f"""
gauss AS (
  SELECT y, y % 19 AS a, (19 * (y % 19) + 24) % 30 AS d,
         (2 * (y % 4) + 4 * (y % 7) + 6 * ((19 * (y % 19) + 24) % 30) + 5) % 7 AS e
  FROM years
),
easter AS (
  SELECT y, make_date(y, 3, 22) + CAST(
    d + e - CASE WHEN (d = 29 OR (d = 28 AND a > 10)) AND e = 6 THEN 7 ELSE 0 END AS INTEGER)
    AS sunday
  FROM gauss
),
holidays AS (
  SELECT make_date(y, m, dd) AS holiday_date, name
  FROM years, ({_rules(_FIXED)}) AS f(m, dd, name)
  UNION ALL
  SELECT make_date(y, m, dd) + CAST((8 - isodow(make_date(y, m, dd))) % 7 AS INTEGER), name
  FROM years, ({_rules(_MOVED)}) AS f(m, dd, name)
  UNION ALL
  SELECT sunday + off, name FROM easter, ({_rules(_EASTER)}) AS f(off, name)
)"""

_DATED = [
    ("US", 1, 1, "New Year''s Day", 1), ("US", 7, 4, "Independence Day", 1), ("US", 11, 11, "Veterans Day", 1),
    ("US", 12, 25, "Christmas Day", 1), ("DE", 1, 1, "New Year''s Day", 0), ("DE", 5, 1, "Labour Day", 0),
    ("DE", 10, 3, "German Unity Day", 0), ("DE", 12, 25, "Christmas Day", 0), ("DE", 12, 26, "Second Day of Christmas", 0),
    ("FR", 1, 1, "New Year''s Day", 0), ("FR", 5, 1, "Labour Day", 0), ("FR", 5, 8, "Victory Day", 0),
    ("FR", 7, 14, "National Day", 0), ("FR", 8, 15, "Assumption", 0), ("FR", 11, 1, "All Saints'' Day", 0),
    ("FR", 11, 11, "Armistice Day", 0), ("FR", 12, 25, "Christmas Day", 0), ("GR", 1, 1, "New Year''s Day", 0),
    ("GR", 1, 6, "Epiphany", 0), ("GR", 3, 25, "Independence Day", 0), ("GR", 5, 1, "Labour Day", 0),
    ("GR", 8, 15, "Assumption", 0), ("GR", 10, 28, "Ochi Day", 0), ("GR", 12, 25, "Christmas Day", 0),
    ("GR", 12, 26, "Glorifying of the Mother of God", 0), ("CA", 1, 1, "New Year''s Day", 0), ("CA", 7, 1, "Canada Day", 0),
    ("CA", 11, 11, "Remembrance Day", 0), ("CA", 12, 25, "Christmas Day", 0),
]
# The n-th weekday (1 is Monday) of a month, counted from its end with a negative number.
_WEEKDAYS = [
    ("US", 1, 1, 3, "Martin Luther King Jr. Day"), ("US", 2, 1, 3, "Washington''s Birthday"), ("US", 5, 1, -1, "Memorial Day"),
    ("US", 9, 1, 1, "Labor Day"), ("US", 10, 1, 2, "Columbus Day"), ("US", 11, 4, 4, "Thanksgiving"),
    ("CA", 9, 1, 1, "Labour Day"), ("CA", 10, 1, 2, "Thanksgiving"),
]
_WESTERN = [
    ("DE", -2, "Good Friday"), ("DE", 1, "Easter Monday"), ("DE", 39, "Ascension"), ("DE", 50, "Whit Monday"),
    ("FR", 1, "Easter Monday"), ("FR", 39, "Ascension"), ("FR", 50, "Whit Monday"), ("CA", -2, "Good Friday"),
]
_EASTERN = [("GR", -48, "Clean Monday"), ("GR", -2, "Good Friday"), ("GR", 1, "Easter Monday"), ("GR", 50, "Whit Monday")]

COUNTRY_HOLIDAYS = f"""
around AS (SELECT y FROM years UNION SELECT y + 1 FROM years),
dated AS (
  SELECT country, make_date(y, m, dd) AS holiday_date, name, moves FROM around, ({_rules(_DATED)}) AS f(country, m, dd, name, moves)
),
every AS (
  SELECT day, isodow(day) AS w, CAST(month(day) AS INTEGER) AS m,
         row_number() OVER (PARTITION BY year(day), month(day), isodow(day) ORDER BY day) AS n,
         -row_number() OVER (PARTITION BY year(day), month(day), isodow(day) ORDER BY day DESC) AS back
  FROM (SELECT CAST(unnest(generate_series(CAST(make_date(y, 1, 1) AS TIMESTAMP),
          CAST(make_date(y, 12, 31) AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS day FROM years)
),
eastern AS (
  SELECT y, make_date(y, 3, 22) + CAST(13 + d + (2 * (y % 4) + 4 * (y % 7) + 6 * d + 6) % 7 AS INTEGER) AS sunday
  FROM (SELECT y, (19 * (y % 19) + 15) % 30 AS d FROM years)
),
by_country AS (
  SELECT country, holiday_date, name FROM dated
  UNION ALL SELECT country, holiday_date + 1, name || ' (observed)' FROM dated WHERE moves = 1 AND isodow(holiday_date) = 7
  UNION ALL SELECT country, holiday_date - 1, name || ' (observed)' FROM dated WHERE moves = 1 AND isodow(holiday_date) = 6
  UNION ALL SELECT country, day, name FROM every JOIN ({_rules(_WEEKDAYS)}) AS f(country, mm, ww, nn, name)
    ON mm = m AND ww = w AND nn IN (n, back)
  UNION ALL SELECT country, sunday + off, name FROM easter, ({_rules(_WESTERN)}) AS f(country, off, name)
  UNION ALL SELECT country, sunday + off, name FROM eastern, ({_rules(_EASTERN)}) AS f(country, off, name)
  UNION ALL SELECT 'CA', max(day), 'Victoria Day' FROM every WHERE w = 1 AND m = 5 AND day(day) < 25 GROUP BY year(day)
  UNION ALL SELECT 'DE', max(day), 'Repentance Day' FROM every
    WHERE w = 3 AND m = 11 AND day(day) < 23 AND year(day) <= 1994 GROUP BY year(day)
  UNION ALL SELECT 'CO', holiday_date, name FROM holidays
)"""

DATE_DIM = f"""{CALENDAR_YEARS}, {HOLIDAYS},
date_dim AS (
  SELECT CAST(strftime(day, '%Y%m%d') AS INTEGER) AS DateKey,
         strftime(day, '%Y-%m-%d') AS FullDate,
         CAST(year(day) AS INTEGER) AS Year, CAST(quarter(day) AS INTEGER) AS Quarter,
         CAST(month(day) AS INTEGER) AS Month, CAST(day(day) AS INTEGER) AS Day,
         dayname(day) AS DayOfWeek,
         day IN (SELECT holiday_date FROM holidays) AS IsHoliday,
         CAST(year(day) AS INTEGER) AS partition_year,
         CAST(month(day) AS INTEGER) AS partition_month,
         CAST(day(day) AS INTEGER) AS partition_day
  FROM days
)"""

STAR = f"WITH {SALES}, {TRACK}, {ORDER_DAYS}, {DATE_DIM}"
GAP_STAR = f"WITH {SALES}, {GAP_TRACK}, {ORDER_DAYS}, {DATE_DIM}"


def _top_artist(units: str, name: str, star: str = STAR) -> str:
    """The month's maximum, then the least name with it; a null name only if there is no other."""
    return f"""{star}, totals AS (
  SELECT "Year", "Month", Artist, CAST(sum({units}) AS BIGINT) AS units
  FROM fact f JOIN date_dim d ON f.InvoiceDateKey = d.DateKey
  JOIN track_dim t ON f.TrackKey = t.TrackKey GROUP BY "Year", "Month", Artist),
most AS (SELECT "Year" AS y, "Month" AS m, max(units) AS top FROM totals GROUP BY "Year", "Month")
SELECT "Year", "Month", min(Artist) AS Artist, max(units) AS {name}
FROM totals JOIN most ON "Year" = y AND "Month" = m AND units = top GROUP BY y, m, "Year", "Month" """


def _totals(star: str, group: str, units: str, lines: str = "", revenue: str = "") -> str:
    columns = [group, f"CAST(sum(Quantity) AS BIGINT) AS {units}"]
    if lines:
        columns.append(f"count(*) AS {lines}")
    if revenue:
        columns.append(f"CAST(sum(TotalAmount) AS DECIMAL(20,2)) AS {revenue}")
    return (
        f"{star} SELECT {', '.join(columns)} FROM fact f "
        f"JOIN date_dim d ON f.InvoiceDateKey = d.DateKey GROUP BY {group}"
    )


_MONTH = '"Year", "Month"'
_GAP_DAYS = days("'1996-02-10'", "'2000-06-20'")
_GAP_STAR = f"WITH {SALES}, {_GAP_DAYS}, {DATE_DIM}"
_CUSTOMER_COLUMNS = (
    "CAST(customer_id AS INTEGER) AS customer_id, first_name, last_name, company, address, city, "
    "state, country, postal_code, phone, fax, email, support_rep_id"
)
_TWO_DAYS = f"(VALUES (DATE '{EARLIER_SNAPSHOT_DAY}'), (DATE '{SNAPSHOT_DAY}')) AS s(snapshot_date)"

ORACLES: dict[str, str] = {
    "dim_customer": f"""WITH {CUSTOMER}
        SELECT CAST(customer_id AS INTEGER) AS CustomerKey, first_name AS FirstName,
               last_name AS LastName, company AS Company, country AS Country, city AS City,
               state AS State, email AS Email FROM customer_src""",
    "dim_track": f"WITH {TRACK} SELECT * FROM track_dim",
    "dim_date": f"WITH {ORDER_DAYS}, {DATE_DIM} SELECT * FROM date_dim",
    "fact_sales": f"WITH {SALES} SELECT * FROM fact",
    "fact_one_month": f"""WITH {SALES} SELECT * FROM fact
        WHERE InvoiceDateKey BETWEEN {RELOADED_DAYS[0].replace("-", "")}
          AND {RELOADED_DAYS[1].replace("-", "")}""",
    "fact_bounded_undated": f"""WITH {SALES.replace(
        "FROM lineitem JOIN orders ON",
        "FROM lineitem JOIN (SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 50 <> 0 "
        "THEN o_orderdate END AS o_orderdate FROM orders) ON")} SELECT * FROM fact
        WHERE InvoiceDateKey IS NULL OR InvoiceDateKey BETWEEN {RELOADED_DAYS[0].replace("-", "")}
          AND {RELOADED_DAYS[1].replace("-", "")}""",
    "fact_reload_withdrawn": f"""WITH {SALES} SELECT InvoiceDateKey, count(*) AS sale_lines,
        CAST(sum(Quantity) AS BIGINT) AS units FROM fact GROUP BY InvoiceDateKey""",
    "fact_reload_redated": f"""WITH {SALES} SELECT InvoiceDateKey, count(*) AS sale_lines,
        CAST(sum(Quantity) AS BIGINT) AS units FROM fact GROUP BY InvoiceDateKey""",
    "fact_changed_days": f"""WITH {SALES},
        corrected AS (
          SELECT CAST(o_orderdate AS DATE)
                   + unnest(CASE WHEN o_orderkey % 997 = 0 AND o_orderkey % 1009 <> 1 THEN [0, 4] ELSE [0] END) AS day
          FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)
            AND (o_orderkey % 997 = 0 OR o_orderkey % 1009 = 1 OR o_orderkey % 1013 = 2)
        )
        SELECT InvoiceDateKey, count(*) AS sale_lines, CAST(sum(Quantity) AS BIGINT) AS units,
               InvoiceDateKey IN (SELECT CAST(strftime(day, '%Y%m%d') AS INTEGER) FROM corrected) AS rewritten
        FROM fact GROUP BY InvoiceDateKey""",
    "fact_declared_years": f"""WITH {SALES}, {ORDER_DAYS}, {DATE_DIM},
        counted AS (
          SELECT 'fact_sales' AS table_name, partition_year, count(*) AS table_rows FROM fact GROUP BY ALL
          UNION ALL SELECT 'dim_date', partition_year, count(*) FROM date_dim GROUP BY ALL
        )
        SELECT table_name, how, partition_year, table_rows
        FROM counted CROSS JOIN (VALUES ('read'), ('registered')) AS t(how)
        WHERE partition_year BETWEEN 1996 AND 1998""",
    "customer_snapshot": f"""WITH {CUSTOMER} SELECT {_CUSTOMER_COLUMNS},
        DATE '{SNAPSHOT_DAY}' AS snapshot_date FROM customer_src""",
    "employee_reports_snapshot": f"""WITH {EMPLOYEE}
        SELECT *, DATE '{SNAPSHOT_DAY}' AS snapshot_date FROM reports""",
    "date_range": f"WITH {ORDER_DAYS} SELECT day FROM days",
    "date_keys": """SELECT event_id, CAST(strftime(ts, '%Y%m%d') AS INTEGER) AS key_of_timestamp,
        CAST(strftime(CAST(ts AS DATE), '%Y%m%d') AS INTEGER) AS key_of_date FROM events""",
    "calendar_parts": """SELECT o_orderkey,
        CAST(strftime(o_orderdate, '%Y%m%d') AS INTEGER) AS DateKey,
        strftime(o_orderdate, '%Y-%m-%d') AS FullDate,
        CAST(year(o_orderdate) AS INTEGER) AS "Year",
        CAST((month(o_orderdate) - 1) // 3 + 1 AS INTEGER) AS "Quarter",
        CAST(month(o_orderdate) AS INTEGER) AS "Month",
        CAST(day(o_orderdate) AS INTEGER) AS "Day", dayname(o_orderdate) AS DayOfWeek,
        CAST(o_orderdate AS DATE) AS parsed_day FROM orders""",
    "holidays_co": f"""WITH {ORDER_YEARS}, {HOLIDAYS}
        SELECT 'CO' AS country, holiday_date, name FROM holidays""",
    "holidays_by_country": f"""WITH {ORDER_YEARS}, {HOLIDAYS}, {COUNTRY_HOLIDAYS}
        SELECT country, holiday_date, name FROM by_country WHERE year(holiday_date) IN (SELECT y FROM years)""",
    "order_holidays": f"""WITH {ORDER_YEARS}, {HOLIDAYS}
        SELECT o_orderkey, CAST(o_orderdate AS DATE) IN (SELECT holiday_date FROM holidays)
          AS IsHoliday FROM orders""",
    "amount_overflow": """SELECT l_orderkey, l_linenumber,
        TRY_CAST(CAST(l_extendedprice AS DECIMAL(10,2)) * l_partkey AS DECIMAL(10,2)) AS amount
        FROM lineitem""",
    "left_lookup_unmatched": f"""WITH {FACT.replace(
        "{customers}", "(SELECT * FROM customer_src WHERE company <> 'MACHINERY')")}
        SELECT EmployeeKey, count(*) AS sale_lines, CAST(sum(Quantity) AS BIGINT) AS units
        FROM fact GROUP BY EmployeeKey""",
    "track_lookup_unmatched": f"""WITH {GAP_TRACK}
        SELECT Artist, MediaType, count(*) AS tracks FROM track_dim GROUP BY Artist, MediaType""",
    "inner_calendar_gap": _totals(_GAP_STAR, _MONTH, "tracks_sold", "sale_lines", "revenue"),
    "weekday_ranking": _totals(STAR, "DayOfWeek", "tracks_sold", "sale_lines"),
    "top_artist_null_tiebreak": _top_artist("0", "tracks_sold", GAP_STAR),
    "report_tracks_sold_by_day": _totals(STAR, "FullDate", "tracks_sold") + " ORDER BY FullDate",
    "report_top_artist_by_month": _top_artist("Quantity", "tracks_sold") + f" ORDER BY {_MONTH}",
    "report_best_day_of_week": _totals(STAR, "DayOfWeek", "tracks_sold", "sale_lines")
    + " ORDER BY tracks_sold DESC, sale_lines DESC, DayOfWeek LIMIT 1",
    "report_best_sales_month": _totals(STAR, _MONTH, "tracks_sold", revenue="revenue")
    + f" ORDER BY tracks_sold DESC, revenue DESC, {_MONTH} LIMIT 1",
    "view_tracks_sold_by_day": _totals(STAR, "FullDate", "TracksSold"),
    "view_top_artist_by_month": _top_artist("Quantity", "TracksSold"),
    "view_best_day_of_week": _totals(STAR, "DayOfWeek", "TracksSold", "SaleLines"),
    "view_best_sales_month": _totals(STAR, _MONTH, "TracksSold", revenue="Revenue"),
    "fact_partition_roundtrip": f"""WITH {SALES}
        SELECT partition_year, partition_month, partition_day, count(*) AS sale_lines,
               CAST(sum(Quantity) AS BIGINT) AS units,
               CAST(sum(TotalAmount) AS DECIMAL(20,2)) AS revenue
        FROM fact GROUP BY partition_year, partition_month, partition_day""",
    "snapshot_roundtrip": f"""WITH {CUSTOMER}
        SELECT {_CUSTOMER_COLUMNS}, snapshot_date FROM customer_src CROSS JOIN {_TWO_DAYS}""",
    "employee_snapshot_roundtrip": f"""WITH {EMPLOYEE}
        SELECT reports.*, snapshot_date FROM reports CROSS JOIN {_TWO_DAYS}""",
    "history_by_change": f"""WITH {CUSTOMER}
        SELECT customer_id, CASE WHEN customer_id % 97 = k THEN 'moved' ELSE company END AS company, city,
               DATE '2001-01-01' + CAST(k AS INTEGER) AS snapshot_date
        FROM customer_src CROSS JOIN range(10) AS t(k) WHERE customer_id % 89 <> k""",
    "dim_full_refresh": f"WITH {TRACK} SELECT * FROM track_dim",
    "dim_date_overwrite": f"""WITH {ORDER_DAYS}, {DATE_DIM}
        SELECT date_dim.*, count(o_orderkey) AS orders FROM date_dim
        LEFT JOIN orders ON CAST(o_orderdate AS DATE) = CAST(FullDate AS DATE) GROUP BY ALL""",
    "partition_discovery": f"""WITH {SALES}, {EMPLOYEE}, {ORDER_DAYS}
        SELECT 'dim_date' AS table_name, CAST(0 AS BIGINT) AS rows_before, count(*) AS rows_after
        FROM days
        UNION ALL SELECT 'fact_sales', 0, count(*) FROM fact
        UNION ALL SELECT 'customer_history', 0, 2 * count(*) FROM customer_src
        UNION ALL SELECT 'employee_reports_history', 0, 2 * count(*) FROM reports""",
    "registered_table_scan": f"""WITH {SALES}
        SELECT EmployeeKey, partition_year, CAST(sum(Quantity) AS BIGINT) AS units,
               CAST(sum(UnitPrice) AS DECIMAL(20,2)) AS prices
        FROM fact GROUP BY EmployeeKey, partition_year""",
    "mart_refresh": f"""WITH {SALES}, {TRACK}, {EMPLOYEE}, {ORDER_DAYS}, {DATE_DIM}
        SELECT 'dim_date' AS table_name, count(*) AS table_rows,
               CAST(sum(DateKey) AS BIGINT) AS key_sum FROM date_dim
        UNION ALL SELECT 'dim_customer', count(*), CAST(sum(customer_id) AS BIGINT) FROM customer_src
        UNION ALL SELECT 'dim_track', count(*), CAST(sum(TrackKey) AS BIGINT) FROM track_dim
        UNION ALL SELECT 'fact_sales', count(*), CAST(sum(InvoiceDateKey) AS BIGINT) FROM fact
        UNION ALL SELECT 'customer_history', 2 * count(*), CAST(2 * sum(customer_id) AS BIGINT)
          FROM customer_src
        UNION ALL SELECT 'employee_reports_history', 2 * count(*),
          CAST(2 * sum(EmployeeKey) AS BIGINT) FROM reports""",
}
ORACLES |= {f"kept_{name.removeprefix('report_')}": ORACLES[name] for name in list(ORACLES) if name.startswith("report_")}
