"""Time the headline queries; prints one JSON line.

``BENCH_SF_DIR`` names the data folder and ``BENCH_CPUS`` the local cores. Every query runs to
completion into the ``noop`` sink: once to warm the JVM, then ``BENCH_RUNS`` times, of which the
fastest counts. The refresh steps, which write Parquet, run once and are not part of the sum; nor are
the reports and views over the mart they wrote (``stored``).
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from salesmart.catalog.tables import discover_partitions, register_tables  # noqa: E402
from salesmart.catalog.views import VIEWS, register_views  # noqa: E402
from salesmart.plans.refresh import (  # noqa: E402
    refresh_calendar,
    refresh_dimensions,
    refresh_facts,
    refresh_history,
)
from salesmart.plans.reports import REPORTS, Star  # noqa: E402
from salesmart.session import local_session  # noqa: E402
from salesmart.sinks.scratch import scratch_path  # noqa: E402
from salesmart.sources.tables import curated_tables  # noqa: E402
from workload.queries import QUERIES  # noqa: E402
from workload.sample import SNAPSHOT_DAY, order_days, sample_tables  # noqa: E402

HEADLINE = [
    "fact_sales",
    "dim_customer",
    "dim_track",
    "dim_date",
    "customer_snapshot",
    "employee_reports_snapshot",
    "order_holidays",
    "report_tracks_sold_by_day",
    "report_top_artist_by_month",
    "report_best_day_of_week",
    "report_best_sales_month",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = local_session(cpus)
    timings: dict[str, float] = {}
    for name in HEADLINE:
        best = float("inf")
        for run in range(runs + 1):
            started = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            if run:
                best = min(best, time.perf_counter() - started)
        timings[name] = round(best, 3)
    base, read = scratch_path(spark, "bench"), sample_tables(spark, sf_dir)
    steps = {
        "dimensions": lambda: refresh_dimensions(read, base),
        "facts": lambda: refresh_facts(read, base),
        "facts_one_month": lambda: refresh_facts(read, base, "2000-01-01", "2000-01-31"),
        "history": lambda: refresh_history(read, base, SNAPSHOT_DAY),
    }
    refresh: dict[str, float] = {}
    for name, step in steps.items():
        started = time.perf_counter()
        step()
        refresh[name] = round(time.perf_counter() - started, 3)
    # The reports over the stored tables, as the reference's reports read them, and the views.
    refresh_calendar(spark, base, *order_days(spark, sf_dir))
    table = curated_tables(spark, base)
    star = Star(table("fact_sales"), table("dim_date"), table("dim_track"))
    database = "salesmart_bench"
    spark.sql(f"DROP DATABASE IF EXISTS {database} CASCADE")
    register_tables(spark, database, base)
    discover_partitions(spark, database)
    register_views(spark, database)
    frames = {f"report_{name}": lambda f=report: f(star) for name, report in REPORTS.items()}
    frames |= {f"view_{v.removeprefix('v_')}": lambda v=v: spark.table(f"{database}.{v}") for v in VIEWS}
    stored: dict[str, float] = {}
    for name, frame in frames.items():
        best = float("inf")
        for run in range(runs + 1):
            started = time.perf_counter()
            frame().write.format("noop").mode("overwrite").save()
            if run:
                best = min(best, time.perf_counter() - started)
        stored[name] = round(best, 3)
    spark.sql(f"DROP DATABASE {database} CASCADE")
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "sum of headline query times",
                "value": round(sum(timings.values()), 3),
                "unit": "sec",
                "queries": timings,
                "refresh": refresh,
                "stored": stored,
                "sf": Path(sf_dir).name.removeprefix("sf"),
                "cpus": cpus,
            }
        )
    )


if __name__ == "__main__":
    main()
