"""Loads that are seen as a whole or not at all, changed days, kept sums and declared years."""

import random
import threading
import uuid
from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from salesmart.catalog.tables import discover_partitions, register_tables
from salesmart.plans.changes import changed_parts, day_digests
from salesmart.plans.kept import refresh_sums
from salesmart.plans.refresh import (
    clean_tables,
    refresh_calendar,
    refresh_changed_facts,
    refresh_dimensions,
    refresh_facts,
    refresh_history,
)
from salesmart.plans.reports import REPORTS, Star
from salesmart.schemas import DATE_PARTITIONS, TABLES
from salesmart.sinks import manifest
from salesmart.sinks.manifest import LoadConflict, PartitionLog, Scope, State
from salesmart.sources.tables import curated_tables
from tests.test_refresh import SOURCES, base, files, read, rows  # noqa: F401

SCHEMA = "n int, partition_year int, partition_month int, partition_day int"


@pytest.fixture
def log(spark, tmp_path):
    return PartitionLog(spark, str(tmp_path / "table"), DATE_PARTITIONS)


def days(spark, *found):
    """Rows (n, day) as a frame."""
    return spark.createDataFrame([(n, d.year, d.month, d.day) if d else (n, None, None, None) for n, d in found], SCHEMA)


def load(log, scope, *found, state=None):
    return log.publish(log.state() if state is None else state, scope, log.write(days(log.spark, *found)))


def shown(log, **options):
    schema = days(log.spark).schema
    return sorted(((r.n, r.partition_month, r.partition_day) for r in log.read(schema, **options).collect()), key=str)


def on(month, day):
    return date(2024, month, day)


def test_readers_see_a_load_as_a_whole(spark, log):
    load(log, Scope(), (1, on(1, 1)), (2, on(1, 2)), (3, on(2, 1)))
    before = log.read(days(spark).schema)
    written = log.write(days(spark, (10, on(1, 1)), (30, on(1, 3))))
    assert shown(log) == [(1, 1, 1), (2, 1, 2), (3, 2, 1)]  # written, not published
    log.publish(log.state(), Scope(on(1, 1), on(1, 31)), written)
    assert shown(log) == [(10, 1, 1), (3, 2, 1), (30, 1, 3)]
    assert sorted(r.n for r in before.collect()) == [1, 2, 3]  # a reader that began before
    assert shown(log, state=log.state(1)) == [(1, 1, 1), (2, 1, 2), (3, 2, 1)]


def test_a_lost_load_changes_nothing_and_is_cleaned(spark, log):
    load(log, Scope(), (1, on(1, 1)), (2, None))
    broken = days(spark, (5, on(1, 1))).withColumn("n", F.expr("CAST(raise_error('lost') AS INT)"))
    with pytest.raises(Exception, match="lost"):
        log.write(broken)
    log.write(days(spark, (7, on(1, 1))))
    assert shown(log) == [(1, 1, 1), (2, None, None)]
    assert log.clean() == []  # perhaps still being written
    assert len(log.clean(grace=0)) >= 1
    assert shown(log) == [(1, 1, 1), (2, None, None)]


def test_two_writers_of_the_same_days(spark, log):
    load(log, Scope(), (1, on(1, 1)), (2, on(2, 1)))
    seen = log.state()
    load(log, Scope(on(1, 1), on(1, 31)), (3, on(1, 5)))
    with pytest.raises(LoadConflict):
        load(log, Scope(on(1, 1), on(1, 1)), (4, on(1, 1)), state=seen)
    assert shown(log) == [(2, 2, 1), (3, 1, 5)]
    # A day that the other load found empty is in its scope too.
    with pytest.raises(LoadConflict):
        load(log, Scope(parts=frozenset([part(on(1, 9))])), (4, on(1, 9)), state=seen)
    load(log, Scope(parts=frozenset([part(on(2, 1))])), (5, on(2, 1)), state=seen)
    assert shown(log) == [(3, 1, 5), (5, 2, 1)]
    with pytest.raises(ValueError, match="not to replace"):
        load(log, Scope(on(3, 1), on(3, 31)), (5, on(2, 1)))


def part(day):
    return f"partition_year={day.year}/partition_month={day.month}/partition_day={day.day}"


def test_a_file_is_renamed_only_to_a_free_name(log, monkeypatch):
    """As on file systems whose rename does not replace."""
    monkeypatch.setattr(manifest, "LINKED", ())
    assert log._create("1.json", '"first"')
    monkeypatch.setattr(log, "_names", lambda: [])  # the other file came after the look
    assert not log._create("1.json", '"second"')
    assert log._read("1.json") == "first"


def test_a_number_is_given_once(log):
    made = []
    names = [f"{7:020d}.json"] * 8
    threads = [threading.Thread(target=lambda n=n, k=k: made.append(log._create(n, f'"{k}"'))) for k, n in enumerate(names)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(made) == [False] * 7 + [True]
    assert log._names() == names[:1]
    assert log._read(names[0]) in map(str, range(8))


@pytest.mark.parametrize("seed", range(3))
def test_states_follow_any_loads(seed, monkeypatch):
    """Against a plain dictionary; whole states now and then change nothing."""
    rng = random.Random(seed)
    state, model, entries = State(), {}, []
    every = [part(date(y, m, d)) for y in (2023, 2024) for m in (1, 2) for d in range(1, 6)]
    for version in range(1, 60):
        parts = sorted(rng.sample(every, rng.randint(0, 6)))
        gone = sorted(set(rng.sample(every, 3)) & set(model) - set(parts))
        entry = {"version": version, "load": f"l{version}", "removed": gone, "parts": parts, "notes": {p: str(version) for p in parts[:2]}}
        if version % 7 == 0:
            entry["whole"] = {"holder": dict(state.holder), "written": dict(state.written), "notes": dict(state.notes)}
        entries.append(entry)
        state.apply(entry)
        for p in gone:
            del model[p]
        model |= dict.fromkeys(parts, f"l{version}")
        assert state.holder == model
        late = State()
        for e in entries[max((i for i, e in enumerate(entries) if "whole" in e), default=0) :]:
            late.apply(e)
        assert late == state
        wanted = {p for p in model if rng.random() < 0.7}
        found = state.folders(wanted.__contains__)
        held = {f"load={load}/{p}" for p, load in model.items()}
        reached = {h for h in {f"load={x}/{p}" for x, ps in state.written.items() for p in ps} if any((h + "/").startswith(f + "/") for f in found)}
        assert reached == {f"load={model[p]}/{p}" for p in wanted} <= held


def test_few_folders_are_listed(spark, log):
    load(log, Scope(), *((d, on(m, d)) for m in (1, 2, 3) for d in range(1, 9)))
    assert len(log.state().folders()) == 1
    load(log, Scope(on(2, 3), on(2, 4)), (0, on(2, 3)))
    folders = log.state().folders()
    assert len(folders) == 1 + 2 + 6  # the reload, two whole months, the other days of the third
    assert len(log.state().folders(lambda p: "month=2" in p)) == 7
    assert len(shown(log, keep=lambda p: "month=3" in p)) == 8


def test_cleaning_keeps_former_versions(spark, log):
    for n in range(5):
        load(log, Scope(on(1, n % 2 + 1), on(1, n % 2 + 1)), (n, on(1, n % 2 + 1)))
    assert shown(log) == [(3, 1, 2), (4, 1, 1)]
    log.clean(versions=2, grace=0)
    assert shown(log, state=log.state(4)) == [(2, 1, 1), (3, 1, 2)]
    log.clean(versions=1, grace=0)
    assert shown(log) == [(3, 1, 2), (4, 1, 1)]


def test_the_whole_state_is_written_now_and_then(spark, log, monkeypatch):
    monkeypatch.setattr(manifest, "WHOLE_EVERY", 3)
    for n in range(7):
        load(log, Scope(on(1, n + 1), on(1, n + 1)), (n, on(1, n + 1)))
    assert [n.endswith(".whole") for n in log._names()] == [False, False, True] * 2 + [False]
    assert len(shown(log)) == 7
    assert len(shown(log, state=log.state(5))) == 5


def test_digests_do_not_see_order_but_all_else(spark):
    def digest(found):
        return [tuple(r) for r in day_digests(days(spark, *found), DATE_PARTITIONS).collect()]

    one = [(1, on(1, 1)), (2, on(1, 1)), (2, on(1, 1))]
    assert digest(one) == digest(one[::-1])
    for other in ([*one, (2, on(1, 1))], one[:2], [(1, on(1, 1)), (1, on(1, 1)), (2, on(1, 1))], [(None, on(1, 1)), *one[1:]]):
        assert digest(one)[0][1] != digest(other)[0][1]
    old = day_digests(days(spark, (1, on(1, 1)), (1, on(1, 2)), (1, None)), DATE_PARTITIONS)
    new = day_digests(days(spark, (1, on(1, 1)), (2, on(1, 3)), (3, None)), DATE_PARTITIONS)
    changed, digests = changed_parts(old, new)
    undated = "/".join(f"{c}={manifest.NULL_PARTITION}" for c in DATE_PARTITIONS)
    assert set(changed) == {part(on(1, 2)), part(on(1, 3)), undated}
    assert len(digests) == 3
    wide = spark.createDataFrame([(None, 1, 2024, 1, 1)], "x int, y int, partition_year int, partition_month int, partition_day int")
    moved = wide.select(F.col("y").alias("x"), F.col("x").alias("y"), *DATE_PARTITIONS)
    assert day_digests(wide, DATE_PARTITIONS).first() != day_digests(moved, DATE_PARTITIONS).first()


def altered(read):  # noqa: F811
    """Invoice 3 on another day, 4 withdrawn, 5 without a date, 6 with another quantity."""

    def table(name):
        frame = read(name)
        if name == "invoice":
            day = F.expr("CASE invoice_id WHEN 3 THEN TIMESTAMP'2024-01-28 01:00:00' WHEN 5 THEN NULL ELSE invoice_date END")
            return frame.where("invoice_id <> 4").withColumn("invoice_date", day)
        if name == "invoice_line":
            return frame.withColumn("quantity", F.expr("IF(invoice_id = 6, 9, quantity)"))
        return frame

    return table


def test_only_changed_days_are_rewritten(spark, read, base, tmp_path):  # noqa: F811
    refresh_facts(read, base)
    assert refresh_changed_facts(read, base) == []
    log = PartitionLog(spark, f"{base}/fact_sales", DATE_PARTITIONS)
    kept = log.state()
    assert len(kept.notes) == 10  # digests of the stored days, for the next time
    rewritten = refresh_changed_facts(altered(read), base)
    was = {i: d.date() for i, _, d in SOURCES["invoice"][1]}
    undated = "/".join(f"{c}={manifest.NULL_PARTITION}" for c in DATE_PARTITIONS)
    assert set(rewritten) == {part(was[k]) for k in (3, 4, 5, 6)} | {part(on(1, 28)), undated}
    now = log.state()
    assert {p: h for p, h in now.holder.items() if p not in rewritten} == {p: h for p, h in kept.holder.items() if p not in rewritten}
    refresh_facts(altered(read), str(tmp_path / "full"))
    whole = rows(curated_tables(spark, str(tmp_path / "full"))("fact_sales"))
    assert rows(curated_tables(spark, base)("fact_sales")) == whole
    assert refresh_changed_facts(altered(read), base) == []
    assert len(refresh_changed_facts(read, base)) == len(rewritten)
    assert refresh_changed_facts(read, base) == []
    assert curated_tables(spark, base)("fact_sales").count() == 40


def test_a_load_counts_what_it_loses(spark, read, base, plan):  # noqa: F811
    """Lines without an invoice or day, off the calendar, and amounts that do not fit, in the pass that writes."""

    def broken(name):
        frame = read(name)
        if name == "invoice":
            day = F.expr("CASE invoice_id WHEN 5 THEN NULL WHEN 6 THEN TIMESTAMP'2031-01-01 00:00:00' ELSE invoice_date END")
            return frame.where("invoice_id <> 4").withColumn("invoice_date", day)
        if name == "invoice_line":
            price = F.expr("CAST(IF(invoice_id = 7 AND track_id % 2 = 0, 99999999.99, unit_price) AS DECIMAL(10,2))")
            return frame.withColumn("unit_price", price).withColumn("quantity", F.expr("IF(invoice_id = 7, 2, quantity)"))
        return frame

    told = {"lines": 40, "lines_without_invoice": 2, "lines_without_day": 2}
    refresh_facts(read, base)
    assert refresh_facts(broken, base, strict=False) == told | {"amounts_out_of_range": 1}
    assert curated_tables(spark, base)("fact_sales").count() == 38
    refresh_calendar(spark, base, "2024-01-01", "2024-02-04")
    told |= {"lines_off_the_calendar": 2 + sum(2 for i, _, d in SOURCES["invoice"][1] if i != 4 and d.date() > on(2, 4))}
    assert refresh_facts(broken, base, strict=False) == told | {"amounts_out_of_range": 1}
    some = refresh_facts(read, base, "2024-02-05", "2024-02-05")
    assert some["lines_without_invoice"] == 0 and some["lines_off_the_calendar"] == some["lines"] == 4
    with pytest.raises(Exception, match="NUMERIC_VALUE_OUT_OF_RANGE"):
        refresh_facts(broken, base)
    assert refresh_facts(lambda n: read(n).limit(0), base)["lines"] == 0


def test_changed_days_within_bounds(spark, read, base):  # noqa: F811
    refresh_facts(read, base)
    assert refresh_changed_facts(altered(read), base, "2024-01-27", "2024-01-29") == sorted(
        [part(on(1, 28)), "/".join(f"{c}={manifest.NULL_PARTITION}" for c in DATE_PARTITIONS)]
    )
    assert refresh_changed_facts(altered(read), base, "2024-01-27", "2024-01-29") == []


@pytest.mark.parametrize("seed", range(1))
def test_reports_of_kept_sums_after_any_loads(spark, read, base, seed):  # noqa: F811
    rng = random.Random(seed)
    refresh_dimensions(read, base)
    refresh_calendar(spark, base, "2024-01-01", "2024-02-28")
    loads = [
        lambda source: refresh_facts(source, base),
        lambda source: refresh_facts(source, base, "2024-02-02", "2024-02-04"),
        lambda source: refresh_changed_facts(source, base),
    ]
    refresh_facts(read, base)
    assert len(refresh_sums(spark, base)) == 2
    for _ in range(3):
        for _ in range(rng.randint(0, 2)):
            rng.choice(loads)(rng.choice([read, altered(read)]))
        refresh_sums(spark, base)
        assert refresh_sums(spark, base) == []
        tables = curated_tables(spark, base)
        star = Star(tables("fact_sales"), tables("dim_date"), tables("dim_track"))
        kept = Star(None, star.dim_date, star.dim_track, tables("track_day_sums"))
        for name, report in REPORTS.items():
            assert rows(report(kept)) == rows(report(star)), name
            assert not any("fact_sales" in f for f in report(kept).inputFiles())


def test_one_changed_month_is_summed(spark, read, base):  # noqa: F811
    refresh_facts(read, base)
    refresh_sums(spark, base)
    refresh_facts(altered(read), base, "2024-02-02", "2024-02-02")
    undated = f"partition_year={manifest.NULL_PARTITION}/partition_month={manifest.NULL_PARTITION}"
    assert refresh_sums(spark, base) == ["partition_year=2024/partition_month=2", undated]
    refresh_facts(lambda n: read(n).limit(0) if n == "invoice" else read(n), base)
    assert len(refresh_sums(spark, base)) == 3
    assert curated_tables(spark, base)("track_day_sums").count() == 0
    assert clean_tables(spark, base) is not None


@pytest.fixture
def database(spark, read, base):  # noqa: F811
    refresh_facts(read, base)
    refresh_calendar(spark, base, "2023-12-30", "2025-01-02")
    refresh_history(read, base, "2024-03-01")
    refresh_dimensions(read, base)
    name = f"mart_{uuid.uuid4().hex}"
    register_tables(spark, name, base)
    yield name
    spark.sql(f"DROP DATABASE {name} CASCADE")


def test_partitions_follow_the_log(spark, database, read, base, monkeypatch):  # noqa: F811
    """What the catalog shows after each load is what the log holds, by one statement for what changed."""
    said = []
    sql = type(spark).sql
    monkeypatch.setattr(type(spark), "sql", lambda self, q, *a, **k: said.append(q) or sql(self, q, *a, **k))

    def found():
        said.clear()
        discover_partitions(spark, database)
        assert not any("MSCK" in q for q in said)
        return [q.split(" PARTITION")[0].split()[-3:] for q in said if "ALTER TABLE" in q and "PROPERTIES" not in q]

    assert len(found()) == 4  # one for each partitioned table
    fact = spark.table(f"{database}.fact_sales")
    assert fact.count() == 40
    assert found() == []
    refresh_facts(altered(read), base, "2024-01-01", "2024-01-31")
    assert len(found()) == 2  # some days dropped, some added
    stored = curated_tables(spark, base)("fact_sales")
    assert rows(spark.table(f"{database}.fact_sales")) == rows(stored)
    assert spark.table(f"{database}.fact_sales").where("partition_day IS NULL").count() == 2
    assert spark.sql(f"SHOW PARTITIONS {database}.fact_sales").count() == len(
        PartitionLog(spark, f"{base}/fact_sales", DATE_PARTITIONS).state().holder
    )


def test_declared_years_are_all_there_is(spark, database, read, base):  # noqa: F811
    def later(name):
        frame = read(name)
        if name != "invoice":
            return frame
        return frame.withColumn("invoice_date", F.expr("IF(invoice_id < 5, invoice_date + INTERVAL 1 YEAR, invoice_date)"))

    refresh_facts(later, base)
    for years, n in (((2024, 2024), 30), ((2025, 2030), 10), ((2009, 2023), 0), (None, 40)):
        discover_partitions(spark, database, years)
        assert spark.table(f"{database}.fact_sales").count() == n
        frame = curated_tables(spark, base, years)("fact_sales")
        assert frame.count() == n
        listed = {f.split("partition_year=")[1][:4] for f in frame.inputFiles()}
        assert all(years is None or years[0] <= int(y) <= years[1] for y in listed)
    discover_partitions(spark, database, (2024, 2024))
    assert spark.table(f"{database}.dim_date").count() == 366
    assert spark.table(f"{database}.customer_history").count() == 4


def test_sums_of_a_null_track_and_day(spark):
    data = [(1, None, None, 1, 2, Decimal("1.00"), Decimal("2.00"), None, None, None)] * 2
    sales = spark.createDataFrame(data, TABLES["fact_sales"].schema)
    from salesmart.plans.kept import track_day_sums

    row = track_day_sums(sales).first()
    assert (row.units, row.lines, row.amount, row.TrackKey) == (4, 2, Decimal("4.00"), None)
