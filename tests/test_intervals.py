import random
from datetime import date, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from salesmart.plans.intervals import ChangeHistory, refresh_history_changes
from salesmart.plans.refresh import refresh_history
from salesmart.sources.tables import curated_tables
from tests.test_refresh import base, read, rows  # noqa: F401

DDL = "a int, `b c` string"
FIRST = date(2024, 2, 27)


@pytest.fixture
def history(spark, tmp_path):
    return ChangeHistory(spark, str(tmp_path / "changes"))


def copies(history):
    return sorted(((r.snapshot_date, r.a, r["b c"]) for r in history.copies().collect()), key=str)


@pytest.mark.parametrize("seed", range(1))
def test_full_copies_of_any_days(spark, history, seed):
    """Rows come, go, return and repeat; days are taken again and in any order."""
    rng = random.Random(seed)
    taken = {}
    for _ in range(7):
        day = FIRST + timedelta(rng.randint(0, 5))
        found = [(rng.choice([None, 1, 2, 3]), rng.choice(["x", None, "y"])) for _ in range(rng.randint(0, 6))]
        history.take(spark.createDataFrame(found, DDL), day)
        taken[day] = found
    assert history.days() == sorted(taken)
    assert copies(history) == sorted(((d, *r) for d, found in taken.items() for r in found), key=str)
    for k in range(6):
        day = FIRST + timedelta(k)
        last = max((d for d in taken if d <= day), default=None)
        expected = [] if last is None else taken[last]
        assert sorted(map(str, map(tuple, history.as_of(day).collect()))) == sorted(map(str, expected))


def test_equal_days_store_nearly_nothing(spark, history):
    frame = spark.range(20_000).select(F.col("id").cast("int").alias("a"), F.sha2(F.col("id").cast("string"), 256).alias("b c"))
    sizes = []
    for k in range(4):
        history.take(frame.withColumn("a", F.when((F.col("a") == 5) & (F.lit(k) == 3), -1).otherwise(F.col("a"))), FIRST + timedelta(k))
        stored = sum(p.stat().st_size for p in Path(history.path).rglob("*.parquet"))
        sizes.append(stored - sum(sizes))
    assert sizes[1] < sizes[0] / 100 and sizes[3] < sizes[0] / 100
    runs = history.intervals().groupBy("valid_from", "valid_to").count().collect()
    fourth = FIRST + timedelta(3)
    assert {(r.valid_from, r.valid_to): r["count"] for r in runs} == {
        (FIRST, None): 19_999, (FIRST, fourth): 1, (fourth, None): 1
    }
    assert history.copies().count() == 80_000


def test_further_columns(spark, history):
    history.take(spark.createDataFrame([(1, "x"), (2, "y")], DDL), FIRST)
    history.take(spark.createDataFrame([(1, "x", None), (2, "y", "vip")], DDL + ", tier string"), FIRST + timedelta(1))
    assert history.intervals().count() == 3  # a null in a new column is no change
    tiers = {(r.snapshot_date, r.a): r.tier for r in history.copies().collect()}
    assert tiers == {(FIRST, 1): None, (FIRST, 2): None, (FIRST + timedelta(1), 1): None, (FIRST + timedelta(1), 2): "vip"}


def test_the_same_history_as_full_copies(spark, read, base):  # noqa: F811
    def on(k):
        def table(name):
            frame = read(name)
            return frame.withColumn("last_name", F.expr(f"IF({frame.columns[0]} % 3 = {k % 3}, 'new', last_name)")).limit(4 - k % 2)

        return table

    for k in range(4):
        refresh_history(on(k), base, FIRST + timedelta(k))
        refresh_history_changes(on(k), base, FIRST + timedelta(k))
    for name in ("customer_history", "employee_reports_history"):
        full = curated_tables(spark, base)(name)
        kept = ChangeHistory(spark, f"{base}/{name}_changes").copies().select(*full.columns)
        assert rows(kept) == rows(full)
        assert full.count() > 5


def test_nothing_taken(history):
    assert history.days() == []
    with pytest.raises(ValueError, match="no day"):
        history.copies()
