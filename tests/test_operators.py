import pytest
from pyspark.sql import functions as F

from salesmart.functions.values import full_name
from salesmart.operators.calendar import flag_holidays
from salesmart.operators.lookups import bounded_broadcast, hot_keys, lookup_chain, salted_join
from salesmart.operators.mapping import apply_mapping
from salesmart.operators.topk import top_k, top_k_per_group
from salesmart.plans.dimensions import dim_customer, dim_track


def test_mapping_renames_casts_and_prunes(spark):
    frame = spark.createDataFrame([("7", "a", 1.5)], "id string, name string, rest double")
    mapped = apply_mapping(
        frame, [("id", "string", "Key", "int"), ("name", "string", "Name", "string")]
    )
    assert mapped.dtypes == [("Key", "int"), ("Name", "string")]
    assert tuple(mapped.first()) == (7, "a")


def test_dim_customer_keeps_eight_columns(spark):
    source = spark.createDataFrame(
        [(1, "Ada", "L", None, "CO", "Cali", None, "a@x", "street")],
        "customer_id long, first_name string, last_name string, company string, country string, "
        "city string, state string, email string, address string",
    )
    assert [tuple(r) for r in dim_customer(source).collect()] == [
        (1, "Ada", "L", None, "CO", "Cali", None, "a@x")
    ]


def test_dim_track_keeps_tracks_without_matches(spark):
    tracks = dim_track(
        spark.createDataFrame(
            [
                (1, "a", 10, 1, 1, "c", 5),
                (2, "b", None, None, None, None, None),
                (3, "d", 99, 9, 9, None, 6),
                (4, "e", 11, 1, 1, None, 7),
            ],
            "track_id int, name string, album_id int, genre_id int, media_type_id int, "
            "composer string, milliseconds int",
        ),
        spark.createDataFrame(
            [(10, "Al", 5), (11, "Am", 6)], "album_id int, title string, artist_id int"
        ),
        spark.createDataFrame([(5, "Ar")], "artist_id int, name string"),
        spark.createDataFrame([(1, "Ge")], "genre_id int, name string"),
        spark.createDataFrame([(1, "Me")], "media_type_id int, name string"),
    )
    assert [tuple(r) for r in tracks.orderBy("TrackKey").collect()] == [
        (1, "a", "Al", "Ar", "Ge", "Me", "c", 5),
        (2, "b", None, None, None, None, None, None),
        (3, "d", None, None, None, None, None, 6),
        (4, "e", "Am", None, "Ge", "Me", None, 7),
    ]


def test_lookup_chain_splits_a_hot_key(spark, conf, plan):
    """A third of all rows under one key and a third under null, in a shuffled join."""
    conf(
        spark__sql__autoBroadcastJoinThreshold="-1",
        spark__sql__adaptive__autoBroadcastJoinThreshold="-1",
        spark__sql__adaptive__skewJoin__skewedPartitionThresholdInBytes="10KB",
        spark__sql__adaptive__skewJoin__skewedPartitionFactor="2",
        spark__sql__adaptive__advisoryPartitionSizeInBytes="10KB",
        spark__sql__adaptive__coalescePartitions__minPartitionSize="1KB",
    )
    rows = spark.range(60_000, numPartitions=8).select(
        "id",
        F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 3 == 2, F.col("id")).alias("key"),
    )
    lookup = spark.range(60_000).select(
        F.col("id").alias("key"), (F.col("id") * 2).alias("value")
    )
    joined = lookup_chain(rows, [(lookup, "key")])
    found = joined.collect()
    assert "skew=true" in plan(joined)
    assert sorted((r.id, r.key, r.value) for r in found if r.id % 3 != 1) == [
        (i, 7 if i % 3 == 0 else i, 14 if i % 3 == 0 else 2 * i) for i in range(60_000) if i % 3 != 1
    ]
    assert sum(r.key is None and r.value is None for r in found) == 20_000


def test_broadcast_only_below_the_bound(spark, conf, plan):
    conf(spark__sql__autoBroadcastJoinThreshold="-1")
    left = spark.range(100).withColumnRenamed("id", "k")
    right = spark.range(50).withColumnRenamed("id", "k")
    assert "BroadcastHashJoin" in plan(left.join(bounded_broadcast(right, 50), "k"))
    beyond = left.join(bounded_broadcast(right, 49), "k")
    assert "SortMergeJoin" in plan(beyond)
    assert beyond.count() == 50


def test_a_hot_key_is_dealt_evenly_under_default_settings(spark, conf, plan):
    """A third of the rows under one key, a third under null, in a join too large to broadcast."""
    conf(
        spark__sql__autoBroadcastJoinThreshold="-1",
        spark__sql__adaptive__autoBroadcastJoinThreshold="-1",
        # These rows would fit in one task; keep all of them to see how they are dealt.
        spark__sql__adaptive__coalescePartitions__enabled="false",
    )
    n = 600_000
    rows = spark.range(n, numPartitions=8).select(
        "id",
        F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 3 == 2, F.col("id")).alias("key"),
    )
    lookup = spark.range(n).select(F.col("id").alias("key"), (F.col("id") * 2).alias("value"))
    joined = salted_join(rows, lookup, "key", "left")
    assert "xxhash64" in plan(joined)
    per_task = joined.where("key IS NOT NULL").groupBy(F.spark_partition_id()).count().collect()
    assert max(r["count"] for r in per_task) <= 2 * (2 * n / 3) / 8
    totals = joined.agg(F.count("*"), F.countDistinct("id"), F.sum("value")).first()
    assert totals[:] == (n, n, sum(14 if i % 3 == 0 else 2 * i for i in range(n) if i % 3 != 1))
    inner = salted_join(rows, lookup, "key")
    assert inner.count() == n - n // 3
    assert hot_keys(rows, "key").keys() == {7}
    assert hot_keys(lookup, "key") == {}


def test_lookups_are_broadcast_when_the_planner_cannot_know_their_size(spark, conf, plan, tmp_path):
    conf(spark__sql__autoBroadcastJoinThreshold="2KB", spark__sql__adaptive__autoBroadcastJoinThreshold="2KB")
    spark.range(20_000).selectExpr("id AS k", "id % 5 AS kind", "CAST('2024-01-01' AS DATE) AS day").write.parquet(
        str(tmp_path / "t")
    )
    frame = spark.read.parquet(str(tmp_path / "t"))
    kinds = frame.select("kind").distinct().withColumn("name", F.concat(F.lit("n"), "kind"))
    joined = lookup_chain(frame, [(kinds, "kind")])
    flagged = flag_holidays(frame, "day", frame.select(F.col("day").alias("holiday_date")).distinct())
    for result in (joined, flagged):
        assert result.count() == 20_000
        assert "BroadcastHashJoin" in plan(result)
        assert "SortMergeJoin" not in plan(result)


def test_wide_rows_are_not_broadcast(spark):
    frame = spark.range(1000).withColumn("text", F.repeat(F.lit("x"), 100_000))
    assert bounded_broadcast(frame) is frame
    assert bounded_broadcast(frame.limit(10)) is not frame


def test_top_k_per_group(spark, plan):
    frame = spark.createDataFrame(
        [(1, "b", 5), (1, "a", 5), (1, None, 5), (1, "c", 4), (2, None, 1)],
        "g int, name string, n int",
    )
    order = [F.desc("n"), F.asc_nulls_last("name")]
    first = top_k_per_group(frame, ["g"], order)
    assert sorted((r.g, r.name) for r in first.collect()) == [(1, "a"), (2, None)]
    three = top_k_per_group(frame, ["g"], order, 3)
    assert [r.name for r in three.filter("g = 1").orderBy(*order).collect()] == ["a", "b", None]
    assert plan(first).count("WindowGroupLimit") >= 2


def test_top_k_needs_no_global_sort(spark, plan):
    frame = top_k(spark.range(1000), [F.desc("id")], 2)
    assert [r.id for r in frame.collect()] == [999, 998]
    assert "TakeOrderedAndProject" in plan(frame)


def test_full_name_skips_nulls(spark):
    frame = spark.createDataFrame(
        [("a", "b"), ("a", None), (None, None)], "f string, l string"
    ).select(full_name("f", "l").alias("n"))
    assert [r.n for r in frame.collect()] == ["a b", "a", ""]


def test_identical_rows_of_a_hot_key_are_split(spark, conf, tmp_path):
    """A third of all rows are alike in all columns; in a file each has a place of its own."""
    conf(
        spark__sql__autoBroadcastJoinThreshold="-1",
        spark__sql__adaptive__autoBroadcastJoinThreshold="-1",
        spark__sql__adaptive__coalescePartitions__enabled="false",
    )
    n = 600_000
    path = str(tmp_path / "rows")
    made = spark.range(n, numPartitions=2).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("key"))
    made.write.parquet(path)
    lookup = spark.range(n).select(F.col("id").alias("key"), (F.col("id") * 2).alias("value"))
    for rows in (spark.read.parquet(path), spark.read.parquet(path).where("key >= 0").select("key")):
        joined = salted_join(rows, lookup, "key", "left")
        assert joined.columns == ["key", "value"]
        per_task = joined.groupBy(F.spark_partition_id()).count().collect()
        assert max(r["count"] for r in per_task) <= 2 * n / 8
        total = sum(14 if i % 3 == 0 else 2 * i for i in range(n))
        assert joined.agg(F.count("*"), F.sum("value")).first()[:] == (n, total)


def test_the_plan_does_not_grow_with_hot_keys(spark, conf, plan):
    conf(
        spark__sql__autoBroadcastJoinThreshold="-1",
        spark__sql__adaptive__autoBroadcastJoinThreshold="-1",
        spark__sql__shuffle__partitions="200",
    )
    lookup = spark.range(1000).select(F.col("id").alias("key"), (F.col("id") * 2).alias("value"))
    sizes = {}
    for keys in (3, 60):
        rows = spark.range(200_000, numPartitions=8).select("id", (F.col("id") % keys).alias("key"))
        hot = hot_keys(rows, "key", 1000)
        assert hot.keys() == set(range(keys))
        joined = salted_join(rows, lookup, "key", min_rows=1000)
        sizes[keys] = len(plan(joined))
        assert joined.agg(F.sum("value")).first()[0] == sum(2 * (i % keys) for i in range(200_000))
    assert abs(sizes[60] - sizes[3]) < 200


def test_hot_keys_are_looked_for_once(spark, monkeypatch):
    rows = spark.range(1000).select((F.col("id") % 2 * 5).alias("key"))
    found = hot_keys(rows, "key", 10)
    assert found.keys() == {0, 5}
    monkeypatch.setattr(type(rows), "agg", lambda *_: 1 / 0)
    assert hot_keys(spark.range(1000).select((F.col("id") % 2 * 5).alias("key")), "key", 10) == found
    with pytest.raises(ZeroDivisionError):
        hot_keys(rows, "key", 11)
