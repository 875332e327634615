"""Lookup joins: checked broadcasts, and shuffled joins whose hot keys are salted."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterable
from math import ceil

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_BROADCAST_ROWS = 100_000
MAX_BROADCAST_BYTES = 32 << 20
#: Lookups are wider than a calendar, so fewer rows of them are broadcast.
MAX_LOOKUP_ROWS = 50_000
#: A key with fewer rows is never salted.
MIN_HOT_ROWS = 100_000
#: Keys that the sketch of frequent keys follows; it finds each key with a larger share of rows.
TRACKED_KEYS = 10_000


def lookup_chain(frame: DataFrame, lookups: Iterable[tuple[DataFrame, str]]) -> DataFrame:
    """Left-join each ``(lookup, key)`` in turn; rows without a match keep nulls.

    A lookup that the planner knows to be small, or that is measured to be, is broadcast, so ``frame``
    is not shuffled on keys of which there may be few. Any other is joined by ``salted_join``. A lookup with
    a repeated key multiplies rows, as in any join.
    """
    for lookup, key in lookups:
        if planner_broadcasts(lookup):
            frame = frame.join(lookup, key, "left")
            continue
        hinted = bounded_broadcast(lookup, MAX_LOOKUP_ROWS)
        if hinted is not lookup:
            frame = frame.join(hinted, key, "left")
        else:
            frame = salted_join(frame, lookup, key, "left")
    return frame


def planner_broadcasts(frame: DataFrame) -> bool:
    """Whether the planner's own estimate is below its threshold, so that it needs no hint."""
    limit = frame.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    size = frame._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return int(str(size)) <= int(limit)


def row_bytes(frame: DataFrame) -> Column:
    """About the bytes of a row: the length of strings and binaries, 8 for any other value."""
    size = F.lit(0)
    for field in frame.schema:
        varies = isinstance(field.dataType, (T.StringType, T.BinaryType))
        name = F.col("`" + field.name.replace("`", "``") + "`")
        size = size + (F.coalesce(F.octet_length(name), F.lit(0)) + 16 if varies else F.lit(8))
    return size


def bounded_broadcast(
    frame: DataFrame, max_rows: int = MAX_BROADCAST_ROWS, max_bytes: int = MAX_BROADCAST_BYTES
) -> DataFrame:
    """Broadcast ``frame`` if it is measured to be within both bounds, else return it unhinted.

    The measurement is a distributed sum. The planner cannot know the size of a frame that is derived
    by a distinct or read from a database; beyond the bounds it is free to choose a shuffled join.
    """
    rows, size = frame.agg(F.count(F.lit(1)), F.sum(row_bytes(frame))).first()
    return F.broadcast(frame) if rows <= max_rows and (size or 0) <= max_bytes else frame


#: Hot keys found before, by the plan of the keys: (session, plan, tasks, least rows) to key and rows.
_FOUND: OrderedDict[tuple, dict] = OrderedDict()


def hot_keys(frame: DataFrame, key: str, min_rows: int = MIN_HOT_ROWS) -> dict:
    """Keys with more rows than a mean task of a shuffle, and the parts to cut each into.

    They are found with a sketch of frequent items, whose size is fixed and which is merged from the
    map tasks; nothing is shuffled. There are at most as many such keys as shuffle partitions. For one
    plan they are looked for once in a session: should the data have changed since, other keys
    are split, and no row is joined otherwise.
    """
    spark = frame.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = "`" + key.replace("`", "``") + "`"
    keys = frame.select(F.col(name).alias("key"))
    known = (spark.sparkContext.applicationId, keys.semanticHash(), tasks, min_rows)
    if known in _FOUND:
        _FOUND.move_to_end(known)
        return _FOUND[known]
    listed = min(tasks, TRACKED_KEYS)
    found = keys.where(F.col("key").isNotNull()).agg(
        F.count(F.lit(1)).alias("rows"),
        F.expr(f"approx_top_k(key, {listed}, {TRACKED_KEYS})").alias("top"),
    )
    total, top = found.first()
    mean = max(1.0, total / tasks)
    _FOUND[known] = {
        item["item"]: min(tasks, ceil(item["count"] / mean) * 2)
        for item in top or ()
        if item["count"] >= min_rows and item["count"] > mean
    }
    if len(_FOUND) > 256:
        _FOUND.popitem(last=False)
    return _FOUND[known]


def _place_in_file(frame: DataFrame) -> list[Column]:
    """What tells a row from an identical one wherever it is read again; nothing for rows that come from no file."""
    place = [F.col("_metadata.file_path"), F.col("_metadata.row_index")]
    try:
        frame.select(*place)
    except AnalysisException:
        return []
    return place


def salted_join(
    left: DataFrame, right: DataFrame, key: str, how: str = "inner", min_rows: int = MIN_HOT_ROWS
) -> DataFrame:
    """Join on ``key``, inner or left, with the rows of hot keys of ``left`` spread over tasks.

    The hot keys and their parts are a small table that is broadcast to both sides. Only the rows of ``right`` with a hot key
    are repeated, once for each part. The part of a left row follows from its values and, where it is read from a
    Parquet file, its place in it: so a repeated task deals it as before, and rows that are alike in all columns are split
    too. Of other sources such rows stay together. Rows with a null key match nothing and are not
    shuffled at all. Where the planner will broadcast ``right`` anyway, nothing is looked for.
    """
    if how not in ("inner", "left"):
        raise ValueError(f"an inner or left join, not {how!r}")
    if planner_broadcasts(right):
        return left.join(right, key, how)
    name = "`" + key.replace("`", "``") + "`"
    keyed = left.where(F.col(name).isNotNull())
    hot = hot_keys(left, key, min_rows)
    if not hot:
        joined = keyed.join(right, key, how)
    else:
        joined = _joined_in_parts(keyed, right, key, how, hot)
    if how == "inner":
        return joined
    nulls = left.where(F.col(name).isNull())
    added = [f for f in right.schema if f.name != key]
    empty = nulls.select("*", *(F.lit(None).cast(f.dataType).alias(f.name) for f in added))
    return joined.unionByName(empty.select(*joined.columns))


def _joined_in_parts(left: DataFrame, right: DataFrame, key: str, how: str, hot: dict) -> DataFrame:
    name = "`" + key.replace("`", "``") + "`"
    kind = left.schema[key].dataType.simpleString()
    table = F.broadcast(left.sparkSession.createDataFrame(sorted(hot.items()), f"__hot {kind}, __parts int"))
    values = [F.col("`" + c.replace("`", "``") + "`") for c in left.columns]
    seed = F.xxhash64(*values, *_place_in_file(left))
    shared = left.withColumn("__seed", seed).join(table, F.col(name) == F.col("__hot"), "left")
    dealt = shared.withColumn("__part", F.pmod("__seed", F.coalesce("__parts", F.lit(1)).cast("long")))
    parts = F.sequence(F.lit(0).cast("long"), (F.coalesce("__parts", F.lit(1)) - 1).cast("long"))
    copies = right.join(table, F.col(name) == F.col("__hot"), "left").withColumn("__part", F.explode(parts))
    extra = ("__seed", "__hot", "__parts")
    return dealt.drop(*extra).join(copies.drop(*extra), [key, "__part"], how).drop("__part")
