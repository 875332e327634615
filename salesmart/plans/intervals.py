"""History kept as changes: a day stores only the rows that differ from the day before.

A row is named by a digest of its values. A day's partition holds an event for each digest whose number of copies is another than
on the last day taken: the row with its copies, or none of them when it is gone; and one marker that says the day was taken. Runs of days
with equal rows are intervals between two events, and any day's full copy follows from the last event of each digest.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from salesmart.functions.dates import as_date
from salesmart.plans.history import customer_history, employee_reports
from salesmart.sinks.manifest import LOAD, PartitionLog, Scope, day_of
from salesmart.sources.tables import ReadTable

EVENT_DATE, DIGEST, COPIES = "event_date", "row_digest", "copies"
_OWN = (EVENT_DATE, DIGEST, COPIES, LOAD)


def _name(column: str) -> Column:
    return F.col("`" + column.replace("`", "``") + "`")


def digested(rows: DataFrame) -> DataFrame:
    """Different rows with their digest and number of copies.

    Null values do not count, so a column that is new and null everywhere changes no digest.
    """
    columns = sorted(rows.columns)
    digest = F.sha2(F.to_json(F.struct(*map(_name, columns)), {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}), 256)
    return rows.withColumn(DIGEST, digest).groupBy(*map(_name, rows.columns), DIGEST).agg(F.count(F.lit(1)).alias(COPIES))


def events_between(before: DataFrame, after: DataFrame, day: date) -> DataFrame:
    """Events that lead from the digested rows ``before`` to those ``after``, and the marker of the day."""
    was = before.select(F.col(DIGEST).alias("__was"), F.col(COPIES).alias("__copies"))
    came = after.join(was, F.col(DIGEST) == F.col("__was"), "left").where(~F.col(COPIES).eqNullSafe(F.col("__copies")))
    gone = before.join(after.select(DIGEST), DIGEST, "left_anti").select(DIGEST, F.lit(0).cast("long").alias(COPIES))
    marker = before.sparkSession.range(1).select(F.lit(None).cast("string").alias(DIGEST), F.lit(0).cast("long").alias(COPIES))
    every = came.drop("__was", "__copies").unionByName(gone.unionByName(marker), allowMissingColumns=True)
    return every.withColumn(EVENT_DATE, F.lit(day))


class ChangeHistory:
    """The changes of one table under ``path``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.log = PartitionLog(spark, self.path, [EVENT_DATE])

    def days(self) -> list[date]:
        """Days that were taken, in order."""
        return sorted(day_of(part) for part in self.log.state().holder)

    def events(self, until: date | None = None) -> DataFrame | None:
        """Events up to a day, with all columns that any day has; None without any."""
        state = self.log.state()
        folders = state.folders(lambda part: until is None or day_of(part) <= until)
        if not folders:
            return None
        reader = self.spark.read.option("mergeSchema", "true").option("basePath", self.path)
        frame = reader.parquet(*(f"{self.path}/{f}" for f in folders)).drop(LOAD)
        return frame.withColumn(EVENT_DATE, F.col(EVENT_DATE).cast("date")).where(F.col(DIGEST).isNotNull())

    def _state(self, until: date | None, like: T.StructType) -> DataFrame:
        """Digested rows as they were on a day, the columns of ``like`` among them."""
        events = None if until is None else self.events(until)
        if events is None:
            own = T.StructType([*like.fields, T.StructField(DIGEST, T.StringType()), T.StructField(COPIES, T.LongType())])
            return self.spark.createDataFrame([], own)
        data = [c for c in events.columns if c not in _OWN]
        whole = F.struct(*map(_name, data), COPIES)
        last = events.groupBy(DIGEST).agg(F.max_by(whole, EVENT_DATE).alias("last")).where(F.col(f"last.{COPIES}") > 0)
        return last.select("last.*", DIGEST)

    def take(self, rows: DataFrame, day: date | str) -> None:
        """Make ``rows`` the full copy of ``day``; taking a day again replaces it, and later days stay as they were."""
        day = as_date(day)
        taken = self.days()
        former = max((d for d in taken if d < day), default=None)
        later = min((d for d in taken if d > day), default=None)
        before = self.log.state()
        now = digested(rows)
        events = events_between(self._state(former, rows.schema), now, day)
        replaced = {day}
        if later is not None:  # its events were those after the former rows of this day
            events = events.unionByName(events_between(now, self._state(later, rows.schema), later), allowMissingColumns=True)
            replaced.add(later)
        scope = Scope(parts=frozenset(f"{EVENT_DATE}={d.isoformat()}" for d in replaced))
        self.log.publish(before, scope, self.log.write(events.repartition(EVENT_DATE)))

    def as_of(self, day: date | str) -> DataFrame:
        """The full copy of the last day taken up to ``day``."""
        day = as_date(day)
        rows = self._state(max((d for d in self.days() if d <= day), default=None), T.StructType())
        return _repeated(rows).drop(DIGEST)

    def intervals(self) -> DataFrame:
        """Rows with ``valid_from`` and ``valid_to`` (the first day without them, null if there is none) and their copies."""
        events = self.events()
        if events is None:
            raise ValueError(f"no day was taken of {self.path}")
        following = F.lead(EVENT_DATE).over(Window.partitionBy(DIGEST).orderBy(EVENT_DATE)).alias("valid_to")
        data = [_name(c) for c in events.columns if c not in _OWN]
        found = events.select(*data, DIGEST, COPIES, F.col(EVENT_DATE).alias("valid_from"), following)
        return found.where(F.col(COPIES) > 0)

    def copies(self) -> DataFrame:
        """The full copies of all days taken, with their ``snapshot_date``."""
        days = F.array(*(F.lit(d) for d in self.days()))
        within = F.filter(
            days, lambda d: (d >= F.col("valid_from")) & (F.col("valid_to").isNull() | (d < F.col("valid_to")))
        )
        rows = self.intervals().withColumn("snapshot_date", F.explode(within))
        return _repeated(rows).drop(DIGEST, "valid_from", "valid_to")


def _repeated(rows: DataFrame) -> DataFrame:
    each = rows.withColumn("__each", F.explode(F.array_repeat(F.lit(1), F.col(COPIES).cast("int"))))
    return each.drop("__each", COPIES)


def refresh_history_changes(read: ReadTable, base: str, as_of: date | str | None = None) -> None:
    """Take a day, today by default, of the customers and reporting lines as changes."""
    customer = read("customer")
    if as_of is None:
        as_of = customer.sparkSession.sql("SELECT current_date()").first()[0]
    frames = {
        "customer_history": customer_history(customer, as_of),
        "employee_reports_history": employee_reports(read("employee"), as_of),
    }
    for name, frame in frames.items():
        ChangeHistory(frame.sparkSession, f"{base}/{name}_changes").take(frame.drop("snapshot_date"), as_of)
