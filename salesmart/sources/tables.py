"""Source readers: each returns a function from a table name to a DataFrame."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from salesmart.schemas import DATE_PARTITIONS, KEPT, TABLES
from salesmart.sinks.manifest import LOAD, PartitionLog, day_of
from salesmart.sinks.versions import current

ReadTable = Callable[[str], DataFrame]

# The transactional tables and the numeric column each is read in ranges of.
SOURCE_KEYS = {
    "customer": "customer_id",
    "track": "track_id",
    "album": "album_id",
    "artist": "artist_id",
    "genre": "genre_id",
    "media_type": "media_type_id",
    "invoice": "invoice_id",
    "invoice_line": "invoice_id",
    "employee": "employee_id",
}


def read_within(read: ReadTable, name: str, column: str, low, high) -> DataFrame:
    """Rows of a table with ``column`` from ``low`` to ``high``, both included.

    The range is a filter that reaches the scan. A reader with a ``within`` of its own, as that of a
    database, also splits its read by that range and not by that of the whole table.
    """
    within = getattr(read, "within", None)
    frame = read(name) if within is None else within(name, column, low, high)
    return frame.filter(F.col(column).between(F.lit(low), F.lit(high)))


def parquet_tables(spark: SparkSession, base: str) -> ReadTable:
    """Source tables stored as one Parquet folder each under ``base``."""
    return lambda name: spark.read.parquet(f"{base.rstrip('/')}/{name}")


def catalog_tables(spark: SparkSession, database: str) -> ReadTable:
    """Source tables registered in a database.

    With ``invoice`` and ``invoice_line`` bucketed by ``invoice_id`` into equally many buckets,
    the lines are joined without being shuffled.
    """
    return lambda name: spark.table(f"{database}.{name}")


def jdbc_tables(
    spark: SparkSession,
    url: str,
    *,
    split_on: Mapping[str, str] | None = None,
    partitions: int = 64,
    fetch_size: int = 10_000,
    balanced: bool = False,
    **options: str,
) -> ReadTable:
    """Source tables in a relational database.

    A table is read as ``partitions`` ranges of its key, between the least and the greatest
    value, which are asked of the database first. ``split_on`` names other columns: invoice
    lines are best split on a unique key of their own if they have one, since all lines of one
    invoice fall into one range. Filters and column lists are pushed into the query by Spark.

    Ranges are equally wide. With ``balanced`` they hold about equally many rows instead, also where keys have gaps or lie
    close together: the database counts rows by stretches of keys first, and again within stretches that hold too many.
    """
    columns = SOURCE_KEYS | dict(split_on or {})

    def reader():
        return spark.read.format("jdbc").options(url=url, fetchsize=str(fetch_size), **options)

    def ends(name: str, column: str, condition: str = "") -> tuple:
        query = f"SELECT MIN({column}) AS lo, MAX({column}) AS hi FROM {name}{condition}"
        return reader().option("query", query).load().first()

    def counted(name: str, column: str) -> Count:
        def count(low: int, high: int, width: int) -> list[tuple[int, int]]:
            stretch = f"FLOOR(({column} - {low}) / {width})"
            query = f"SELECT {stretch} AS stretch, COUNT(*) AS n FROM {name} WHERE {column} BETWEEN {low} AND {high} GROUP BY {stretch}"
            return [(int(r[0]), int(r[1])) for r in reader().option("query", query).load().collect()]

        return count

    def in_equal_parts(name: str, column: str, low: int, high: int) -> DataFrame:
        cuts = balanced_cuts(counted(name, column), low, high, partitions)
        properties = {"fetchsize": str(fetch_size)} | {k: str(v) for k, v in options.items()}
        return spark.read.jdbc(url=url, table=name, predicates=cut_predicates(column, cuts), properties=properties)

    def read(name: str) -> DataFrame:
        table = reader().option("dbtable", name)
        column = columns.get(name)
        if column is not None:
            low, high = ends(name, column)
            if low is not None and balanced:
                return in_equal_parts(name, column, int(low), int(high))
            if low is not None:
                table = table.options(**split_options(column, int(low), int(high), partitions))
        return table.load()

    def within(name: str, column: str, low: int, high: int) -> DataFrame:
        """``name`` split so that the rows with ``column`` in the range fill all partitions."""
        table = reader().option("dbtable", name)
        by = columns.get(name, column)
        if by != column:
            low, high = ends(name, by, f" WHERE {column} BETWEEN {int(low)} AND {int(high)}")
        if low is not None and balanced:
            return in_equal_parts(name, by, int(low), int(high))
        if low is not None:
            table = table.options(**split_options(by, int(low), int(high), partitions))
        return table.load()

    read.within = within
    return read


def split_options(column: str, low: int, high: int, partitions: int) -> dict[str, str]:
    """JDBC options that read ``column`` in equal ranges, no more of them than values."""
    return {
        "partitionColumn": column,
        "lowerBound": str(low),
        "upperBound": str(high + 1),
        "numPartitions": str(max(1, min(partitions, high - low + 1))),
    }


Count = Callable[[int, int, int], list[tuple[int, int]]]


def balanced_cuts(count: Count, low: int, high: int, parts: int, stretches: int = 1024) -> list[int]:
    """Keys from ``low`` to ``high`` at which ranges of about equally many rows begin, the first of them ``low``.

    ``count(low, high, width)`` gives the number of the stretch of ``width`` keys from ``low`` on, and its rows, for each that
    has any. A stretch with more than half a part is counted again in shorter ones, down to single keys, which are never cut.
    There are at most twice as many such stretches as parts at a time.
    """
    found: list[tuple[int, int]] = []
    total = 0
    open_ = [(low, high)]
    while open_:
        closer = []
        for start, end in open_:
            width = -(-(end - start + 1) // stretches)
            rows = count(start, end, width)
            total = total or sum(n for _, n in rows)
            for k, n in sorted(rows):
                first = start + k * width
                if width > 1 and 2 * n * parts > total:
                    closer.append((first, min(end, first + width - 1)))
                else:
                    found.append((first, n))
        open_ = closer
    cuts, held, part = [low], 0, 1
    for first, n in sorted(found):
        # The end of a part falls before this stretch if it lies before its middle.
        ends = part
        while (2 * held + n) * parts > 2 * ends * total:
            ends += 1
        if ends > part and held:
            cuts.append(first)
        part = ends
        held += n
    return cuts


def cut_predicates(column: str, cuts: list[int]) -> list[str]:
    """Conditions that hold for each row exactly once; rows without a key belong to the first."""
    if len(cuts) == 1:
        return ["1 = 1"]
    conditions = [f"{column} < {cuts[1]} OR {column} IS NULL"]
    conditions += [f"{column} >= {a} AND {column} < {b}" for a, b in zip(cuts[1:], cuts[2:], strict=False)]
    return [*conditions, f"{column} >= {cuts[-1]}"]


def curated_tables(spark: SparkSession, base: str, years: tuple[int, int] | None = None) -> ReadTable:
    """Curated tables under ``base``, with their declared schemas and no inference.

    A partitioned table is read from the partitions that its log names, and no other folder is listed. With ``years`` only
    days of these years (both included) exist in the calendar and the fact, as if there were no others; sales
    without a date are then not read either. Of a table that is replaced as a whole the newest version is read.
    """

    def read(name: str) -> DataFrame:
        table, path = (TABLES | KEPT)[name], f"{base.rstrip('/')}/{name}"
        if table.partition_by:
            log = PartitionLog(spark, path, table.partition_by)
            if log.is_used():
                return log.read(table.schema, keep=declared_years(table.partition_by, years))
        return spark.read.schema(table.schema).parquet(current(spark, path))

    return read


def declared_years(partition_by: list[str], years: tuple[int, int] | None) -> Callable[[str], bool]:
    """Whether a partition by day lies in the declared years; any other partition does."""
    if years is None or partition_by != DATE_PARTITIONS:
        return lambda part: True
    first, last = years

    def within(part: str) -> bool:
        day = day_of(part)
        return day is not None and first <= day.year <= last

    return within


def whole_customer_history(spark: SparkSession, base: str) -> DataFrame:
    """Customer snapshots with all columns that any snapshot has, the declared ones first."""
    table = TABLES["customer_history"]
    path = f"{base.rstrip('/')}/customer_history"
    log = PartitionLog(spark, path, table.partition_by)
    folders = [f"{path}/{f}" for f in log.state().folders()] if log.is_used() else [path]
    frame = spark.read.option("mergeSchema", "true").option("basePath", path).parquet(*folders).drop(LOAD)
    further = [name for name in frame.columns if name not in table.schema.names]
    return frame.select(
        *(F.col(f.name).cast(f.dataType) for f in table.schema), *("`" + c.replace("`", "``") + "`" for c in further)
    )
