"""Registration of the curated tables in the session catalog."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import SparkSession

from salesmart.schemas import TABLES
from salesmart.sinks.manifest import LOAD, PartitionLog, values_of
from salesmart.sinks.versions import current, exists, file_system, qualified
from salesmart.sources.tables import declared_years

#: Property of a table that tells which partitions of its log it shows.
SHOWN = "salesmart.shown"
#: Partitions named in one statement.
PARTITIONS_AT_ONCE = 500


def register_tables(spark: SparkSession, database: str, base: str) -> None:
    """Create the database and the six external tables over ``base`` where they do not exist.

    The database has no folder among the tables, so dropping it leaves their files. A table that was
    registered over another base raises. Folders of tables not written yet are created, so that each
    can be queried at once.
    """
    base = base.rstrip("/")
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
    for name in TABLES:
        folder = f"{base}/{name}"
        if not exists(spark, folder):
            system, place = file_system(spark, folder)
            system.mkdirs(place)
        if spark.catalog.tableExists(f"{database}.{name}"):
            root, stored = qualified(spark, folder), _location(spark, database, name)
            if stored != root and not stored.startswith(f"{root}/"):
                raise ValueError(f"{database}.{name} is registered over {stored}, not {root}")
        else:
            _create(spark, database, name, current(spark, folder))


def discover_partitions(spark: SparkSession, database: str, years: tuple[int, int] | None = None) -> None:
    """Make what was written or removed since the last call known to queries.

    The partitions of a table with a log are added, moved and dropped one by one as its entries since the last call say;
    nothing is listed. With ``years`` days of other years stay unknown, and so do rows without a day. A partitioned table without a log is
    listed by the catalog. Tables that are replaced as a whole are pointed to their newest version. A table that is
    not written yet stays empty.
    """
    for name, table in TABLES.items():
        location = _location(spark, database, name)
        root = location.rpartition("/version-")[0] or location
        log = PartitionLog(spark, root, table.partition_by) if table.partition_by else None
        if log is not None and log.is_used():
            _follow(spark, f"{database}.{name}", log, years)
        else:
            newest = qualified(spark, current(spark, root))
            if newest != location:
                spark.sql(f"DROP TABLE {database}.{name}")
                _create(spark, database, name, newest)
            if not exists(spark, newest):
                continue
            if table.partition_by:
                spark.sql(f"MSCK REPAIR TABLE {database}.{name} SYNC PARTITIONS")
        spark.catalog.refreshTable(f"{database}.{name}")
        if name.startswith("dim_"):  # what the views join; the fact is never scanned for this
            spark.sql(f"ANALYZE TABLE {database}.{name} COMPUTE STATISTICS NOSCAN")


def _follow(spark: SparkSession, table: str, log: PartitionLog, years: tuple[int, int] | None) -> None:
    """Bring the partitions of ``table`` from the version and years it shows to the newest version and ``years``."""
    row = spark.sql(f"SHOW TBLPROPERTIES {table}").where(f"key = '{SHOWN}'").first()
    version, former = json.loads(row["value"]) if row else (0, None)
    now = log.state()
    if row and (version, former) == (now.version, years and list(years)):
        return
    shown = declared_years(log.partition_by, former and tuple(former))
    declared = declared_years(log.partition_by, years)
    old = {p: h for p, h in log.state(version).holder.items() if shown(p)} if version else {}
    new = {p: h for p, h in now.holder.items() if declared(p)}
    gone = [p for p in old if old[p] != new.get(p)]
    added = [p for p in new if new[p] != old.get(p)]
    for some in _batches(gone):
        specs = ", ".join(f"PARTITION ({_spec(p)})" for p in some)
        spark.sql(f"ALTER TABLE {table} DROP IF EXISTS {specs}")
    for some in _batches(added):
        specs = " ".join(f"PARTITION ({_spec(p)}) LOCATION '{_quoted(_folder(log, new[p], p))}'" for p in some)
        spark.sql(f"ALTER TABLE {table} ADD IF NOT EXISTS {specs}")
    spark.sql(f"ALTER TABLE {table} SET TBLPROPERTIES ('{SHOWN}' = '{json.dumps([now.version, years])}')")


def _batches(parts: list[str]) -> Iterator[list[str]]:
    for start in range(0, len(parts), PARTITIONS_AT_ONCE):
        yield parts[start : start + PARTITIONS_AT_ONCE]


def _spec(part: str) -> str:
    names = [p.partition("=")[0] for p in part.split("/")]
    values = ("NULL" if v is None else f"'{v}'" for v in values_of(part))
    return ", ".join(f"{n} = {v}" for n, v in zip(names, values, strict=True))


def _folder(log: PartitionLog, load: str, part: str) -> str:
    return f"{log.path}/{LOAD}={load}/{part}"


def _quoted(path: str) -> str:
    return path.replace("'", "\\'")


def _create(spark: SparkSession, database: str, name: str, location: str) -> None:
    table = TABLES[name]
    columns = ", ".join(c for c in (table.columns, table.partitions) if c)
    partitioned = f"PARTITIONED BY ({', '.join(table.partition_by)})" if table.partition_by else ""
    place = _quoted(location)
    spark.sql(f"CREATE TABLE {database}.{name} ({columns}) USING parquet {partitioned} LOCATION '{place}'")


def _location(spark: SparkSession, database: str, name: str) -> str:
    rows = spark.sql(f"DESCRIBE TABLE EXTENDED {database}.{name}")
    stored = rows.where("col_name = 'Location'").first()["data_type"]
    return qualified(spark, stored.rstrip("/"))
