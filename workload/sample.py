"""The given Parquet tables in the shape of the transactional source tables.

The mapping is the one in FIXTURES.md, section 4. ``with_gaps`` leaves out an artist and a media type,
for the queries about lookups without a match.
"""

from __future__ import annotations

from datetime import date
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from salesmart.operators.calendar import day_bounds, dim_date
from salesmart.plans.dimensions import dim_track
from salesmart.plans.facts import fact_sales
from salesmart.sources.tables import ReadTable

# Fixed value: the day of the sample snapshots.
SNAPSHOT_DAY = "2001-12-31"


# The columns used of the given tables, declared so that no read infers a schema.
GIVEN = {
    "region": "r_regionkey INT, r_name STRING",
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
    "customer": "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_mktsegment STRING",
    "supplier": "s_suppkey BIGINT, s_name STRING, s_nationkey INT",
    "part": "p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING, p_size INT",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderdate TIMESTAMP_NTZ",
    "lineitem": "l_orderkey BIGINT, l_partkey BIGINT, l_linenumber INT, l_quantity DOUBLE, "
    "l_extendedprice DOUBLE",
    "events": "event_id BIGINT, ts TIMESTAMP_NTZ",
}


def given(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(GIVEN[name]).parquet(f"{sf_dir}/{name}.parquet")


def sample_tables(spark: SparkSession, sf_dir: str) -> ReadTable:
    """Reader of the source-shaped tables over ``sf_dir``."""

    def table(name: str) -> DataFrame:
        return given(spark, sf_dir, name)

    def customer() -> DataFrame:
        places = table("nation").join(table("region"), F.expr("n_regionkey = r_regionkey"))
        return (
            table("customer")
            .join(places, F.expr("c_nationkey = n_nationkey"))
            .selectExpr(
                "c_custkey AS customer_id",
                "split(c_name, '#')[0] AS first_name",
                "split(c_name, '#')[1] AS last_name",
                "c_mktsegment AS company",
                "CAST(NULL AS STRING) AS address",
                "concat('City ', c_custkey % 97) AS city",
                "r_name AS state",
                "n_name AS country",
                "CAST(NULL AS STRING) AS postal_code",
                "CAST(NULL AS STRING) AS phone",
                "CAST(NULL AS STRING) AS fax",
                "concat('c', c_custkey, '@example.com') AS email",
                "c_nationkey AS support_rep_id",
            )
        )

    def track() -> DataFrame:
        return table("part").selectExpr(
            "p_partkey AS track_id",
            "p_name AS name",
            "p_size AS album_id",
            "p_type AS genre_id",
            "p_brand AS media_type_id",
            "CAST(NULL AS STRING) AS composer",
            "p_size * 1000 AS milliseconds",
        )

    def album() -> DataFrame:
        sizes = table("part").select("p_size").distinct()
        return sizes.selectExpr(
            "p_size AS album_id", "concat('Album ', p_size) AS title", "p_size % 25 AS artist_id"
        )

    def artist() -> DataFrame:
        return table("nation").selectExpr("n_nationkey AS artist_id", "n_name AS name")

    def genre() -> DataFrame:
        return table("part").select("p_type").distinct().selectExpr("p_type AS genre_id", "p_type AS name")

    def media_type() -> DataFrame:
        brands = table("part").select("p_brand").distinct()
        return brands.selectExpr("p_brand AS media_type_id", "p_brand AS name")

    def invoice() -> DataFrame:
        return table("orders").selectExpr(
            "o_orderkey AS invoice_id", "o_custkey AS customer_id", "o_orderdate AS invoice_date"
        )

    def invoice_line() -> DataFrame:
        return table("lineitem").selectExpr(
            "l_orderkey AS invoice_id",
            "l_partkey AS track_id",
            "CAST(l_extendedprice AS DECIMAL(10,2)) AS unit_price",
            "CAST(l_quantity AS INT) AS quantity",
        )

    def employee() -> DataFrame:
        return (
            table("supplier")
            .join(table("nation"), F.expr("s_nationkey = n_nationkey"))
            .selectExpr(
                "s_suppkey AS employee_id",
                "split(s_name, '#')[0] AS first_name",
                "split(s_name, '#')[1] AS last_name",
                "n_name AS title",
                "IF(s_suppkey % 10 <> 0, s_suppkey - s_suppkey % 10, NULL) AS reports_to",
            )
        )

    makers = {
        maker.__name__: maker
        for maker in (
            customer,
            track,
            album,
            artist,
            genre,
            media_type,
            invoice,
            invoice_line,
            employee,
        )
    }
    return lambda name: makers[name]()


def with_gaps(read: ReadTable) -> ReadTable:
    """Without artist 24 and media type ``Brand#13``, so that some tracks have none."""
    gaps = {"artist": "artist_id <> 24", "media_type": "media_type_id <> 'Brand#13'"}
    return lambda name: read(name).filter(gaps[name]) if name in gaps else read(name)


def order_days(spark: SparkSession, sf_dir: str) -> tuple[date, date]:
    """First and last day of the given orders."""
    return day_bounds(given(spark, sf_dir, "orders"), "o_orderdate")


def sample_fact(read: ReadTable) -> DataFrame:
    return fact_sales(read("invoice"), read("invoice_line"), read("customer"))


def sample_tracks(read: ReadTable) -> DataFrame:
    return dim_track(*(read(t) for t in ("track", "album", "artist", "genre", "media_type")))


class SampleStar:
    """Fact, calendar and tracks computed straight from the given tables, each when asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str, gaps: bool = False) -> None:
        self._spark = spark
        self._sf_dir = sf_dir
        self._read = sample_tables(spark, sf_dir)
        if gaps:
            self._read = with_gaps(self._read)

    @cached_property
    def fact_sales(self) -> DataFrame:
        return sample_fact(self._read)

    @cached_property
    def dim_date(self) -> DataFrame:
        return dim_date(self._spark, *order_days(self._spark, self._sf_dir))

    @cached_property
    def dim_track(self) -> DataFrame:
        return sample_tracks(self._read)
