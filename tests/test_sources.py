import tempfile
from types import SimpleNamespace

import duckdb
import pytest

from salesmart.sinks.scratch import scratch_path
from salesmart.sources.tables import balanced_cuts, curated_tables, cut_predicates, jdbc_tables, split_options


def test_split_options_cover_the_range():
    assert split_options("id", 1, 1000, 8) == {
        "partitionColumn": "id",
        "lowerBound": "1",
        "upperBound": "1001",
        "numPartitions": "8",
    }
    assert split_options("id", 5, 6, 64)["numPartitions"] == "2"


class RecordingReader:
    """Stand-in for ``spark.read``: keeps the options of every load and answers bound queries."""

    def __init__(self, loads, bounds, options=()):
        self.loads, self.bounds, self.settings = loads, bounds, dict(options)

    def format(self, source):
        return RecordingReader(self.loads, self.bounds, self.settings | {"format": source})

    def options(self, **more):
        return RecordingReader(self.loads, self.bounds, self.settings | more)

    def option(self, key, value):
        return self.options(**{key: value})

    def load(self):
        self.loads.append(self.settings)
        return SimpleNamespace(first=lambda: self.bounds)


def test_jdbc_tables_are_read_in_ranges_of_the_split_column():
    loads = []
    spark = SimpleNamespace(read=RecordingReader(loads, (1, 1000)))
    read = jdbc_tables(spark, "jdbc:x", split_on={"invoice_line": "line_id"}, partitions=4, user="u")
    read("track")
    read("invoice_line")
    read("unknown")
    common = {"format": "jdbc", "url": "jdbc:x", "fetchsize": "10000", "user": "u"}
    assert loads == [
        common | {"query": "SELECT MIN(track_id) AS lo, MAX(track_id) AS hi FROM track"},
        common | {"dbtable": "track"} | split_options("track_id", 1, 1000, 4),
        common | {"query": "SELECT MIN(line_id) AS lo, MAX(line_id) AS hi FROM invoice_line"},
        common | {"dbtable": "invoice_line"} | split_options("line_id", 1, 1000, 4),
        common | {"dbtable": "unknown"},
    ]


def test_a_jdbc_range_is_split_by_its_own_bounds():
    loads = []
    spark = SimpleNamespace(read=RecordingReader(loads, (300, 400)))
    jdbc_tables(spark, "jdbc:x", partitions=4).within("invoice_line", "invoice_id", 10, 20)
    assert loads[-1].items() >= split_options("invoice_id", 10, 20, 4).items()
    read = jdbc_tables(spark, "jdbc:x", split_on={"invoice_line": "line_id"}, partitions=4)
    read.within("invoice_line", "invoice_id", 10, 20)
    assert loads[-2]["query"].endswith("FROM invoice_line WHERE invoice_id BETWEEN 10 AND 20")
    assert loads[-1].items() >= split_options("line_id", 300, 400, 4).items()


def test_an_empty_jdbc_table_is_not_split():
    loads = []
    spark = SimpleNamespace(read=RecordingReader(loads, (None, None)))
    jdbc_tables(spark, "jdbc:x")("track")
    assert "partitionColumn" not in loads[-1]


def test_curated_tables_use_the_declared_schema(spark, tmp_path):
    spark.range(0).write.parquet(str(tmp_path / "dim_customer"))
    assert curated_tables(spark, str(tmp_path))("dim_customer").columns[0] == "CustomerKey"


def session(shared, master="local[2]"):
    """Stand-in for a session: the setting is fixed once a real one has started."""
    return SimpleNamespace(
        conf={"spark.checkpoint.dir": shared}, sparkContext=SimpleNamespace(master=master)
    )


def test_scratch_path_is_new_and_in_the_shared_folder():
    shared = session("/shared/folder/", "yarn")
    one, other = scratch_path(shared, "x"), scratch_path(shared, "x")
    assert one != other and one.startswith("/shared/folder/x-")


def test_scratch_path_without_a_shared_folder():
    assert scratch_path(session(None), "x").startswith(tempfile.gettempdir())
    with pytest.raises(RuntimeError):
        scratch_path(session(None, "yarn"), "x")


def histogram(keys):
    """What a database counts, and how often it is asked."""
    asked = []

    def count(low, high, width):
        asked.append((low, high, width))
        found = {}
        for key, n in keys.items():
            if low <= key <= high:
                found[(key - low) // width] = found.get((key - low) // width, 0) + n
        return sorted(found.items())

    return count, asked


@pytest.mark.parametrize(
    "keys",
    [
        {k: 1 for k in range(1, 100_001)},
        {k * k: 1 for k in range(1, 30_000)},  # gaps that grow
        {**{k: 1 for k in range(5000)}, **{10**12 + k: 1 for k in range(60_000)}},  # a hot range far away
        {**{k * 1000: 1 for k in range(20_000)}, 7: 20_000},  # a hot key
        {5: 3},
    ],
)
def test_cuts_give_even_parts(keys):
    count, asked = histogram(keys)
    parts = 16
    cuts = balanced_cuts(count, min(keys), max(keys), parts)
    assert cuts == sorted(set(cuts)) and cuts[0] == min(keys) and len(cuts) <= parts + 1
    ends = [*cuts[1:], max(keys) + 1]
    sizes = [sum(n for k, n in keys.items() if a <= k < b) for a, b in zip(cuts, ends, strict=True)]
    assert sum(sizes) == sum(keys.values())
    fair = sum(sizes) / parts
    assert max(sizes) <= max(2 * fair, max(keys.values()) + fair)
    assert len(asked) <= 2 * parts * 5


def test_predicates_hold_once_for_each_row():
    assert cut_predicates("k", [3]) == ["1 = 1"]
    rows = [None, 1, 3, 4, 7, 8, 100]
    for cuts in ([1, 4], [1, 4, 8]):
        connection = duckdb.connect()
        connection.execute("CREATE TABLE t AS SELECT unnest($1::INT[]) AS k", [rows])
        found = [connection.execute(f"SELECT count(*) FROM t WHERE {p}").fetchone()[0] for p in cut_predicates("k", cuts)]
        assert sum(found) == len(rows) and len(found) == len(cuts)


def test_balanced_jdbc_tables_are_read_by_predicates():
    loads, made = [], []

    class Reader(RecordingReader):
        def load(self):
            self.loads.append(self.settings)
            rows = [(0, 10), (1, 10), (3, 20)]
            return SimpleNamespace(first=lambda: self.bounds, collect=lambda: rows)

        def format(self, source):
            return Reader(self.loads, self.bounds, self.settings | {"format": source})

        def options(self, **more):
            return Reader(self.loads, self.bounds, self.settings | more)

        def jdbc(self, **given):
            made.append(given)

    spark = SimpleNamespace(read=Reader(loads, (1, 4)))
    read = jdbc_tables(spark, "jdbc:x", partitions=2, balanced=True, user="u")
    read("track")
    assert "FLOOR((track_id - 1) / 1)" in loads[-1]["query"] and "GROUP BY" in loads[-1]["query"]
    assert made == [
        {
            "url": "jdbc:x",
            "table": "track",
            "predicates": ["track_id < 4 OR track_id IS NULL", "track_id >= 4"],
            "properties": {"fetchsize": "10000", "user": "u"},
        }
    ]
    read.within("invoice_line", "invoice_id", 1, 4)
    assert made[-1]["table"] == "invoice_line" and len(made[-1]["predicates"]) == 2
