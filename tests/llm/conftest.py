import pytest
from pyspark.sql import functions as F

from salesmart.llm.queries import QUERIES
from salesmart.llm.steps import importable

SF_DIR = "/root/testdata/sf0.001"
LONG = "word " * 40_000
EDGE_TEXTS = [None, "", " \n\t ", "x", LONG, "same text twice over here", "same text twice over here", "é漢👍 ﬁ"]


@pytest.fixture(autouse=True)
def workers(spark):
    importable(spark)


@pytest.fixture(scope="session")
def result_of(spark):
    """Column names and rows of a registered query over the small tables, computed once."""
    found = {}

    def result(name):
        if name not in found:
            importable(spark)
            frame = QUERIES[name](spark, SF_DIR)
            found[name] = frame.columns, frame.collect()
        return found[name]

    return result


@pytest.fixture
def edge(spark):
    """Odd texts, a null id, a repeated row, and columns called like those that operators add."""
    rows = [(i if i else None, t, "en" if i % 2 else None, None) for i, t in enumerate(EDGE_TEXTS)]
    rows.append(rows[5])
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    clashes = ("ids", "decoded", "n_tokens", "n_shingles", "component_id", "n_words", "hit_spans", "items")
    clashes += ("kept", "failed", "n_bytes", "removed", "blob", "spans", "score", "rejected", "lang_pred")
    return frame.select("*", *(F.lit("mine").alias(c) for c in clashes), F.lit(1).alias("odd `name`.x"))


@pytest.fixture
def docs(spark):
    return spark.read.parquet(f"{SF_DIR}/documents.parquet")


@pytest.fixture
def texts(docs):
    return {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
