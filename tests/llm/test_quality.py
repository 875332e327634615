import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from salesmart.llm import quality
from salesmart.llm.queries import QUERIES
from tests.llm.conftest import SF_DIR

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute(text):
    text = text or ""
    own = WORD.findall(text)
    windows = [tuple(own[i : i + 3]) for i in range(len(own) - 2)]
    often = Counter(windows)
    repeated = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (
        len(own),
        sum(map(len, own)),
        len(re.findall("[#*$%&|<>]", text)),
        sum(x in lines[:i] for i, x in enumerate(lines)),
        len(repeated),
    )


def test_measures_of_odd_texts():
    for text in (None, "", " \n", "a", "a b c a b c a", "x\nx\n\ny\n x\n", "a\x85b\xa0c \x0b d", "# * $ <>", "b b b b b"):
        assert quality.measure(text)[:5] == brute(text), text


def test_query_equals_brute_force(spark, texts):
    rows = QUERIES["op5_quality"](spark, SF_DIR).collect()
    assert len(rows) == len(texts)
    for row in rows:
        found = brute(texts[row.doc_id])
        assert (row.n_words, row.word_chars, row.n_symbols, row.n_dup_lines, row.n_repeat_words) == found
        failed = found[0] < 50 or 100 * found[4] > 50 * found[0]
        assert row.base_failed == failed
        assert not (failed and row.kept)


def sketch_of(spark, groups, ratio="symbols"):
    rows = [(*group, ratio, v, n) for group, values in groups.items() for v, n in Counter(values).items()]
    return spark.createDataFrame(rows, "lang string, source string, ratio string, value long, n long")


def walked(values, step):
    """The limit of a group, from its sorted values."""
    values = sorted(values)
    found = [values[-(-p * len(values) // 100) - 1] for p in quality.WALK]
    tail = found[0]
    for value in found[1:]:
        if value - tail > step + quality.REACH * (tail - found[0]):
            break
        tail = value
    return tail + quality.REACH * (tail - found[0]) + step


def test_limits_walk_the_quantiles_of_merged_sketches(spark):
    groups = {("en", "a"): [*range(200)], ("en", "b"): [0] * 70 + [400] * 30, ("en", "c"): [7], ("de", "a"): [0, 60, 170, 500]}
    sketch = sketch_of(spark, groups)
    own = {(r.lang, r.source): (r.n, r.own) for r in quality.limits(sketch, "lang", "source").collect()}
    assert own == {g: (len(v), walked(v, 50)) for g, v in groups.items()}
    assert own["en", "b"] == (100, 50)  # not the junk
    english = [v for (lang, _), values in groups.items() if lang == "en" for v in values]
    both = {r.lang: r.own for r in quality.limits(quality.merged(sketch, "lang"), "lang").collect()}
    assert both == {"en": walked(english, 50), "de": walked(groups["de", "a"], 50)}
    halves = sketch.where("value % 2 = 0").unionByName(sketch.where("value % 2 = 1"))
    assert {r.lang: r.own for r in quality.limits(quality.merged(halves, "lang"), "lang").collect()} == both


def test_limits_differ_between_groups(spark):
    docs = spark.read.parquet(f"{SF_DIR[:-5]}0.1/documents.parquet")
    sketch = quality.sketches(quality.measures(docs), "lang", "source")
    found = quality.limits(sketch, "lang", "source").groupBy("ratio").agg(F.countDistinct("own").alias("n")).collect()
    assert sum(r.n > 10 for r in found) >= 4


@pytest.mark.parametrize("others", [0, 400])
def test_a_source_with_much_junk_does_not_keep_it(spark, others):
    """30 of 100 documents with about 400 symbols in 1,000 words, alone or among clean sources."""
    def text(i, symbols):
        words = [f"word{i:04}x{k:02}" for k in range(100)]
        for k in range(symbols):
            words[2 * k] += "#"
        return " ".join(words)

    rows = [(i, text(i, 40 if i % 10 < 3 else i % 3), "en", "junk") for i in range(100)]
    rows += [(1000 + i, text(i, i % 2), "en", f"s{i % 4}") for i in range(others)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    gone = {r.doc_id for r in quality.judge(frame).where("not kept").collect()}
    assert gone == {i for i in range(100) if i % 10 < 3}


def test_limits_move_with_the_size_of_a_group(spark):
    """49 and 50 documents are no different matter, and few documents follow their language."""
    def limit(n):
        values = F.lit(n).cast("long"), F.lit(100).cast("long"), F.lit(20).cast("long")
        return spark.range(1).select(quality._drawn(*values).alias("x")).first().x

    assert [limit(n) for n in (0, 1, 49, 50, 51, 10**9)] == [20, 21, 59, 60, 60, 99]


def test_junk_goes_and_clean_documents_stay(spark):
    rows = spark.read.parquet(f"{SF_DIR[:-5]}0.1/labels.parquet").join(
        QUERIES["op5_quality"](spark, f"{SF_DIR[:-5]}0.1"), "doc_id"
    ).where("n_words >= 50")
    share = {r.quality: r.kept for r in rows.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()}
    assert share[1] > 0.99
    assert share[0] < 0.3


def test_odd_rows_and_groups(spark, edge):
    rows = quality.judge(edge).collect()
    assert len(rows) == 9
    assert not any(r.kept for r in rows)
    assert quality.judge(edge.limit(0)).count() == 0
    clean = " ".join(f"word{i} likes{i % 7}" for i in range(40))
    many = spark.range(200).select(
        F.col("id").alias("doc_id"), F.lit(clean).alias("text"), F.lit(None).cast("string").alias("lang"), F.lit("s").alias("source")
    )
    assert quality.judge(many).where("kept").count() == 200
