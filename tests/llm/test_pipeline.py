import re

import pytest

import corpus_pipeline
from salesmart.llm import ngram_join, quality
from tests.llm.conftest import SF_DIR
from tests.llm.test_decontaminate import brute as contaminated
from tests.llm.test_ngram_join import brute as grouped
from tests.llm.test_secret_scan import brute as secrets

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality_rules", "near_duplicates", "decontamination", "secrets", "tokens"]

    kept = stages["quality_rules"](spark, docs, SF_DIR).cache()
    verdicts = {r.doc_id: r.kept for r in quality.judge(docs).collect()}
    assert {r.doc_id for r in kept.collect()} == {k for k, v in verdicts.items() if v}

    texts = {r.doc_id: r.text for r in kept.collect()}
    single = stages["near_duplicates"](spark, kept, SF_DIR).cache()
    groups = grouped(texts, ngram_join.Rule(5, 80, 100))
    assert sorted(r.doc_id for r in single.collect()) == sorted({c for _, c in groups.values()})

    items = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()]
    clean = stages["decontamination"](spark, single, SF_DIR).cache()
    expected = {r.doc_id for r in single.collect() if not contaminated(r.text, items, 10)[1]}
    assert {r.doc_id for r in clean.collect()} == expected

    masked = stages["secrets"](spark, clean, SF_DIR).cache()
    assert [n for n, _ in masked.dtypes] == corpus_pipeline.COLUMNS
    before = {r.doc_id: r.text for r in clean.collect()}
    for row in masked.collect():
        assert secrets(row.text) == []
        assert len(row.text) == len(before[row.doc_id])
        assert bool(re.search(r"\*{16}", row.text)) >= bool(secrets(before[row.doc_id]))
    assert masked.count() == clean.count()

    coded = stages["tokens"](spark, masked, SF_DIR).collect()
    assert len(coded) == len(expected)
    assert all(r.round_trip and r.n_tokens == len(r.ids) for r in coded)

    whole = {r.doc_id: r.ids for r in corpus_pipeline.run(spark, SF_DIR).collect()}
    assert whole == {r.doc_id: r.ids for r in coded}


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_on_odd_rows(spark, name):
    clean = " ".join(f"word{i} likes{i % 7}" for i in range(40))
    rows = [
        (None, clean, None, None, None), (1, None, "en", "s", 0), (2, "", "en", None, 0), (3, clean, "en", "s", 9),
        (3, clean, "en", "s", 9), (4, clean, None, "s", 9), (5, clean + " token=12345678", "en", "s", 9),
    ]
    stage = dict(corpus_pipeline.STAGES)[name]
    found = stage(spark, spark.createDataFrame(rows, DOCUMENTS), SF_DIR).collect()
    ids = sorted((r.doc_id or 0) for r in found)
    assert ids == {
        "quality_rules": [0, 3, 3, 4, 5],
        "near_duplicates": [0, 1, 2, 3],
    }.get(name, [0, 1, 2, 3, 3, 4, 5])
    assert stage(spark, spark.createDataFrame([], DOCUMENTS), SF_DIR).count() == 0
