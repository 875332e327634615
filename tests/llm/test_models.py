"""Language, token counts and toxicity."""

import random
import zlib

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer, models

from salesmart.llm import langid, token_counts, toxicity
from salesmart.llm.queries import PIECES, QUERIES, vocabulary
from tests.llm.conftest import SF_DIR

SF_LARGER = "/root/testdata/sf0.01"


def test_language_of_held_out_documents(spark):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF_LARGER}/documents.parquet").select("doc_id", "lang").collect()}
    rows = QUERIES["op8_language"](spark, SF_LARGER).collect()
    assert len(rows) == len(truth)
    for row in rows:
        assert row.held_out == (zlib.crc32(str(row.doc_id).encode()) % 4 == 2)
        assert 0 <= row.score <= 1
        assert row.lang_pred in set(truth.values()) | {"und"}
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) > 0.95


def test_language_of_odd_rows(spark, edge):
    contents = {"en": b"the same text twice over here and there", "de": b"der gleiche Text zweimal hier und da"}
    rows = {(r.doc_id, r.text): r for r in langid.identify(edge, contents).collect()}
    assert {r.lang_pred for r in rows.values() if not (r.text or "").strip()} == {"und"}
    assert rows[5, "same text twice over here"].lang_pred == "en"
    assert not rows[5, "same text twice over here"].rejected
    assert langid.identify(edge.limit(0), contents).count() == 0
    assert {r.lang_pred for r in langid.identify(edge, {}).collect()} == {"und"}
    assert langid.learn_dictionaries(edge.limit(0)) == {}
    learned = langid.learn_dictionaries(edge)
    assert set(learned) == {"en"}
    numbers = spark.createDataFrame([(1, "123 !? 4")], "doc_id long, text string")
    assert langid.identify(numbers, contents).first().lang_pred == "und"


def test_learned_dictionaries_do_not_depend_on_partitions(docs):
    one = langid.learn_dictionaries(docs.repartition(7), size=4096)
    assert one == langid.learn_dictionaries(docs.coalesce(1), size=4096)
    assert all(len(x) <= 4096 + 64 * 64 for x in one.values())


def test_copies_do_not_thin_the_dictionaries(spark):
    """Half a million bytes of distinct texts, and many more of one that is copied."""
    rng = random.Random(5)
    rows = [("en", f"{rng.getrandbits(8000):x}") for _ in range(250)] + [("en", "copy " * 800)] * 12_000
    learned = langid.learn_dictionaries(spark.createDataFrame(rows, "lang string, text string").repartition(4))
    assert len(learned["en"]) >= 96 << 10


def test_all_parts_of_a_text_teach(spark):
    rows = [("en", "a" * 4000 + "the end"), ("de", "kurz"), ("de", "b")]
    learned = langid.learn_dictionaries(spark.createDataFrame(rows, "lang string, text string"))
    assert b"the end" in learned["en"]
    assert list(learned) == ["en", "de"]
    tiny = [("en", f"{i}") for i in range(2000)]
    learned = langid.learn_dictionaries(spark.createDataFrame(tiny, "lang string, text string"), size=4000)
    assert len(learned["en"].replace(b"\n", b"")) == 4000


def test_copies_do_not_thin_the_labelled_texts(spark, monkeypatch):
    rows = [(f"text {i}", i % 2) for i in range(1500)] + [("copy", 0)] * 30_000
    taken = []
    monkeypatch.setattr(toxicity, "train", lambda texts, labels, settings: taken.append(len(set(zip(texts, labels, strict=True)))))
    toxicity.learn(spark.createDataFrame(rows, "text string, label int").repartition(4), rows=1000)
    assert taken == [1000]


@pytest.fixture(scope="module")
def pieces():
    return token_counts.sentencepiece_vocabulary(vocabulary(PIECES))


def library_count(tokenizer, text):
    coded = tokenizer.encode(text)
    return sum(len(t.encode()) if i == 0 else 1 for t, i in zip(coded.tokens, coded.ids, strict=True))


def test_counts_equal_the_library(texts, pieces):
    model = token_counts.Unigram(pieces)
    library = Tokenizer(models.Unigram([("<unk>", 0.0), *pieces], unk_id=0, byte_fallback=False))
    for text in texts.values():
        marked = "▁" + text.replace(" ", "▁")
        assert model.count(marked) == model.best(marked)
        assert model.count(marked)[0] == library_count(library, marked)


def test_ties_and_unknown_characters_equal_the_library():
    rng = random.Random(11)
    for _ in range(60):
        chosen = {"a", "b"} | {"".join(rng.choice("abc") for _ in range(rng.randint(1, 4))) for _ in range(8)}
        vocabulary_ = [(p, -float(rng.randint(1, 4))) for p in sorted(chosen)]
        library = Tokenizer(models.Unigram([("<unk>", 0.0), *vocabulary_], unk_id=0, byte_fallback=False))
        single = token_counts.Unigram(vocabulary_, bytes_for_unknown=False)
        for _ in range(40):
            text = "".join(rng.choice("aabbcé") for _ in range(rng.randint(1, 12)))
            assert single.best(text)[0] == len(library.encode(text).ids), (vocabulary_, text)


def test_token_counts_of_odd_rows(edge, pieces):
    rows = token_counts.token_counts(edge, pieces).collect()
    assert len(rows) == 9
    assert [(r.n_tokens, r.score) for r in rows if not r.text] == [(0, 0.0)] * 2
    assert next(r for r in rows if r.doc_id == 4).n_tokens > 40_000
    assert token_counts.token_counts(edge.limit(0), pieces).count() == 0
    with pytest.raises(ValueError):
        token_counts.Unigram([])


def test_query_of_token_counts(spark, texts, pieces):
    model = token_counts.Unigram(pieces)
    rows = QUERIES["op9_token_counts"](spark, SF_DIR).collect()
    assert {r.doc_id: (r.n_tokens, r.score) for r in rows} == {
        k: model.best("▁" + t.replace(" ", "▁")) for k, t in texts.items()
    }


def test_toxicity_of_held_out_documents(spark):
    folder = "/root/testdata/sf0.1"
    rows = QUERIES["op10_toxicity"](spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id")
    held = rows.where("held_out").groupBy("toxic").agg(F.avg("predicted").alias("p")).collect()
    share = {r.toxic: r.p for r in held}
    assert share[1] > 0.75
    assert share[0] < 0.02


def test_a_misspelling_is_found():
    rng = random.Random(2)
    filler = [f"{a}{b}{c}" for a in "bdfg" for b in ("ar", "el", "in") for c in ("to", "ma", "lu")]
    texts = [" ".join(rng.choice(filler) for _ in range(30)) for _ in range(300)]
    labels = [k % 5 == 0 for k in range(300)]
    texts = [t + (" disgusting" if y else "") for t, y in zip(texts, labels, strict=True)]
    model = toxicity.train(texts, labels)
    assert (model.embeddings == toxicity.train(texts, labels).embeddings).all()

    def logit(word):
        value, n = model.word_parts(word)
        return value / n

    assert min(logit("disgusting"), logit("disgustingg"), logit("disgustng")) > max(map(logit, filler))


def test_toxicity_of_odd_rows(spark, edge):
    model = toxicity.train(["bad word", "good word"] * 20, [1, 0] * 20)
    rows = toxicity.score(edge, model).collect()
    assert len(rows) == 9
    assert all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if not (r.text or "").strip()}) == 1
    assert toxicity.score(edge.limit(0), model).count() == 0
    labelled = edge.withColumn("label", F.lit(1))
    empty = toxicity.learn(labelled.limit(0))
    assert toxicity.score(edge, empty).where("score > 0.5").count() == 0
    assert toxicity.learn(labelled).weights.shape == (8, 2)
    few = toxicity.learn(labelled, rows=1)
    assert few.weights.shape == (8, 2)
