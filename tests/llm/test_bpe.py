import hashlib
import json
import random

import pytest
from tokenizers import Tokenizer

from salesmart.llm import bpe
from salesmart.llm.queries import QUERIES, TOKENIZERS, vocabulary
from tests.llm.conftest import EDGE_TEXTS, SF_DIR


@pytest.fixture(scope="module")
def mine():
    with open(vocabulary(TOKENIZERS), encoding="utf-8") as file:
        return bpe.ByteBpe(json.load(file))


@pytest.fixture(scope="module")
def theirs():
    return Tokenizer.from_file(vocabulary(TOKENIZERS))


def test_random_texts_are_encoded_and_decoded_as_by_the_library(mine, theirs):
    rng = random.Random(3)
    parts = ["a", "e", " ", "  ", "\n", "\r\n", "\x85", "\xa0", "é", "漢", "👍", "²", "½", "'s", "'LL", "--", "=====", "\x1c"]
    parts += ["<|endoftext|>", "<|endof", "the", "tion", "ing", "aaaa", "\ufffd", "\u0345", "1234", "_", "A"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 25)))
        ids = theirs.encode(text, add_special_tokens=False).ids
        assert mine.encode(text).tolist() == ids
        assert mine.decode(mine.encode(text)) == theirs.decode(ids, skip_special_tokens=False)


def test_long_words_and_texts(mine, theirs):
    for text in ("a" * 20_000, "ab" * 10_000, "-" * 5_000, " " * 5_000, "the quick brown fox " * 5_000):
        assert mine.encode(text).tolist() == theirs.encode(text, add_special_tokens=False).ids


def test_each_vocabulary_entry_is_its_own_spelling(mine):
    automaton = mine.automaton
    for token in list(automaton.born)[::50]:
        assert automaton.encode_word(automaton.labels[token]) == [token]


def test_the_gadget_forbids_the_merged_pair():
    # bytes a=0 b=1; ab=2; aa=3; aaab=... merges in order
    labels = {0: b"a", 1: b"b", 2: b"ab", 3: b"aa"}
    automaton = bpe.MergeAutomaton(labels, [(0, 1, 2), (0, 0, 3)])
    assert not automaton.has_arc(0, 1)
    assert automaton.has_arc(0, 2)
    assert automaton.has_arc(3, 0)  # aaa is aa a
    assert not automaton.has_arc(0, 3)  # and not a aa
    assert automaton.encode_word(b"aaab") == [3, 2]


def test_operator_on_odd_rows(edge, theirs):
    path = vocabulary(TOKENIZERS)
    found = bpe.decode(bpe.encode(edge, path), path)
    rows = found.select("doc_id", "text", "ids", "decoded").collect()
    assert len(rows) == len(EDGE_TEXTS) + 1
    for row in rows:
        assert row.decoded == (row.text or "")
        assert row.ids == theirs.encode(row.text or "", add_special_tokens=False).ids
    assert bpe.encode(edge.limit(0), path).collect() == []


def test_decode_of_null_and_unknown_ids(spark):
    frame = spark.createDataFrame([([64, None, 999_999, -5, 65],), (None,), ([],)], "ids array<int>")
    decoded = [r.decoded for r in bpe.decode(frame, vocabulary(TOKENIZERS)).collect()]
    assert decoded == ["ab", "", ""]


def test_query_equals_the_library(spark, texts, theirs):
    rows = QUERIES["op1_bpe"](spark, SF_DIR).collect()
    assert len(rows) == len(texts)
    for row in rows:
        ids = theirs.encode(texts[row.doc_id], add_special_tokens=False).ids
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(texts[row.doc_id].encode()).hexdigest()
