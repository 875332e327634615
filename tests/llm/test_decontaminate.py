import hashlib
import re

from salesmart.llm import decontaminate
from salesmart.llm.queries import QUERIES
from tests.llm.conftest import SF_DIR

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(text, items, m):
    """Number of words, hit words and items, by looking at every window."""
    own, hit, found = words(text), set(), set()
    for item, item_text in items:
        theirs = words(item_text)
        size = min(m, len(theirs))
        windows = {tuple(theirs[i : i + size]) for i in range(len(theirs) - size + 1)} if size else set()
        for i in range(len(own) - size + 1):
            if tuple(own[i : i + size]) in windows:
                hit |= set(range(i, i + size))
                found.add(item)
    return len(own), len(hit), sorted(found - {None})


def check(spark, texts, items, m):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    benchmark = spark.createDataFrame(items, "item_id string, text string")
    for row in decontaminate.mark(docs, benchmark, m=m).collect():
        n_hit = sum(s.end - s.start for s in row.hit_spans)
        assert (row.n_words, n_hit, row["items"]) == brute(row.text, items, m), row.text


TEXTS = [None, "", "...", "a", "a b c d e", "A-b.C d; e f g", "a a a a a a a", "x a b x a b c", "é a b c é", "b c d e f " * 3000]
ITEMS = [("1", "a b c d"), ("10", "b c d e f"), ("2", "a"), ("3", None), ("4", "--"), ("5", "a a a"), (None, "f b"), ("6", "a b c d")]


def test_windows_short_items_and_overlaps(spark):
    for m in (1, 2, 3, 10):
        check(spark, TEXTS, ITEMS, m)


def test_blocks_of_the_benchmark_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 8)
    check(spark, TEXTS, ITEMS, 3)


def test_odd_rows_and_empty_tables(spark, edge):
    benchmark = spark.createDataFrame([("q", "text twice over")], "item_id string, text string")
    rows = decontaminate.mark(edge, benchmark, m=3).collect()
    assert len(rows) == 9
    assert {r.doc_id for r in rows if r.hit_spans} == {5, 6}
    assert all(r["items"] == (["q"] if r.hit_spans else []) for r in rows)
    none = decontaminate.mark(edge, benchmark.limit(0), m=3).collect()
    assert [r.hit_spans for r in none] == [[]] * 9
    assert decontaminate.mark(edge.limit(0), benchmark).count() == 0


def test_query_equals_brute_force(spark, texts):
    items = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()]
    rows = QUERIES["op4_decontaminate"](spark, SF_DIR).collect()
    assert len(rows) == len(texts)
    for row in rows:
        n_words, n_hit, found = brute(texts[row.doc_id], items, 10)
        digest = hashlib.sha256(",".join(found).encode()).hexdigest()
        assert (row.n_words, row.n_hit, row.n_items, row.items_sha256) == (n_words, n_hit, len(found), digest)
        assert row.contaminated == (n_hit > 0)
    assert any(r.contaminated for r in rows)


def test_windows_with_one_end_are_told_apart_by_their_beginning():
    """20,000 windows that end alike cost no more than others."""
    windows = {(*(b"w%d" % (k + i) for i in range(8)), b"of", b"the"): [k] for k in range(20_000)}
    search = decontaminate.WuManber(10, windows)
    assert max(len(found) for bucket in search.buckets.values() for found in bucket.values()) == 1
    words = [w for k in (5, 77) for w in (*(b"w%d" % (k + i) for i in range(8)), b"of", b"the")]
    assert list(search.search(words)) == [(0, [5]), (10, [77])]
    two = decontaminate.WuManber(2, {(b"a", b"b"): [0], (b"b", b"b"): [1]})
    assert list(two.search([b"a", b"b", b"b"])) == [(0, [0]), (1, [1])]
