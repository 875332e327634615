import hashlib
import random
from collections import Counter

import pytest

from pyspark.sql import functions as F

from salesmart.llm import exchange, suffix_dedup
from salesmart.llm.queries import QUERIES
from tests.llm.conftest import SF_DIR


def brute(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = [False] * len(d)
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        spans, start = [], None
        for i, g in enumerate([*gone, False]):
            if g and start is None:
                start = i
            if not g and start is not None:
                spans.append((start, i))
                start = None
        out.append((len(d), spans, bytes(b for b, g in zip(d, gone, strict=True) if not g)))
    return out


def test_covers_hold_all_differences():
    for v, residues in suffix_dedup.COVERS.values():
        assert suffix_dedup.is_cover(v, residues)
    assert not suffix_dedup.is_cover(7, (0, 1))


@pytest.mark.parametrize("length", [183, 200, 400])
def test_repeats_at_all_offsets(spark, length):
    """Passages around the length, overlapping, adjacent, at other offsets, and inside one text."""
    rng = random.Random(length)
    letters = "abcdé "

    def noise(n):
        return "".join(rng.choice(letters) for _ in range(n))

    passage = noise(3 * length)
    texts = [None, "", "x" * (length - 1), "x" * length, "x" * (length + 7), "xy" * length, "xy" * length]
    for k in (0, 1, 5, 90, 91, 133):
        cut = passage[k : k + length + rng.choice([-60, -1, 0, 1, 40, 150])]
        texts.append(noise(rng.randint(0, 300)) + cut + noise(rng.randint(0, 300)))
    twice = passage[: length + 20]
    texts += [twice + noise(50) + twice, passage + passage[length // 2 :], noise(2 * length)]
    rows = list(enumerate(texts))
    frame = spark.createDataFrame([*rows, rows[-1]], "doc_id long, text string")
    found = suffix_dedup.remove_repeats(frame, length=length).collect()
    expected = brute([t for _, t in [*rows, rows[-1]]], length)
    by_id = {i: e for (i, _), e in zip([*rows, rows[-1]], expected, strict=True)}
    assert len(found) == len(rows) + 1
    for row in found:
        assert (row.n_bytes, [(s.start, s.end) for s in row.removed], bytes(row.kept)) == by_id[row.doc_id]
    assert any(0 < sum(e - s for s, e in x[1]) < x[0] for x in expected)


def test_odd_rows(edge):
    rows = suffix_dedup.remove_repeats(edge).collect()
    assert len(rows) == 9
    long = next(r for r in rows if r.doc_id == 4)
    assert [(s.start, s.end) for s in long.removed] == [(0, long.n_bytes)]
    assert all(not r.removed and bytes(r.kept) == (r.text or "").encode() for r in rows if r.doc_id != 4)
    assert suffix_dedup.remove_repeats(edge.limit(0)).count() == 0
    with pytest.raises(ValueError):
        suffix_dedup.remove_repeats(edge, length=100)


@pytest.mark.parametrize("copied", ["copy " * 600, None])
def test_copies_of_a_third_of_all_rows_do_not_share_a_chunk(spark, copied):
    """Equal rows, of a long text or of none."""
    rows = [(0, copied)] * 4000 + [(i, f"{i} " * 600) for i in range(10_001, 18_001)]
    rows = spark.createDataFrame(rows, "doc_id long, text string")
    dealt = exchange.dealt(rows, None, "text", 12).groupBy("__chunk").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("doc_id") == 0).alias("copies")
    ).collect()
    assert sum(r.n for r in dealt) == 12_000
    if copied:
        assert max(r.copies for r in dealt) < 1000
    many = rows.where("doc_id = 0")
    assert exchange.layout(many, "text", 0.1, 2000).chunks > 1
    assert max(r["count"] for r in exchange.dealt(many, None, "text", 12).groupBy("__chunk").count().collect()) < 1000


def test_copies_in_several_chunks_lose_all_their_bytes(spark):
    copied = "some copy " * 100
    rng = random.Random(3)
    rows = [(0, copied)] * 9000 + [(i, f"{rng.getrandbits(4000):x}") for i in range(1, 2001)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert exchange.layout(frame, "text", 0.1, exchange.ROW_BYTES).chunks > 1
    found = suffix_dedup.remove_repeats(frame).collect()
    assert len(found) == 11_000
    for row in found:
        expected = [] if row.doc_id else [(0, len(copied))]
        assert [(s.start, s.end) for s in row.removed] == expected


def test_query_tells_which_documents_repeat_a_passage(spark, tmp_path):
    """Over several chunks; passages of over 50 words that are shorter than 400 bytes stay."""
    rng = random.Random(6)

    def words(n):
        return " ".join(f"{rng.getrandbits(20):05x}" for _ in range(n))

    passages = {0: words(70), 5: words(60)}
    assert len(passages[0]) > 400 > len(passages[5]) + 40
    rows = [(i, " ".join([words(150), passages.get(i % 10, words(10)), words(150)])) for i in range(3000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    assert exchange.layout(frame, "text", 0.1, exchange.ROW_BYTES).chunks > 1
    found = QUERIES["op6_suffix_dedup"](spark, str(tmp_path)).collect()
    assert len(found) == 3000
    for row in found:
        assert row.repeated == (row.doc_id % 10 == 0)
        assert row.n_removed >= len(passages[0]) if row.repeated else row.n_removed == 0


def test_query_equals_brute_force(spark, texts):
    rows = {r.doc_id: r for r in QUERIES["op6_suffix_dedup"](spark, SF_DIR).collect()}
    assert len(rows) == len(texts)
    for key, (size, spans, kept) in zip(texts, brute(texts.values(), 400), strict=True):
        row = rows[key]
        assert (row.n_bytes, row.n_removed, row.n_spans) == (size, size - len(kept), len(spans))
        assert row.kept_sha256 == hashlib.sha256(kept).hexdigest()
