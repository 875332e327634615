import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from salesmart.llm import collocations
from salesmart.llm.exchange import pack


def brute(docs, least, limit=2000):
    """``docs`` of (text, lang) to the rows of the query."""
    counts, totals = {}, Counter()
    for text, lang in docs:
        lang = "und" if lang is None else lang
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", lowered):
            words = re.findall("[^ \t]+", piece)
            totals[lang] += len(words)
            own = counts.setdefault(lang, Counter())
            for k in range(1, 5):
                own.update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    rows = []
    for lang, own in counts.items():
        found = {p: a for p, a in own.items() if a >= least and len(p) > 1}
        covered = Counter()
        for p, a in found.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    covered[p[i : i + m]] = max(covered[p[i : i + m]], a)
        scored = []
        for p, a in found.items():
            if covered[p] and 100 * covered[p] >= 80 * a:
                continue
            cuts = [(2_000_000 * a // (own[p[:k]] + own[p[k:]]), k, own[p[:k]], own[p[k:]]) for k in range(1, len(p))]
            score, _, left, right = min(cuts)
            scored.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(scored)[:limit], 1):
            rows.append((lang, rank, phrase.decode(), -a, left, right, totals[lang], -score))
    return sorted(rows)


def result(frame):
    return sorted(map(tuple, frame.collect()))


def noise(rng, n, words="the a of b is c É ABC x\xa0y ﬁ and".split(" ")):
    return "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t", "  ", ". ", ",", "\n", "\r\n"]) for _ in range(n))


def test_query_equals_brute_force(result_of, docs):
    rows = [(r.text, r.lang) for r in docs.collect()]
    found = sorted(map(tuple, result_of("op12_collocations")[1]))
    assert found == brute(rows, 30)
    assert len(found) > 10


@pytest.mark.parametrize(("seed", "size"), [(0, 5), (1, 64), (2, 1 << 19)])
def test_blocks_of_any_size(spark, monkeypatch, seed, size):
    """Pieces are cut between blocks, and tiles summed in several groups."""
    monkeypatch.setattr(collocations, "GROUP_BYTES", 1 << (9 + seed))
    rng = random.Random(seed)
    docs = [(noise(rng, rng.choice([0, 3, 40, 300])), rng.choice([None, "und", "en", "de"])) for _ in range(25)]
    docs += [("word " * 500, "en"), (None, "en"), ("", None), docs[0]]
    frame = spark.createDataFrame(docs, "text string, lang string").repartition(3)
    found = collocations.collocations(frame, least=3, block_words=size)
    assert result(collocations.top(found, 2000)) == brute(docs, 3)


def test_counts_beyond_a_line_of_a_single_piece(spark):
    """A piece without an end over many blocks loses no phrase."""
    text = " ".join(f"w{k % 7} v{k % 3}" for k in range(400))
    frame = spark.createDataFrame([(text, "x")], "text string, lang string")
    for size in (3,):
        assert result(collocations.top(collocations.collocations(frame, least=2, block_words=size))) == brute([(text, "x")], 2)


@pytest.mark.parametrize("parts", [1, 7])
def test_tiles_hold_all_pairs(parts):
    rng = np.random.default_rng(parts)
    a = np.concatenate([rng.integers(0, n, 4000) for n in (50, 3000, 20_000, 1 << 22, 1 << 32)]).astype(np.uint64)
    keys = np.unique((a << np.uint64(32)) | rng.permutation(a))
    tiles = collocations.tile_of(keys, parts)
    square = tiles < collocations.BANDS**2
    assert square.any() and not square.all()
    for tile in [*np.unique(tiles[square])[:20], *np.unique(tiles[~square])[:20]]:
        own = keys[tiles == tile]
        half = own[::2]
        packed = [(pack(own), collocations._numbers(np.arange(len(own)) + 1)), (pack(half), collocations._numbers(np.ones(len(half))))]
        found, counts = collocations.sum_tile(int(tile), iter(packed))
        expected = np.arange(len(own)) + 1
        expected[::2] += 1
        assert (found == own).all() and (counts == expected).all()


def test_scores_are_exact(spark):
    """Products beyond 64 bits, and equal scores of two cuts."""
    rows = [("x", 1, "a b c", 9 * 10**15, [10**16 + 1, 9 * 10**15, 9 * 10**15], [10**16 + 1, 9 * 10**15, 9 * 10**15])]
    known = spark.createDataFrame(rows, "lang string, id long, phrase string, n long, heads array<long>, tails array<long>")
    row = collocations._scored(known, 3).first()
    assert row.score == 2_000_000 * 9 * 10**15 // (19 * 10**15 + 1)
    assert (row.l, row.r) == (10**16 + 1, 9 * 10**15)


def test_odd_rows(spark, edge):
    found = result(collocations.top(collocations.collocations(edge, least=2)))
    assert found == brute([(r.text, r.lang) for r in edge.collect()], 2)
    assert collocations.collocations(edge.limit(0)).count() == 0
    assert collocations.collocations(edge.withColumn("text", F.lit(None).cast("string"))).count() == 0
    with pytest.raises(ValueError):
        collocations.collocations(edge, least=0)
