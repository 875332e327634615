import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from salesmart.llm import ngram_join
from salesmart.llm.components import components
from salesmart.llm.queries import QUERIES
from tests.llm.conftest import SF_DIR


def sets_of(texts, words):
    sets = {}
    for key, text in texts.items():
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        found = re.findall("[^\x20\x09-\x0d]+", lower)
        sets[key] = frozenset(tuple(found[i : i + words]) for i in range(max(1, len(found) - words + 1))) if found else frozenset()
    return sets


def brute(texts, rule):
    """Set size and least connected key of each document, by comparing all pairs that share anything."""
    sets, parent = sets_of(texts, rule.words), {k: k for k in texts}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    lists = defaultdict(list)
    for key, own in sets.items():
        shared = Counter(other for gram in own for other in lists[gram])
        for other, n in shared.items():
            if rule.den * n >= rule.num * (len(own) + len(sets[other]) - n):
                a, b = root(key), root(other)
                parent[max(a, b)] = min(a, b)
        for gram in own:
            lists[gram].append(key)
    return {k: (len(sets[k]), root(k)) for k in texts}


def found(frame, rule):
    rows = ngram_join.join(frame, rule).select("doc_id", "n_shingles", "component_id").collect()
    return {r.doc_id: (r.n_shingles, r.component_id) for r in rows}


def test_query_equals_brute_force(spark, texts):
    rows = QUERIES["op2_ngram_join"](spark, SF_DIR).collect()
    rule = ngram_join.Rule(4, 85, 100)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == brute(texts, rule)
    assert len(rows) == len(texts)


@pytest.mark.parametrize("words, num", [(2, 80), (1, 50), (5, 80)])
def test_chains_stars_and_common_passages(spark, words, num):
    """Near copies of an original, chains of changes, and unlike texts around one common passage."""
    rng = random.Random(words)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = " ".join(rng.choice(vocabulary) for _ in range(25))
    texts = {}
    for group in range(6):
        base = [rng.choice(vocabulary) for _ in range(60)]
        for _ in range(12):
            copy = list(base)
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(60)] = rng.choice(vocabulary)
            texts[len(texts)] = " ".join(copy)
            if group % 2:
                base = copy  # a chain: the ends differ more than their neighbours
    for _ in range(30):
        texts[len(texts)] = passage + " " + " ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 12)))
    rule = ngram_join.Rule(words, num, 100)
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    expected = brute(texts, rule)
    assert found(frame, rule) == expected
    assert len({c for _, c in expected.values()}) < len(texts)


def test_odd_rows(edge):
    rule = ngram_join.Rule(3, 80, 100)
    rows = ngram_join.join(edge, rule).collect()
    assert len(rows) == 9
    by = {(r.doc_id, r.text): (r.n_shingles, r.component_id) for r in rows}
    assert by[None, None] == (0, None)
    assert by[1, ""] == (0, 1)
    assert by[2, " \n\t "] == (0, 2)
    assert by[3, "x"] == (1, 3)
    assert by[5, "same text twice over here"] == by[6, "same text twice over here"] == (3, 5)
    assert ngram_join.join(edge.limit(0), rule).count() == 0


def test_divide_skip_counts_as_a_plain_count():
    rng = random.Random(5)
    for _ in range(200):
        lists = {k: sorted(rng.sample(range(40), rng.randint(1, 40))) for k in range(rng.randint(1, 30))}
        query = rng.sample(range(40), 20)
        least = rng.randint(1, 15)
        plain = Counter(d for k in query if k in lists for d in lists[k])
        assert ngram_join.divide_skip(query, lists, least) == {d: n for d, n in plain.items() if n >= least}


def test_components_of_paths_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(7, i) for i in range(8, 60)] + [(3, 3), (None, 5), (200, 201), (201, 200)]
    frame = spark.createDataFrame(edges, "a long, b long")
    labels = {r.node: r.component for r in components(frame).collect()}
    assert labels == {i: 100 for i in range(100, 141)} | {i: 7 for i in range(7, 60)} | {200: 200, 201: 200}
    assert components(frame.where(F.lit(False))).count() == 0
