import hashlib
import random
from collections import defaultdict
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from salesmart.llm import conversation_trie
from tests.llm.conftest import SF_DIR

TURNS = "conv_id long, turn long, role string, text string"


def conversations(rows):
    """Turns of each conversation; ties stand in any order here, so tests avoid them or make them equal."""
    found = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            found[conv].append(((turn is not None, turn or 0), role or "", text or ""))
    return {c: [t[1:] for t in sorted(turns, key=lambda t: t[0])] for c, turns in found.items()}


def brute(rebuilt):
    members, ends = defaultdict(list), defaultdict(list)
    for conv, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(conv)
        ends[tuple(turns)].append(conv)
    out = []
    for node, convs in members.items():
        below = [n for n in members if n[: len(node)] == node]
        leaves = [n for n in below if not any(len(m) == len(n) + 1 and m[: len(n)] == n for m in members)]
        saved = sum((len(members[n]) - 1) * len(n[-1][1]) for n in below if n)
        listed = ",".join(map(str, sorted(ends[node])))
        out.append(
            (
                min(convs),
                len(node),
                min(members[node[:-1]]) if node else None,
                len(convs),
                sum(len(n) == len(node) + 1 for n in below),
                len(leaves),
                saved,
                hashlib.sha256(listed.encode()).hexdigest(),
            )
        )
    return sorted(out, key=str)


def result(frame):
    return sorted(map(tuple, frame.collect()), key=str)


def test_query_equals_brute_force(spark, result_of):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    whole = conversations(rows)
    rebuilt = {}
    for conv, turns in whole.items():
        h = crc32(str(conv).encode()) % 6
        rebuilt[conv] = whole.get(conv - conv % 100, [])[:h] + turns[h:]
    assert sorted(map(tuple, result_of("op13_conversation_trie")[1]), key=str) == brute(rebuilt)


@pytest.mark.parametrize(("seed", "height"), [(0, 2), (1, 3), (2, 8), (3, 2)])
def test_bands_of_any_height(spark, monkeypatch, seed, height):
    """Deep and shallow conversations that share turns, in bands of bands; hashes summed in short stretches."""
    monkeypatch.setattr(conversation_trie, "STRETCH", 3)
    rng = random.Random(seed)
    rows = []
    for conv in range(-3, 30):
        depth = rng.choice([1, 2, 3, 5, 8, 21])
        for turn in range(depth):
            same = rng.random() < 0.9
            rows.append((conv * 7, turn if turn else None, "u", f"turn {turn}" if same else f"{conv} é" * turn))
    whole = conversations(rows)
    whole[1000] = []
    frame = spark.createDataFrame(rows, TURNS).repartition(5)
    members = spark.createDataFrame([(c,) for c in whole], "conv long")
    found = conversation_trie.trie(conversation_trie.numbered(frame), members, height=height)
    assert result(found) == brute(whole)


def test_grafted_turns(spark):
    rows = [(c, t, "u", f"{c} {t}") for c, n in ((0, 4), (1, 6), (2, 1), (100, 1), (205, 3)) for t in range(n)]
    whole = conversations(rows)
    members = spark.createDataFrame([(c,) for c in whole], "conv long")
    turns = conversation_trie.numbered(spark.createDataFrame(rows, TURNS))
    start = F.col("conv") - F.col("conv") % 100
    found = conversation_trie.trie(conversation_trie.grafted(turns, members, start, F.lit(3)), members)
    rebuilt = {c: whole.get(c - c % 100, [])[:3] + own[3:] for c, own in whole.items()}
    assert rebuilt[205] == [] and len(rebuilt[2]) == 3
    assert result(found) == brute(rebuilt)


def test_many_equal_conversations(spark, conf):
    """All conversations but one are one path, and their ends are hashed in the order of numbers."""
    conf(spark__sql__shuffle__partitions="17", spark__sql__adaptive__coalescePartitions__enabled="false")
    frame = spark.range(3000).select(
        F.col("id").alias("conv_id"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(2).cast("long"))).alias("turn"), F.lit("u").alias("role")
    )
    frame = frame.withColumn("text", F.concat(F.lit("t"), "turn", F.when(F.col("conv_id") == 77, "x").otherwise("")))
    members = frame.select(F.col("conv_id").alias("conv")).distinct()
    rows = result(conversation_trie.trie(conversation_trie.numbered(frame), members))
    assert len(rows) == 7
    listed = ",".join(str(k) for k in range(3000) if k != 77)
    deepest = next(r for r in rows if r[1] == 3 and r[3] > 1)
    assert deepest == (0, 3, 0, 2999, 0, 1, 2998 * 2, hashlib.sha256(listed.encode()).hexdigest())


def test_odd_rows(spark):
    rows = [(1, None, None, None), (1, 0, "", ""), (1, 0, "", ""), (None, 1, "u", "lost"), (2, 5, None, ""), (3, 1, "a", "1:b")]
    frame = spark.createDataFrame(rows, TURNS).withColumn("depth", F.lit("mine")).withColumn("digest", F.lit("mine"))
    members = spark.createDataFrame([(1,), (2,), (3,)], "conv long")
    assert result(conversation_trie.trie(conversation_trie.numbered(frame), members)) == brute(conversations(rows))
    none = conversation_trie.numbered(frame.limit(0))
    assert conversation_trie.trie(none, members.limit(0)).count() == 0
    alone = conversation_trie.trie(none, members).collect()
    assert [(r.conv_id, r.depth, r.n_convs, r.n_leaves, r.saved_tokens) for r in alone] == [(1, 0, 3, 1, 0)]
