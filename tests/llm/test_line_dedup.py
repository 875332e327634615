import hashlib
import random
from collections import defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from salesmart.llm import line_dedup


def brute(rows, least=20, copies=3):
    """``rows`` of (id, text) to (lines, dropped, kept text); a null id is before all others."""
    place = lambda i: (i is not None, i or 0)
    key = lambda line: line.strip(" \t\n\r\x0b\x0c").translate({c: c + 32 for c in range(65, 91)})
    holders = defaultdict(set)
    for i, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= least:
                holders[key(line)].add(place(i))
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(holders[key(x)]) < copies or max(holders[key(x)]) == place(i)]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def result(frame, **rule):
    rows = line_dedup.apply(frame, line_dedup.keep_bitmaps(frame, **rule)).collect()
    return sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept) for r in rows), key=str)


def test_query_equals_brute_force(result_of, texts):
    rows = result_of("op11_line_dedup")[1]
    expected = {i: rest for i, *rest in brute(list(texts.items()))}
    assert len(rows) == len(texts)
    for row in rows:
        n, dropped, kept = expected[row.doc_id]
        assert (row.n_lines, row.n_dropped) == (n, dropped)
        assert row.kept_sha256 == hashlib.sha256(kept.encode()).hexdigest()
    assert any(r.n_dropped for r in rows)


def test_keys_and_their_length(spark):
    short, exact = "x" * 19, "é" * 20
    texts = ["\t" + exact.replace("é", "É") + " \x0b", exact, exact + "\r", short, short, short, "", None]
    texts += [exact + "\x85", exact + "\xa0", "ABCDEFGHIJKLMNOPQRSTU", "abcdefghijklmnopqrstu\n\n", " abcdefghijklmnopqrstu"]
    rows = list(enumerate(texts))
    assert result(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)
    assert sum(r[2] for r in brute(rows)) == 2


@pytest.mark.parametrize("seed", range(2))
def test_a_common_line_over_many_ranges(spark, conf, seed):
    """A line that most documents hold, some of them often, is cut into ranges of documents."""
    conf(spark__sql__adaptive__coalescePartitions__enabled="false", spark__sql__shuffle__partitions="23")
    rng = random.Random(seed)
    lines = ["the line that all documents share"] * 40 + [f"line number {k} of the others" for k in range(40)]
    rows = [(rng.choice([None, *range(60)]), "\n".join(rng.choices(lines, k=rng.randint(0, 9)))) for _ in range(150)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    assert result(frame) == brute(rows)
    assert result(frame, least=30, copies=50) == brute(rows, 30, 50)


@pytest.mark.parametrize("seed", range(4))
def test_stream_in_pieces(seed):
    """Rows of one task in batches of any size, with runs that end in other tasks."""
    rng = random.Random(seed)
    rows = sorted(
        {(rng.randint(0, 5), 0, rng.choice([1, 1, *range(12)]), k, 0) for k in range(rng.randint(1, 120))},
        key=lambda r: (r[0], r[1], -r[2], r[3]),
    )
    names = ["h1", "h2", "doc", "row", "line"]
    kinds = [pa.int64()] * 4 + [pa.int32()]
    cuts = sorted(rng.choices(range(len(rows)), k=3))
    told = []
    # A document's rows of one hash stay together, as ranges of the pair do.
    for start, end in zip([0, *cuts], [*cuts, len(rows)], strict=True):
        while start and start < len(rows) and rows[start - 1][:3] == rows[start][:3]:
            start += 1
        while end < len(rows) and end and rows[end - 1][:3] == rows[end][:3]:
            end += 1
        stream, at = line_dedup._Stream(3), start
        while at < end:
            size = rng.randint(1, 7)
            part = rows[at : min(end, at + size)]
            columns = [pa.array(c, k) for c, k in zip(zip(*part, strict=True), kinds, strict=True)]
            told += [r for t in stream.add(pa.table(columns, names=names)) for r in t.to_pylist()]
            at += len(part)
        told += [r for t in stream.close() for r in t.to_pylist()]
    totals = defaultdict(lambda: [0, -1])
    for r in told:
        if r["kind"] == line_dedup._SUMMARY:
            totals[r["h1"]] = [totals[r["h1"]][0] + r["documents"], max(totals[r["h1"]][1], r["doc"])]
    found = {r["row"] for r in told if r["kind"] == line_dedup._DROPPED}
    late = [r for r in told if r["kind"] == line_dedup._OPEN]
    found |= {r["row"] for r in late if totals[r["h1"]][0] >= 3 and totals[r["h1"]][1] != r["doc"]}
    docs = defaultdict(set)
    for h, _, doc, *_ in rows:
        docs[h].add(doc)
    assert found == {row for h, _, doc, row, _ in rows if len(docs[h]) >= 3 and doc != max(docs[h])}


def test_bitmaps(spark):
    line = "this line is in all three of them"
    rows = [(1, f"a\n{line}\nb"), (2, line), (3, f"{line}\n{line}"), (3, f"{line}\n{line}")]
    maps = line_dedup.keep_bitmaps(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_dropped, line_dedup.kept_lines(r.keep, r.n_lines).tolist()) for r in maps} == {
        1: (1, [True, False, True]),
        2: (1, [False]),
        3: (0, [True, True]),
    }
    assert len(maps) == 3


def test_odd_rows(edge):
    frame = edge.withColumn("n_lines", F.lit("mine"))
    maps = line_dedup.keep_bitmaps(frame, least=4)
    rows = line_dedup.apply(frame, maps).collect()
    assert len(rows) == 9
    assert all(r.n_dropped == 0 and r.kept == (r.text or "") for r in rows)
    assert {r.n_lines for r in rows} == {1, 2}
    assert line_dedup.apply(frame.limit(0), line_dedup.keep_bitmaps(frame.limit(0))).count() == 0
    texts = [(None, "the same line for all"), ("b", "the same line for all"), ("a", "the same line for all\nx")]
    named = frame.sparkSession.createDataFrame(texts, "doc_id string, text string")
    assert result(named) == [("a", 2, 1, "x"), ("b", 1, 0, texts[1][1]), (None, 1, 1, "")]
