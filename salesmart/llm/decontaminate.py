"""Find passages of benchmark items in documents by Wu-Manber search over words.

All windows of a search have the same number of words m. SHIFT tells for the last BLOCK words of a
position how far the search may jump before a window can end there; 0 means that one may end here.
Then the hash of these words names the bucket of windows with that end, that of the first words the windows in it
with that beginning, and their words are compared directly. Items shorter than a window are searched with others of their length.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from salesmart.llm.batches import with_columns
from salesmart.llm.steps import settled

#: Bytes of benchmark texts that one pass over the documents searches for, and that are broadcast.
BLOCK_BYTES = 16 << 20

#: Bytes to words: A-Z to lower case, all that is not a digit, a letter or above 0x7F to a space.
_WORDS = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32
    for b in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "replace").translate(_WORDS).split() if text else []


class WuManber:
    """Windows of ``m`` words each; ``windows`` maps a window to the items that have it."""

    def __init__(self, m: int, windows: dict[tuple[bytes, ...], list[int]]):
        self.m = m
        self.block = block = min(2, m)
        self.default = m - block + 1
        self.shift: dict[tuple[bytes, ...], int] = {}
        Bucket = dict[tuple[bytes, ...], list[tuple[tuple[bytes, ...], list[int]]]]
        self.buckets: dict[tuple[bytes, ...], Bucket] = defaultdict(dict)
        for window, items in windows.items():
            for end in range(block, m + 1):
                key = window[end - block : end]
                self.shift[key] = min(self.shift.get(key, self.default), m - end)
            self.buckets[window[m - block :]].setdefault(window[:block], []).append((window, items))

    def search(self, words: Sequence[bytes]) -> Iterator[tuple[int, list[int]]]:
        """Start of each occurrence, and the items of its window."""
        m, default, get, buckets = self.m, self.default, self.shift.get, self.buckets
        end, n = m, len(words)
        if self.block == 1:
            while end <= n:
                jump = get((words[end - 1],), default)
                if jump:
                    end += jump
                    continue
                word = (words[end - 1],)
                yield end - 1, buckets[word][word][0][1]
                end += 1
            return
        while end <= n:
            jump = get((words[end - 2], words[end - 1]), default)
            if jump:
                end += jump
                continue
            begun = buckets[words[end - 2], words[end - 1]].get((words[end - m], words[end - m + 1]))
            if begun:
                found = tuple(words[end - m : end])
                for window, items in begun:
                    if window == found:
                        yield end - m, items
            end += 1


class Searcher:
    """``items``: (id, text); ``m``: words of a window."""

    def __init__(self, items: Iterable[tuple[str | None, str | None]], m: int):
        self.ids: list[str | None] = []
        windows: dict[int, dict[tuple[bytes, ...], list[int]]] = defaultdict(dict)
        for item_id, text in items:
            words = words_of(text)
            if not words:
                continue
            at = len(self.ids)
            self.ids.append(item_id)
            size = min(m, len(words))
            for window in {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}:
                windows[size].setdefault(window, []).append(at)
        self.searches = [WuManber(size, found) for size, found in sorted(windows.items())]

    def find(self, text: str | None) -> tuple[int, list[tuple[int, int]], list[str]]:
        """Number of words, the hit spans of words (joined, end exclusive) and the items."""
        words = words_of(text)
        spans: list[tuple[int, int]] = []
        items: set[int] = set()
        for search in self.searches:
            for start, found in search.search(words):
                spans.append((start, start + search.m))
                items.update(found)
        return len(words), joined(spans), sorted({self.ids[i] for i in items} - {None})


def joined(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def _blocks(benchmark: DataFrame, item_id: str, text: str) -> Iterator[list[tuple[str | None, str | None]]]:
    """The items in blocks of bounded size, one of them on the driver at a time."""
    rows = benchmark.select(F.col(item_id).cast("string").alias("id"), F.col(text).alias("text"))
    held: list[tuple[str | None, str | None]] = []
    size = 0
    for row in rows.where(F.length("text") > 0).distinct().toLocalIterator():
        length = len(row["text"].encode())
        if held and size + length > BLOCK_BYTES:
            yield held
            held, size = [], 0
        held.append((row["id"], row["text"]))
        size += length
    if held:
        yield held


_SPANS = T.ArrayType(
    T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
)


def mark(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    m: int = 10,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """``docs`` with ``n_words``, ``hit_spans`` (spans of words within an occurrence) and ``items``.

    A window is ``m`` words in a row of an item, or all words of a shorter one. Items without words
    have none, and items with a null id mark words but are not listed. ``items`` are the distinct ids
    as strings, sorted. Null and empty texts have no words. Repeated rows stay, other columns pass
    through, columns called as the new ones are replaced. The benchmark is searched in blocks of
    ``BLOCK_BYTES``, each on a pass of the documents that is written before the next, so what is broadcast has a bound.
    """
    added = T.StructType(
        [
            T.StructField("n_words", T.LongType()),
            T.StructField("hit_spans", _SPANS),
            T.StructField("items", T.ArrayType(T.StringType())),
        ]
    )
    marked, last = None, None
    for items in _blocks(benchmark, item_id, item_text):
        if last is not None:
            marked = settled(marked, "marked")
            last.unpersist()
        last = docs.sparkSession.sparkContext.broadcast((items, m))
        marked = _mark_block(docs, last, text, added) if marked is None else _merge(marked, last, text)
    if marked is None:
        marked = _mark_block(docs, docs.sparkSession.sparkContext.broadcast(([], m)), text, added)
    return marked


def _mark_block(docs: DataFrame, shared: Broadcast, text: str, added: T.StructType) -> DataFrame:
    def setup():
        searcher = Searcher(*shared.value)

        def compute(texts: pa.Array) -> list[pa.Array]:
            found = [searcher.find(t) for t in texts.to_pylist()]
            spans = [[{"start": s, "end": e} for s, e in f[1]] for f in found]
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            return [
                pa.array([f[0] for f in found], pa.int64()),
                pa.array(spans, kind),
                pa.array([f[2] for f in found], pa.list_(pa.string())),
            ]

        return compute

    return with_columns(docs, text, added, setup)


def _merge(marked: DataFrame, shared: Broadcast, text: str) -> DataFrame:
    """Add the hits of a further block to those found before; spans that meet are joined."""
    before = [c for c in marked.columns if c not in ("n_words", "hit_spans", "items")]
    kept = marked.withColumnsRenamed({"hit_spans": "__spans", "items": "__items"})
    added = T.StructType(
        [
            T.StructField("n_words", T.LongType()),
            T.StructField("hit_spans", _SPANS),
            T.StructField("items", T.ArrayType(T.StringType())),
        ]
    )
    found = _mark_block(kept, shared, text, added)
    both = F.array_sort(F.concat("__spans", "hit_spans"))

    def join(done, span):
        last = F.element_at(done, -1)
        meets = (F.size(done) > 0) & (span["start"] <= F.get(done, F.size(done) - 1)["end"])
        longer = F.struct(last["start"].alias("start"), F.greatest(last["end"], span["end"]).alias("end"))
        return F.when(meets, F.concat(F.slice(done, 1, F.size(done) - 1), F.array(longer))).otherwise(
            F.concat(done, F.array(span))
        )

    empty = F.array().cast("array<struct<start:bigint,end:bigint>>")
    return found.select(
        *(F.col("`" + c.replace("`", "``") + "`") for c in before),
        "n_words",
        F.aggregate(both, empty, join).alias("hit_spans"),
        F.array_sort(F.array_distinct(F.concat("__items", "items"))).alias("items"),
    )


def digest(items: Sequence[str]) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()
