"""Drop lines that many documents share, except in the last document that holds them.

1. Each text is split; a line of some length becomes a 128-bit hash of its key. The hashes are
   written once, with a number for each row, so what follows never reads the texts again.
2. The hashes are sorted over all tasks by (hash, document descending): ranges of the pair, so a line
   that a third of all documents share is cut into as many ranges as its documents need.
3. Each task streams its sorted range. The first document of a hash is the one that keeps its lines; from
   the third one on, every other line of the hash is dropped. A hash at an end of a range may go on in
   the next one: its open lines are passed on with a summary, of which there are two for each task.
4. The dropped lines of a document become a compressed bitmap of what it keeps. Texts are needed
   again only to apply it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from salesmart.llm.batches import slices
from salesmart.llm.steps import column, settled

#: Rows of the sorted stream that are looked at together.
STREAM_ROWS = 1 << 16
#: Bytes of UTF-8 that go on with a character.
_GOING_ON = bytes(range(0x80, 0xC0))
_DROPPED, _OPEN, _SUMMARY = 0, 1, 2


def line_key(line: bytes) -> bytes:
    """ASCII whitespace stripped at both ends, A-Z in lower case."""
    return line.strip().lower()


def _long_enough(key: bytes, least: int) -> bool:
    if len(key) >= 4 * least:
        return True
    return len(key) >= least and len(key.translate(None, _GOING_ON)) >= least


def _hashed(docs: DataFrame, text: str, key: str, least: int) -> DataFrame:
    """A row for each row of ``docs``: its number, id, text digest, lines, and hashes of its keys."""
    kind = docs.schema[key].dataType
    schema = T.StructType(
        [
            T.StructField("row", T.LongType()),
            T.StructField("doc", kind),
            T.StructField("digest", T.StringType()),
            T.StructField("n_lines", T.LongType()),
            T.StructField("h1", T.ArrayType(T.LongType())),
            T.StructField("h2", T.ArrayType(T.LongType())),
            T.StructField("line", T.ArrayType(T.IntegerType())),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        for batch in batches:
            for part in slices(batch, "text"):
                counts, digests, places, ends = [], [], [], [0]
                for value in part.column("text").cast(pa.binary()).to_pylist():
                    lines = (value or b"").split(b"\n")
                    counts.append(len(lines))
                    for at, line in enumerate(lines):
                        found = line.strip().lower()
                        if _long_enough(found, least):
                            digests.append(xxhash.xxh3_128_digest(found))
                            places.append(at)
                    ends.append(len(places))
                halves = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
                offsets = pa.array(ends, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.arange(number, number + part.num_rows)),
                        part.column("doc"),
                        part.column("digest"),
                        pa.array(counts, pa.int64()),
                        pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(halves[:, 0]))),
                        pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(halves[:, 1]))),
                        pa.ListArray.from_arrays(offsets, pa.array(places, pa.int32())),
                    ],
                    names=[f.name for f in schema],
                )
                number += part.num_rows

    given = docs.select(column(key).alias("doc"), column(text).alias("text"), text_digest(column(text)).alias("digest"))
    return given.mapInArrow(run, schema)


def text_digest(text):
    """What names a text beside its id, in case an id has several."""
    return F.md5(F.coalesce(text, F.lit("")))


@dataclass
class _Stream:
    """Verdicts over rows sorted by (hash, document descending); nothing is held but an undecided hash."""

    copies: int
    hash: tuple[int, int] | None = None  # of the open run, if it is the first or already decided
    first: bool = False
    documents: int = 0
    top: pa.Scalar | None = None
    last: pa.Scalar | None = None
    held: list[pa.Table] = field(default_factory=list)
    begun: bool = False

    def add(self, rows: pa.Table) -> Iterator[pa.Table]:
        if not self.begun:
            self.begun = True
            self.hash = (rows["h1"][0].as_py(), rows["h2"][0].as_py())
            self.first, self.top, self.last, self.documents = True, rows["doc"][0], rows["doc"][0], 1
        if self.hash is not None:
            same = (rows["h1"].to_numpy() == self.hash[0]) & (rows["h2"].to_numpy() == self.hash[1])
            n = len(same) if same.all() else int(np.argmin(same))
            if n:
                own = rows.slice(0, n)
                self.documents += int(_changes(own["doc"], self.last).sum())
                self.last = own["doc"][n - 1]
                yield _told(own, _OPEN if self.first else _DROPPED)
                rows = rows.slice(n)
            if not rows.num_rows:
                return
            if self.first:
                yield self._summary()
            self.hash, self.first = None, False
        rows = pa.concat_tables([*self.held, rows])
        self.held = []
        h1, h2 = rows["h1"].to_numpy(), rows["h2"].to_numpy()
        new_run = np.ones(len(h1), bool)
        new_run[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        new_doc = _changes(rows["doc"], None) | new_run
        starts = np.flatnonzero(new_run)
        run = np.cumsum(new_run) - 1
        place = np.cumsum(new_doc) - 1
        place -= place[starts][run]
        documents = np.maximum.reduceat(place, starts) + 1
        dropped = (place > 0) & (documents[run] >= self.copies)
        if dropped.any():
            yield _told(rows.filter(pa.array(dropped)), _DROPPED)
        begin = int(starts[-1])
        if documents[-1] >= self.copies:
            self.hash = (int(h1[begin]), int(h2[begin]))
            self.documents, self.top, self.last = int(documents[-1]), rows["doc"][begin], rows["doc"][len(h1) - 1]
        else:
            self.held = [rows.slice(begin)]

    def close(self) -> Iterator[pa.Table]:
        if self.held:
            rows = pa.concat_tables(self.held)
            self.hash = (rows["h1"][0].as_py(), rows["h2"][0].as_py())
            self.documents = 1 + int(_changes(rows["doc"], rows["doc"][0]).sum())
            self.top = rows["doc"][0]
            yield _told(rows, _OPEN)
        if self.hash is not None:
            yield self._summary()

    def _summary(self) -> pa.Table:
        one = {
            "h1": pa.array([self.hash[0]], pa.int64()),
            "h2": pa.array([self.hash[1]], pa.int64()),
            "doc": pa.array([self.top.as_py()], self.top.type),
            "row": pa.array([0], pa.int64()),
            "line": pa.array([0], pa.int32()),
        }
        return _told(pa.table(one), _SUMMARY, self.documents)


def _changes(docs: pa.ChunkedArray, before: pa.Scalar | None) -> np.ndarray:
    """Where a document differs from the one before it; nulls are equal to one another."""
    values = docs.combine_chunks()
    out = np.zeros(len(values), bool)
    null = values.is_null().to_numpy(zero_copy_only=False)
    differ = pc.fill_null(pc.not_equal(values[1:], values[:-1]), False).to_numpy(zero_copy_only=False)
    out[1:] = differ | (null[1:] != null[:-1])
    if before is not None:
        out[0] = values[0].as_py() != before.as_py()
    return out


def _told(rows: pa.Table, kind: int, documents: int = 0) -> pa.Table:
    n = rows.num_rows
    columns = [rows[c] for c in ("h1", "h2", "doc", "row", "line")]
    return pa.table(
        [pa.array(np.full(n, kind, np.int32)), *columns, pa.array(np.full(n, documents, np.int64))],
        names=["kind", "h1", "h2", "doc", "row", "line", "documents"],
    )


def _dropped(hashed: DataFrame, copies: int) -> DataFrame:
    """``(row, line)`` of the dropped lines."""
    lines = hashed.select("row", "doc", F.inline(F.arrays_zip("h1", "h2", "line")))
    order = [F.col("h1"), F.col("h2"), F.col("doc").desc_nulls_last()]
    ranged = lines.repartitionByRange(*order).sortWithinPartitions(*order, "row", "line")
    kind = hashed.schema["doc"].dataType
    schema = T.StructType(
        [
            T.StructField("kind", T.IntegerType()),
            T.StructField("h1", T.LongType()),
            T.StructField("h2", T.LongType()),
            T.StructField("doc", kind),
            T.StructField("row", T.LongType()),
            T.StructField("line", T.IntegerType()),
            T.StructField("documents", T.LongType()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream, waiting, n = _Stream(copies), [], 0
        for batch in batches:
            waiting.append(batch)
            n += batch.num_rows
            if n >= STREAM_ROWS:
                for out in stream.add(pa.Table.from_batches(waiting)):
                    yield from out.combine_chunks().to_batches()
                waiting, n = [], 0
        if n:
            for out in stream.add(pa.Table.from_batches(waiting)):
                yield from out.combine_chunks().to_batches()
        for out in stream.close():
            yield from out.combine_chunks().to_batches()

    told = settled(ranged.select("h1", "h2", "doc", "row", "line").mapInArrow(run, schema), "lines")
    # Two summaries for each task of the stream, so few whatever the input.
    ends = told.where(F.col("kind") == _SUMMARY).groupBy("h1", "h2")
    totals = ends.agg(F.sum("documents").alias("n"), F.max("doc").alias("top")).where(F.col("n") >= copies)
    unsettled = told.where(F.col("kind") == _OPEN).join(F.broadcast(totals), ["h1", "h2"])
    late = unsettled.where(~F.col("doc").eqNullSafe(F.col("top"))).select("row", "line")
    return told.where(F.col("kind") == _DROPPED).select("row", "line").unionByName(late)


def keep_bitmaps(
    docs: DataFrame, *, least: int = 20, copies: int = 3, text: str = "text", key: str = "doc_id"
) -> DataFrame:
    """``(key, digest, n_lines, n_dropped, keep)``: a row for each different pair of id and text.

    ``keep`` is a bitmap of the lines that stay, in zstandard; ``kept_lines`` reads it, ``apply``
    uses it. Lines are split at line feeds; their key has ASCII whitespace stripped at both ends and
    A-Z in lower case. A key of at least ``least`` code points that at least ``copies`` documents hold
    loses all its lines, except in the document with the largest id.

    A document is its id: rows with one id are one document, and rows without an id are one, before
    all others. A null or empty text has one empty line, which is never dropped. Repeated rows give one row. An empty
    table gives none. Keys are equal if their 128-bit hashes are.
    """
    hashed = settled(_hashed(docs, text, key, least), "hashes")
    lost = _dropped(hashed, copies).groupBy("row").agg(F.collect_list("line").alias("lost"))
    joined = hashed.select("row", "doc", "digest", "n_lines").join(lost, "row", "left")
    schema = T.StructType(
        [
            T.StructField(key, docs.schema[key].dataType),
            T.StructField("digest", T.StringType()),
            T.StructField("n_lines", T.LongType()),
            T.StructField("n_dropped", T.LongType()),
            T.StructField("keep", T.BinaryType()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lost, maps = batch.column("lost").to_pylist(), []
            for n, gone in zip(batch.column("n_lines").to_pylist(), lost, strict=True):
                kept = np.ones(n, bool)
                kept[gone or []] = False
                maps.append(zstandard.compress(np.packbits(kept).tobytes(), 1))
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c) for c in ("doc", "digest", "n_lines")),
                    pa.array([len(x or ()) for x in lost], pa.int64()),
                    pa.array(maps, pa.binary()),
                ],
                names=[f.name for f in schema],
            )

    made = joined.select("doc", "digest", "n_lines", "lost").mapInArrow(run, schema)
    # Rows with the same id and text have the same map: a count of dropped lines, and the map itself.
    same = made.groupBy(column(key), "digest")
    return same.agg(*(F.first(c).alias(c) for c in ("n_lines", "n_dropped", "keep"))).select(*schema.names)


def kept_lines(keep: bytes, n_lines: int) -> np.ndarray:
    """A bitmap as a mask of the lines."""
    packed = np.frombuffer(zstandard.decompress(keep), np.uint8)
    return np.unpackbits(packed, count=n_lines).astype(bool)


def apply(docs: DataFrame, bitmaps: DataFrame, *, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``docs`` with ``n_lines``, ``n_dropped`` and ``kept``, the lines that stay joined by line feeds.

    Rows are matched by id, null included, and text. Other columns pass through, columns called as
    the new ones are replaced. Repeated rows stay. Only documents that lose lines are taken from
    ``bitmaps``; the others keep their whole text.
    """
    new = ("n_lines", "n_dropped", "kept")
    fields = [f for f in docs.schema if f.name.lower() not in new]
    # Plain names on the way to Python: PySpark looks columns up by their unquoted names.
    plain = [f"c{k}" for k in range(len(fields))]
    names = [f.name.lower() for f in fields]
    text_, key_ = plain[names.index(text.lower())], plain[names.index(key.lower())]
    own = docs.select(*(column(f.name).alias(c) for f, c in zip(fields, plain, strict=True)))
    few = bitmaps.where(F.col("n_dropped") > 0).select(column(key).alias("k"), F.col("digest").alias("d"), "n_dropped", "keep")
    met = F.col("k").eqNullSafe(F.col(key_)) & (F.col("d") == text_digest(F.col(text_)))
    joined = own.join(few, met, "left").select(*plain, "n_dropped", "keep")
    schema = T.StructType(
        [
            *fields,
            T.StructField("n_lines", T.LongType()),
            T.StructField("n_dropped", T.LongType()),
            T.StructField("kept", T.StringType()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_):
                counts, rest = [], []
                keeps = part.column("keep").to_pylist()
                for value, keep in zip(part.column(text_).cast(pa.binary()).to_pylist(), keeps, strict=True):
                    value = value or b""
                    n = value.count(b"\n") + 1
                    counts.append(n)
                    if keep is not None:
                        lines = value.split(b"\n")
                        value = b"\n".join([lines[i] for i in np.flatnonzero(kept_lines(keep, n))])
                    rest.append(value)
                yield pa.RecordBatch.from_arrays(
                    [
                        *(part.column(c) for c in plain),
                        pa.array(counts, pa.int64()),
                        pc.fill_null(part.column("n_dropped"), 0),
                        pa.array(rest, pa.binary()).cast(pa.string()),
                    ],
                    names=[f.name for f in schema],
                )

    return joined.mapInArrow(run, schema)
