"""Remove strings that occur more than once, by a difference cover of the suffixes.

A difference cover D modulo v holds, for any two positions, a shift below v that takes both of them to
sampled ones (positions whose remainder is in D). So it is enough to order the sampled suffixes; any
other suffix is a few bytes and then a sampled one.

1. Sampled triples. The bytes from a sampled position, read in three parts, are sorted over all
   documents; equal ones are adjacent and get the same name. A position whose name nothing else has
   drops out.
2. Recursion on names. The names at steps of v are a text again. Its triples are sorted and named in
   the same way, and again single ones drop out. These names cover all but v - 1 of the bytes asked for.
3. The remaining suffixes, up to v - 1 bytes before a sampled one that is left, are merged: they
   are sorted with one another by the prefix of the length asked for, and adjacent equal prefixes
   mark their positions.

Only prefixes of one length are asked for, so the order of unequal ones is of no use: a prefix is
sorted by its hash, which lets all keys be of 64 bits, and one level of recursion reaches that length.
A removed byte is one that a marked prefix covers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from salesmart.llm import exchange
from salesmart.llm.steps import column

#: Perfect difference sets, by the smallest length of strings they are used for.
COVERS = {
    183: (57, (0, 1, 3, 13, 32, 36, 43, 52)),
    399: (91, (0, 1, 3, 9, 27, 49, 56, 61, 77, 81)),
}

_TRIPLES, _NAMES, _REST = 1, 2, 3
_HASHES: dict[int, exchange.Rolling] = {}


def is_cover(v: int, residues: tuple[int, ...]) -> bool:
    return {(a - b) % v for a in residues for b in residues} == set(range(v))


def _rolling(seed: int) -> exchange.Rolling:
    if seed not in _HASHES:
        _HASHES[seed] = exchange.Rolling(seed, 1 << 13)
    return _HASHES[seed]


class Sample:
    """What the rounds compute for the documents of a chunk.

    Triples are made twice, to send them and to name them. Triples of names are sent with their positions in the
    documents end to end, and those with repeated names come back, which is all that the last rounds need. Rows of a chunk come in any order, so they are sorted by what
    they say; equal documents have equal results.
    """

    def __init__(self, docs: list[bytes], length: int, cover: tuple[int, tuple[int, ...]], buckets: int):
        keys = [(len(d), xxhash.xxh3_128_digest(d)) for d in docs]
        self.order = sorted(range(len(docs)), key=keys.__getitem__)
        self.docs = [np.frombuffer(docs[i], np.uint8) for i in self.order]
        self.starts = np.cumsum([0, *map(len, self.docs)])
        self.length, self.buckets = length, buckets
        self.v, self.residues = cover
        # A triple of names covers ``first + 2 v`` bytes, which must be length - v + 1.
        self.first = length - 3 * self.v + 1

    def _sampled(self, size: int) -> np.ndarray:
        count = size - self.first + 1
        if size < self.length:
            return np.zeros(0, np.int64)
        whole = np.arange(0, count, self.v)[:, None] + np.array(self.residues)[None, :]
        whole = whole.ravel()
        return whole[whole < count]

    def triples(self) -> exchange.Grouped:
        """Keys of the sampled positions of all documents."""
        cuts = [0, self.first // 3, 2 * self.first // 3, self.first]
        self.at = [self._sampled(len(d)) for d in self.docs]
        keys = []
        for data, at in zip(self.docs, self.at, strict=True):
            key = np.zeros(len(at), np.uint64)
            for start, end in zip(cuts, cuts[1:], strict=False):
                part = _rolling(1).windows(data[start:], end - start, at)
                key = exchange.mixed(key ^ part) if len(at) else key
            keys.append(key)
        every = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
        return exchange.grouped(every, exchange.bucket_of(every, self.buckets))

    def names(self, answers: pa.Table) -> tuple[exchange.Grouped, np.ndarray]:
        """Keys of the triples of names that have no single one, and where they start."""
        found = self.triples()
        named = exchange.answered(answers, _TRIPLES, found)[1][found.group]
        step = len(self.residues)
        keys, places = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        start = 0
        for at, offset in zip(self.at, self.starts, strict=False):
            own = named[start : start + len(at)]
            start += len(at)
            n = max(0, len(own) - 2 * step)
            a, b, c = own[:n], own[step : step + n], own[2 * step : 2 * step + n]
            left = np.flatnonzero((a > 0) & (b > 0) & (c > 0))
            keys.append(exchange.mixed(exchange.mixed(exchange.mixed(a[left]) ^ b[left]) ^ c[left]))
            places.append(at[left] + offset)
        every = np.concatenate(keys)
        return exchange.grouped(every, exchange.bucket_of(every, self.buckets)), np.concatenate(places)

    def rest(self, answers: pa.Table) -> exchange.Grouped:
        """Keys of the suffixes that lie at most v - 1 bytes before one with a repeated name."""
        told = answers.filter(pc.equal(answers["round"], _NAMES))["names"].to_pylist()
        places = np.sort(np.concatenate([np.zeros(0, np.int64), *(exchange.unpack(x).astype(np.int64) for x in told)]))
        keys, spreads, self.left = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)], []
        cuts = np.searchsorted(places, self.starts)
        for data, offset, a, b in zip(self.docs, self.starts, cuts, cuts[1:], strict=False):
            own_places = places[a:b] - offset
            n = len(data) - self.length + 1
            if not len(own_places) or n <= 0:
                self.left.append(np.zeros(0, np.int64))
                continue
            marks = np.zeros(n + 1, np.int32)
            np.add.at(marks, np.clip(own_places - self.v + 1, 0, n), 1)
            np.add.at(marks, np.clip(own_places + 1, 0, n), -1)
            positions = np.flatnonzero(np.cumsum(marks)[:n] > 0)
            self.left.append(positions)
            # Two hashes: the bucket is of one and the key the other, so that their bits add up.
            keys.append(_rolling(2).windows(data, self.length, positions))
            spread = _rolling(3).windows(data, self.length, positions)
            spreads.append(exchange.bucket_of(spread, self.buckets * 4))
        return exchange.grouped(np.concatenate(keys), np.concatenate(spreads))

    def spans(self, answers: pa.Table) -> list[list[tuple[int, int]]]:
        """Removed runs of each document."""
        found = self.rest(answers)
        repeated = exchange.answered(answers, _REST, found, named=False)[0][found.group]
        out, start = [], 0
        for positions in self.left:
            own = positions[repeated[start : start + len(positions)]]
            start += len(positions)
            runs: list[tuple[int, int]] = []
            if len(own):
                cuts = np.flatnonzero(np.diff(own) > self.length) + 1
                for run in np.split(own, cuts):
                    runs.append((int(run[0]), int(run[-1]) + self.length))
            out.append(runs)
        return out


def _cover(length: int) -> tuple[int, tuple[int, ...]]:
    fitting = [least for least in COVERS if least <= length]
    if not fitting:
        raise ValueError(f"strings of fewer than {min(COVERS)} bytes are not supported")
    return COVERS[max(fitting)]


def remove_repeats(docs: DataFrame, *, length: int = 400, text: str = "text") -> DataFrame:
    """``docs`` with ``n_bytes``, ``removed`` (byte spans, end exclusive) and ``kept`` (the rest).

    Texts are taken as UTF-8 bytes; a null text is empty. A byte is removed if a string of ``length``
    bytes that covers it also starts anywhere else, in the same document or in another; no string
    reaches from one document into another. ``kept`` is binary, since a cut may fall into a
    character. Equal rows are documents each, so all their strings repeat. Shorter and empty texts
    lose nothing. Other columns pass through, columns called as the new ones are replaced. An empty
    table stays empty.

    Copies of a text that would fill a chunk are dealt over several, and their keys are counted across
    chunks as all others. Documents are sent to their chunks once; the rounds then exchange packed keys. Strings are equal
    if two 64-bit hashes agree, of which one also chooses the bucket: the number of buckets grows with
    the input, and with it the bits that are compared.
    """
    cover = _cover(length)
    density = len(cover[1]) / cover[0]
    plan = exchange.layout(docs, text, density, exchange.ROW_BYTES)
    new = ("n_bytes", "removed", "kept")
    kept_fields = [f for f in docs.schema if f.name.lower() not in new]
    # Plain names on the way to Python: PySpark looks columns up by their unquoted names.
    names_ = [f"c{k}" for k in range(len(kept_fields))]
    text_ = names_[[f.name.lower() for f in kept_fields].index(text.lower())]
    own = docs.select(*(column(f.name).alias(c) for f, c in zip(kept_fields, names_, strict=True)))
    chunked = exchange.dealt(own, None, text_, plan.chunks)
    buckets = plan.buckets

    def sample(table: pa.Table) -> Sample:
        return Sample(list(exchange.texts(table, text_)), length, cover, buckets)

    def chunk_of(table: pa.Table) -> int:
        return table.column("__chunk")[0].as_py()

    def send_triples(table: pa.Table) -> pa.Table:
        return exchange.blocks(chunk_of(table), _TRIPLES, sample(table).triples())

    def send_names(table: pa.Table, answers: pa.Table) -> pa.Table:
        work, chunk = sample(table), chunk_of(table)
        found, places = work.names(answers)
        return exchange.blocks(chunk, _NAMES, found, places)

    def send_rest(table: pa.Table, answers: pa.Table) -> pa.Table:
        return exchange.blocks(chunk_of(table), _REST, sample(table).rest(answers))

    span = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    schema = T.StructType(
        [
            *kept_fields,
            T.StructField("n_bytes", T.LongType()),
            T.StructField("removed", T.ArrayType(span)),
            T.StructField("kept", T.BinaryType()),
        ]
    )

    def finish(table: pa.Table, answers: pa.Table) -> pa.Table:
        work = sample(table)
        runs = work.spans(answers)
        rest = []
        for data, cut in zip(work.docs, runs, strict=True):
            left = np.ones(len(data), bool)
            for start, end in cut:
                left[start:end] = False
            rest.append(data[left].tobytes())
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        table = table.take(pa.array(work.order, pa.int64()))
        columns = [table.column(c) for c in names_]
        return pa.table(
            [
                *columns,
                pa.array([len(d) for d in work.docs], pa.int64()),
                pa.array([[{"start": s, "end": e} for s, e in cut] for cut in runs], kind),
                pa.array(rest, pa.binary()),
            ],
            names=[f.name for f in schema],
        )

    by_chunk = chunked.groupBy("__chunk")

    def with_answers(answers: DataFrame, run, out) -> DataFrame:
        def both(table: pa.Table, rows: pa.Table) -> pa.Table:
            return run(table, rows) if table.num_rows else _nothing(out)

        return by_chunk.cogroup(answers.groupBy("chunk")).applyInArrow(both, out)

    names = exchange.answers(by_chunk.applyInArrow(send_triples, exchange.BLOCKS))
    again = exchange.answers(with_answers(names, send_names, exchange.BLOCKS))
    last = exchange.answers(with_answers(again, send_rest, exchange.BLOCKS), named=False)
    return with_answers(again.unionByName(last), finish, schema)


def _nothing(schema) -> pa.Table:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    kind = _parse_datatype_string(schema) if isinstance(schema, str) else schema
    return to_arrow_schema(kind).empty_table()


def kept_text(kept) -> object:
    """The rest as text; bytes of cut characters become U+FFFD."""
    return F.decode(kept, "UTF-8")
